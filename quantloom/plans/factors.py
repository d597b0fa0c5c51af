"""Queries on factors, journals and caches."""

from __future__ import annotations


from pyspark.sql import functions as F

from quantloom.functions.expr import canonical_key
from quantloom.operators import factors as fa
from quantloom.operators import order_flow as of
from quantloom.plans.base import Registry, rounded, six
from quantloom.plans.intraday import CFG, PART_SQL, SEGMENT_SQL, features, part
from quantloom.sources import journal
from quantloom.sources.tables import table
from quantloom.sources.shared import new_path

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _new(spark, name: str) -> str:
    return new_path(spark, name)


@query("factor_values", f"WITH {PART_SQL}, q AS (SELECT symbol, date_key, minute, (buy_volume - sell_volume) / print_volume AS flow_delta_ratio, CASE WHEN eligible THEN 25 * (activity + size + imbalance + control) END AS participation_evidence FROM y) SELECT symbol, date_key, minute, {six('flow_delta_ratio', 'participation_evidence')} FROM q")
def factor_values(spark, sf_dir):
    """Two registered factors side by side."""
    return rounded(fa.ORDER_FLOW.add(part(spark, sf_dir), "flow_delta_ratio", "participation_evidence"), "symbol", "date_key", "minute", six=("flow_delta_ratio", "participation_evidence"))


@query("factor_bundle", f"WITH {SEGMENT_SQL} SELECT 'flow_blended_score' AS name, count(*) AS rows, count(*) FILTER (k < 3) AS missing, 6 AS n_inputs FROM (SELECT {' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in of.SCORE)} AS k FROM v)")
def factor_bundle(spark, sf_dir):
    """A factor written with its manifest; the manifest read back."""
    frame = fa.ORDER_FLOW.add(of.blended_features(features(spark, sf_dir), CFG), "flow_blended_score")
    path = _new(spark, "bundle")
    fa.bundle(frame, fa.ORDER_FLOW.found["flow_blended_score"], path, ["symbol", "date_key", "minute"], "events")
    kind = "name string, inputs array<string>, rows long, missing long"
    return spark.read.schema(kind).json(f"{path}/manifest").select("name", "rows", "missing", F.size("inputs").alias("n_inputs"))


# a record for each order; some lines of the journal are broken, of another version, without a title, of a strange stance, or in the wrong folder
_KIND = "CASE WHEN o_orderkey % 41 = 0 THEN 'corrupt' WHEN o_orderkey % 37 = 0 THEN 'version' WHEN o_orderkey % 31 = 0 THEN 'missing_field' WHEN o_orderkey % 29 = 0 THEN 'stance' WHEN o_orderkey % 23 = 0 THEN 'misplaced' END"


def _journal(spark, sf_dir) -> str:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(k % 41 == 0, "corrupt").when(k % 37 == 0, "version").when(k % 31 == 0, "missing_field").when(k % 29 == 0, "stance").when(k % 23 == 0, "misplaced").otherwise("")
    code = F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string"))
    day = F.trunc(F.col("o_orderdate").cast("date"), "year")
    line = F.to_json(F.struct(code.alias("code"), day.alias("analysis_date"), day.alias("as_of"), F.when(kind == "stance", "up").otherwise(F.element_at(F.array(*[F.lit(x) for x in journal.STANCES]), (k % 3 + 1).cast("int"))).alias("stance"), F.when(kind != "missing_field", F.col("o_orderpriority")).alias("title"), F.col("o_totalprice").alias("trigger"), F.array("o_orderstatus").alias("tags"), F.when(kind == "version", 2).otherwise(journal.VERSION).alias("version")))
    lines = o.select(F.when(kind == "corrupt", F.substring(line, 1, 20)).otherwise(line).alias("value"), F.when(kind == "misplaced", "C99").otherwise(code).alias("folder"), day.cast("string").alias("day"))
    path = _new(spark, "journal")
    lines.repartition("folder", "day").write.partitionBy("folder", "day").text(path)
    return path


@query("journal_records", f"WITH q AS (SELECT *, {_KIND} AS kind FROM orders) SELECT 'C' || (o_custkey % 10) AS code, year(o_orderdate)::INTEGER AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM q WHERE kind IS NULL GROUP BY 1, 2")
def journal_records(spark, sf_dir):
    good, _ = journal.read(spark, _journal(spark, sf_dir), "*.txt")
    return good.groupBy("code", F.year("analysis_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("trigger"), 2).alias("total"))


@query("journal_warnings", f"WITH q AS (SELECT *, {_KIND} AS kind FROM orders) SELECT kind AS warning, count(*) AS n FROM q WHERE kind IS NOT NULL GROUP BY 1")
def journal_warnings(spark, sf_dir):
    _, bad = journal.read(spark, _journal(spark, sf_dir), "*.txt")
    return bad.groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query("journal_filter", "SELECT 'C' || (o_custkey % 10) AS code, date_trunc('year', o_orderdate)::DATE::VARCHAR AS day, o_orderpriority AS title, count(*) AS n FROM orders WHERE o_custkey % 10 = 3 AND year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderkey % 3 = 1 AND contains(lower(o_orderpriority), 'urgent') GROUP BY 1, 2, 3")
def journal_filter(spark, sf_dir):
    """Records written, read back and searched by code, days and text."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.trunc(F.col("o_orderdate").cast("date"), "year")
    none = F.lit(None).cast("double")
    rec = o.select(F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string")).alias("code"), day.alias("analysis_date"), day.alias("as_of"), F.element_at(F.array(*[F.lit(x) for x in journal.STANCES]), (k % 3 + 1).cast("int")).alias("stance"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("trigger"), none.alias("stop"), none.alias("target"), F.array("o_orderstatus").alias("tags"), F.lit(journal.VERSION).alias("version"))
    path = _new(spark, "journal")
    journal.write(rec, path)
    found = journal.search(journal.read(spark, path)[0].where("stance = 'bearish'"), "C3", "1996-01-01", "1998-12-31", "URGENT")
    return found.groupBy("code", F.col("analysis_date").cast("string").alias("day"), "title").agg(F.count(F.lit(1)).alias("n"))


@query("cache_clear", "SELECT event_type AS source, count(*) AS n FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def cache_clear(spark, sf_dir):
    return journal.clear(table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("stored_at")), "view", "2024-01-15")[1]


@query("cache_hits", """WITH e AS (SELECT user_id AS key, count(*) AS row_count, max(ts) AS stored_at FROM events GROUP BY 1)
SELECT o_orderkey, coalesce(row_count >= o_orderkey % 40 + 20 AND date_diff('day', stored_at::DATE, DATE '2024-01-31') BETWEEN 0 AND 3, false) AS hit FROM orders LEFT JOIN e ON e.key = o_custkey""")
def cache_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("row_count"), F.max("ts").alias("stored_at"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 40).alias("start"), F.lit(20).alias("count"))
    return journal.cache_hits(r, e, "2024-01-31", 3).select("o_orderkey", "hit")


@query("request_keys", """SELECT o_orderkey, sha256('{"code":"' || o_custkey || '","count":20,"period":' || CASE WHEN o_orderkey % 2 = 0 THEN '"daily"' ELSE 'null' END || '}') AS key FROM orders""")
def request_keys(spark, sf_dir):
    """The key of a request: a hash of its fields in order, missing ones too."""
    fields = {"period": F.when(F.col("o_orderkey") % 2 == 0, "daily"), "count": F.lit(20), "code": F.col("o_custkey").cast("string")}
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical_key(fields).alias("key"))


@query("signal_listing", f"WITH {PART_SQL} SELECT symbol, date_key, minute, state, round(participation_score, 6) AS participation_score FROM y WHERE confirmed ORDER BY symbol, date_key, minute LIMIT 100")
def signal_listing(spark, sf_dir):
    """The first hundred confirmed bars: a report."""
    first = part(spark, sf_dir).where("confirmed").orderBy("symbol", "date_key", "minute").limit(100)
    return rounded(first, "symbol", "date_key", "minute", "state", plain=("participation_score",))
