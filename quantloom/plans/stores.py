"""Queries on the zipped source, the model store and the response cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import learning
from quantloom.plans.base import Registry, rounded
from quantloom.plans.learning import _LATEST, model_rows
from quantloom.sources import archive, files, models, registry  # noqa: F401  (archive and files register their sources)
from quantloom.sources.cache import ResponseCache
from quantloom.sources.shared import new_path
from quantloom.sources.tables import SUPPLIER_DAY_BARS, supplier_day_bars, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _archive(spark, sf_dir):
    """Bars of suppliers, a member for each, in zip archives."""
    b = supplier_day_bars(spark, sf_dir, ties=True).select(F.lpad(F.col("symbol").cast("string"), 6, "0").alias("code"), "ts", "open", "close", "volume")
    path = new_path(spark, "archive")
    archive.write_archive(b.repartition("code").sortWithinPartitions("code", "ts"), path)
    return registry.read(spark, "zip_parquet", path, schema="code string, ts date, open double, close double, volume double")


_ARCHIVE = f"WITH {SUPPLIER_DAY_BARS} SELECT lpad(symbol::VARCHAR, 6, '0') AS code, ts, open, close, volume::DOUBLE AS volume FROM b"


@query("archive_bars", _ARCHIVE, dates=("ts",))
def archive_bars(spark, sf_dir):
    """All members."""
    return _archive(spark, sf_dir)


@query("archive_member", f"{_ARCHIVE} WHERE symbol = 7", dates=("ts",))
def archive_member(spark, sf_dir):
    """One code: only its member is opened."""
    return _archive(spark, sf_dir).where("code = '000007'")


def _saved(spark, sf_dir):
    """A one-column ridge of what was known before the newest session, saved; rows, path and fingerprint."""
    rows = model_rows(spark, sf_dir).withColumn("eligible", F.lit(True))
    newest = rows.agg(F.max("session").alias("s")).first()["s"]
    model = learning.fit_ridge(rows.where(F.col("label_end") < F.lit(newest)), ["dev_5"], "next_return", 1.0)
    path, mark = new_path(spark, "models"), models.fingerprint(rows, ["dev_5"], {"penalty": 1.0, "target": "next_return"})
    models.save_model(spark, path, model, mark, {"penalty": 1.0}, 0.5)
    return rows.where(F.col("session") == F.lit(newest)), path, mark


@query("stored_scores", f"WITH {_LATEST} SELECT symbol, session, round(score, 6) AS score, CASE WHEN score >= 0.5::DOUBLE THEN 1 WHEN score <= 0.1::DOUBLE THEN -1 ELSE 0 END AS signal FROM l", dates=("session",))
def stored_scores(spark, sf_dir):
    """The newest session scored by a model that another session has saved, with the threshold kept beside it."""
    rows, path, mark = _saved(spark, sf_dir)
    found = models.load_model(spark.newSession(), path, mark)
    return rounded(learning.execution_signals(rows.withColumn("score", found.model.score()), found.threshold, 0.1), "symbol", "session", "signal", plain=("score",))


@query(
    "model_reasons",
    f"WITH {_LATEST}, n AS (SELECT count(*) AS n FROM l) SELECT c AS \"case\", r AS reason, CASE WHEN r IS NULL THEN n ELSE 0 END AS n_scored FROM n, (VALUES ('as fitted', NULL), ('for scoring alone', NULL), ('other columns', 'fingerprint_mismatch'), ('no folder', 'missing')) v(c, r)",
)
def model_reasons(spark, sf_dir):
    """How many rows of the newest session each way of loading scores, or why none."""
    rows, path, mark = _saved(spark, sf_dir)
    other = models.fingerprint(rows, ["dev_5", "ret_1"], {"penalty": 1.0, "target": "next_return"})
    tries = {"as fitted": (path, mark), "for scoring alone": (path, None), "other columns": (path, other), "no folder": (f"{path}-none", mark)}
    out = None
    for case, (at, m) in tries.items():
        found = models.load_model(spark, at, m)
        scored = rows.where(found.model.score().isNotNull() if found.model else F.lit(False))
        one = scored.agg(F.count(F.lit(1)).alias("n_scored")).select(F.lit(case).alias("case"), F.lit(found.reason).cast("string").alias("reason"), "n_scored")
        out = one if out is None else out.unionByName(one)
    return out


_ENTRIES = """en AS (SELECT 'k' || o_custkey AS key, o_orderpriority AS source, o_orderkey AS row_count, o_orderstatus AS payload, o_orderdate::TIMESTAMP AS stored_at FROM orders),
lv AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY key ORDER BY stored_at DESC, payload DESC, row_count DESC) = 1)"""
_GONE = "source = '1-URGENT' AND stored_at < TIMESTAMP '2000-01-01'"


def _cache(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    entries = o.select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("row_count"), F.col("o_orderstatus").alias("payload"), F.col("o_orderdate").cast("timestamp").alias("stored_at"))
    c = ResponseCache(spark, new_path(spark, "cache"))
    for k in range(2):
        c.put(entries.where(F.col("row_count") % 2 == k))
    return c


@query("cache_store_cleared", f"WITH {_ENTRIES} SELECT source, count(*) AS n FROM lv WHERE {_GONE} GROUP BY 1")
def cache_store_cleared(spark, sf_dir):
    return _cache(spark, sf_dir).clear("2010-01-01 00:00:00", source="1-URGENT", before="2000-01-01 00:00:00")


@query("cache_store_live", f"WITH {_ENTRIES} SELECT key, source, row_count, payload, strftime(stored_at, '%Y-%m-%d') AS stored_at FROM lv WHERE NOT ({_GONE})")
def cache_store_live(spark, sf_dir):
    """What stays after a clearing by source and age and a compaction."""
    c = _cache(spark, sf_dir)
    c.clear("2010-01-01 00:00:00", source="1-URGENT", before="2000-01-01 00:00:00")
    c.compact()
    return c.live().withColumn("stored_at", F.date_format("stored_at", "yyyy-MM-dd"))


@query("cache_store_hits", f"WITH {_ENTRIES} SELECT c_custkey, coalesce(row_count >= 5 + 100 AND stored_at BETWEEN TIMESTAMP '2001-07-01' - INTERVAL 200 DAY AND TIMESTAMP '2001-07-01', false) AS hit, CASE WHEN hit THEN payload END AS payload FROM customer LEFT JOIN lv ON lv.key = 'k' || c_custkey")
def cache_store_hits(spark, sf_dir):
    """A request for each customer, also for those without an entry."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.lit(5).alias("start"), F.lit(100).alias("count"))
    return _cache(spark, sf_dir).get(asked, "2001-07-01 00:00:00", 200 * 86400).select("c_custkey", "hit", "payload")


@query("symbol_list", "SELECT DISTINCT c_mktsegment || '_' || c_nationkey AS symbol FROM customer WHERE c_custkey % 5 > 0")
def symbol_list(spark, sf_dir):
    """Lists with comments, blanks and repeats, written from customers' segments."""
    c = table(spark, sf_dir, "customer")
    name = F.concat("c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string"))
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("# "), name)).when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("  "), name, F.lit("  # again"))).otherwise(name)
    path = new_path(spark, "symbols")
    c.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return registry.read(spark, "symbol_list", path).select("symbol")


@query("feature_frame_csv", f"WITH {SUPPLIER_DAY_BARS} SELECT symbol::BIGINT AS symbol, ts, close, CASE WHEN volume > 30 THEN volume END::DOUBLE AS volume FROM b", dates=("ts",))
def feature_frame_csv(spark, sf_dir):
    """Bars by way of CSV, missing values and types kept."""
    b = supplier_day_bars(spark, sf_dir).select(F.col("symbol").cast("bigint").alias("symbol"), "ts", "close", F.when(F.col("volume") > 30, F.col("volume")).alias("volume"))
    path = f"{new_path(spark, 'frame')}.csv"
    b.write.option("header", True).csv(path)
    return registry.read(spark, "feature_frame", path, required=("symbol", "ts"), schema="symbol bigint, ts date, close double, volume double")
