"""Queries on catalogues, caches, journals and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import expr
from quantloom.operators import catalog as op
from quantloom.plans.base import Registry, rounded
from quantloom.sources.tables import MONTH_BARS, SUPPLIER_DAY_BARS, concept_members, concepts, daily_prints, month_bars, supplier_day_bars, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CON = "k AS (SELECT (885000 + n_nationkey)::VARCHAR AS code, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'A' ELSE 'HK' END AS exchange FROM nation), m AS (SELECT (885000 + c_nationkey)::VARCHAR AS code, lpad(c_custkey::VARCHAR, 6, '0') AS member, c_acctbal AS balance FROM customer), n AS (SELECT code, count(*) AS n_rows, count(DISTINCT member) AS n_members, count(*) FILTER (balance < 0) AS n_negative FROM m GROUP BY 1)"


@query("concept_member_counts", f"WITH {CON} SELECT code, n_rows, n_members, n_negative, n_rows > n_members AS repeated FROM n")
def concept_member_counts(spark, sf_dir):
    return op.member_counts(concept_members(spark, sf_dir))


@query("concept_catalog", f"WITH {CON} SELECT k.code, name, coalesce(n_members, 0) AS n_members FROM k LEFT JOIN n ON n.code = k.code WHERE exchange = 'A' AND left(k.code, 3) IN ('885', '886') ORDER BY n_members DESC, k.code")
def concept_catalog(spark, sf_dir):
    out = op.with_member_counts(op.concept_filter(concepts(spark, sf_dir)), op.member_counts(concept_members(spark, sf_dir)))
    return out.select("code", "name", F.coalesce("n_members", F.lit(0)).alias("n_members"))


@query("concept_completeness", f"WITH {CON}, f AS (SELECT code FROM k WHERE exchange = 'A') SELECT f.code, 'members' AS missing_from FROM f LEFT JOIN n ON n.code = f.code WHERE n.code IS NULL UNION ALL SELECT n.code, 'catalog' FROM n LEFT JOIN f ON f.code = n.code WHERE f.code IS NULL")
def concept_completeness(spark, sf_dir):
    return op.incomplete(op.concept_filter(concepts(spark, sf_dir)), op.member_counts(concept_members(spark, sf_dir)))


@query("concept_info_long", f"WITH {CON} SELECT code, 'n_rows' AS item, n_rows::DOUBLE AS value FROM n UNION ALL SELECT code, 'n_members', n_members FROM n UNION ALL SELECT code, 'n_negative', n_negative FROM n")
def concept_info_long(spark, sf_dir):
    n = op.member_counts(concept_members(spark, sf_dir))
    return op.long_form(n.select("code", *[F.col(c).cast("double").alias(c) for c in ("n_rows", "n_members", "n_negative")]), ["code"], ["n_rows", "n_members", "n_negative"])


@query("asset_search", "SELECT lpad(p_partkey::VARCHAR, 6, '0') AS code, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lpad(p_partkey::VARCHAR, 6, '0'), 'ring') ORDER BY code LIMIT 50")
def asset_search(spark, sf_dir):
    return op.search(table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"), F.col("p_name").alias("name")), "RING", 50)


@query(
    "symbol_parse",
    """WITH c AS (SELECT c_custkey, lpad(((c_custkey * 7919) % 1000000)::VARCHAR, 6, '0') AS code FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE code END AS code, CASE WHEN c_custkey % 5 = 0 THEN 'SH' WHEN c_custkey % 5 = 1 THEN 'SZ' WHEN c_custkey % 5 = 4 THEN NULL WHEN left(code, 2) IN ('60', '68') THEN 'SH' WHEN left(code, 2) IN ('00', '30', '20') THEN 'SZ' WHEN left(code, 1) IN ('4', '8') THEN 'BJ' END AS exchange,
CASE WHEN c_custkey % 5 <> 4 AND left(code, 3) IN ('300', '301', '688', '689') THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS limit_ratio FROM c""",
)
def symbol_parse(spark, sf_dir):
    code = F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    kind = F.col("c_custkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit("sh: "), code)).when(kind == 1, F.concat(code, F.lit(".SZ"))).when(kind == 2, F.concat(F.lit(" "), code)).when(kind == 3, code).otherwise(F.concat(code, F.lit("7")))
    out = table(spark, sf_dir, "customer").select("c_custkey", expr.parse_symbol(raw).alias("s")).select("c_custkey", "s.code", "s.exchange")
    return out.withColumn("limit_ratio", F.coalesce(expr.limit_ratio("code"), F.lit(0.1)))


@query(
    "date_and_clock_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) END::BIGINT AS date_key,
CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 86400 WHEN 1 THEN (9 + o_orderkey % 6) * 3600 + (o_orderkey % 60) * 60 ELSE 143000 // 10000 * 3600 + 3000 // 100 * 60 + o_orderkey % 60 END::BIGINT AS second FROM orders""",
)
def date_and_clock_parse(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(k % 4 == 0, F.date_format(d, "yyyyMMdd")).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(d, "yyyy/MM/dd")).otherwise("soon")
    clock = F.when(k % 3 == 0, (k % 86400).cast("string")).when(k % 3 == 1, F.concat((9 + k % 6).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))).otherwise((143000 + k % 60).cast("string"))
    return table(spark, sf_dir, "orders").select(k, F.coalesce(expr.date_key(expr.parse_date(date)).cast("bigint"), F.lit(0)).alias("date_key"), expr.parse_clock(clock).cast("bigint").alias("second"))


@query(
    "journal_search",
    """WITH j AS (SELECT doc_id, source, lang, concat_ws(' ', source, lang, text) AS t FROM documents) SELECT doc_id, source, lang, count(*) OVER () AS total FROM j WHERE contains(lower(t), 'license') ORDER BY doc_id DESC LIMIT 20""",
)
def journal_search(spark, sf_dir):
    """Free text over several fields: the newest 20 hits and how many there are."""
    hits = table(spark, sf_dir, "documents").where(F.lower(F.concat_ws(" ", "source", "lang", "text")).contains("license")).select("doc_id", "source", "lang")
    # one scan: each partition keeps its count and its newest 20
    some = hits.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("doc_id", "source", "lang")))), 1, 20).alias("top"))
    whole = some.agg(F.sum("n").alias("total"), F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("top")))), 1, 20).alias("top"))
    return whole.select("total", F.inline("top"))


@query("cache_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def cache_latest(spark, sf_dir):
    """The newest entry of each key wins."""
    return op.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("cache_stats", "SELECT event_type, count(*) AS entries, sum(user_id)::BIGINT AS total_rows, max(event_id) AS newest FROM events GROUP BY 1")
def cache_stats(spark, sf_dir):
    return op.cache_stats(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id")


@query("cache_tail_slice", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE n > 5 AND n <= 15 AND c >= 15")
def cache_tail_slice(spark, sf_dir):
    return op.tail_slice(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5, 10).select("user_id", "event_id")


@query("cache_freshness", "SELECT CASE WHEN a < 0 THEN 'future' WHEN a <= 7 THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n FROM (SELECT date_diff('day', ts::DATE, DATE '2024-01-20') AS a FROM events) GROUP BY 1")
def cache_freshness(spark, sf_dir):
    return op.freshness(table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), "day", F.lit("2024-01-20").cast("date"), 7).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_seen(spark, sf_dir):
    return op.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("props_json", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(DISTINCT (props->>'k')::BIGINT) AS n_values FROM events GROUP BY 1")
def props_json(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.countDistinct(k).alias("n_values"))


@query(
    "repeated_pages",
    """WITH r AS (SELECT event_id // 10 AS page, event_id FROM events), u AS (SELECT page, event_id FROM r UNION ALL SELECT page + 1000000000, event_id FROM r WHERE page % 7 = 0),
g AS (SELECT page, list(event_id ORDER BY event_id) AS c, count(*) AS n FROM u GROUP BY page) SELECT page, first_page, n FROM (SELECT page, n, min(page) OVER (PARTITION BY c) AS first_page FROM g) WHERE page > first_page""",
)
def repeated_pages(spark, sf_dir):
    """Every seventh page of events is sent twice and must be found."""
    ev = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("page"), "event_id")
    both = ev.unionByName(ev.where("page % 7 = 0").select((F.col("page") + 1000000000).alias("page"), "event_id"))
    return op.repeated_pages(both, "page", ["event_id"])


@query("daily_reconciliation", f"""WITH {SUPPLIER_DAY_BARS}, a AS (SELECT day, sum(volume) AS v FROM p WHERE NOT (flag = 'A' AND l_linenumber = 7) GROUP BY 1), t AS (SELECT ts, sum(volume) AS v FROM b GROUP BY 1)
SELECT coalesce(a.day, t.ts)::VARCHAR AS day, a.v AS left_total, t.v AS right_total, round(t.v / a.v, 6) AS share, coalesce(abs(t.v / a.v - 1) > 0.05::DOUBLE, true) AS mismatch FROM a FULL JOIN t ON a.day = t.ts""")
def daily_reconciliation(spark, sf_dir):
    """Volume of the prints that were collected (some never arrive) against volume of the bars, day by day: more than 5 % apart is a mismatch."""
    p = daily_prints(spark, sf_dir)
    a = p.where("NOT (flag = 'A' AND trade_count = 7)").select("day", "volume")
    b = supplier_day_bars(spark, sf_dir).select(F.col("ts").alias("day"), "volume")
    return rounded(op.reconcile(a, b, ["day"], "volume", 0.05).withColumn("day", F.col("day").cast("string")), "day", "left_total", "right_total", "mismatch", plain=("share",))


@query("set_operations", "(SELECT c_custkey AS k, 'never_ordered' AS kind FROM customer EXCEPT SELECT o_custkey, 'never_ordered' FROM orders) UNION ALL (SELECT DISTINCT o_custkey, 'large' FROM orders WHERE o_totalprice > 400000 INTERSECT SELECT c_custkey, 'large' FROM customer WHERE c_acctbal > 5000)")
def set_operations(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    never = c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct().withColumn("kind", F.lit("never_ordered"))
    large = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).intersect(c.where("c_acctbal > 5000").select("c_custkey")).withColumn("kind", F.lit("large"))
    return never.unionByName(large)


@query("top_per_segment", "SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer) WHERE rank <= 10")
def top_per_segment(spark, sf_dir):
    w = op.Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@query("distinct_provenance", "SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, count(*) AS n FROM documents GROUP BY source")
def distinct_provenance(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), "|").alias("langs"), F.count(F.lit(1)).alias("n"))


@query("equity_drawdown", f"""WITH {MONTH_BARS}, q AS (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM b),
d AS (SELECT *, 1 - close / peak AS dd, sum((close = peak)::INTEGER) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM q), l AS (SELECT symbol, island, count(*) FILTER (dd > 0) AS n FROM d GROUP BY 1, 2)
SELECT symbol, round(max(dd), 6) AS max_drawdown, (SELECT max(n) FROM l WHERE l.symbol = d.symbol) AS longest FROM d GROUP BY symbol""")
def equity_drawdown(spark, sf_dir):
    """Deepest fall below the running maximum, and the longest stretch under it."""
    from quantloom.functions import windows as w

    s = w.by("symbol")
    d = month_bars(spark, sf_dir).withColumn("dd", w.drawdown("close", s)).withColumn("island", w.islands(F.col("dd") == 0, s))
    longest = d.groupBy("symbol", "island").agg(F.count_if(F.col("dd") > 0).alias("n"), F.max("dd").alias("dd"))
    return rounded(longest.groupBy("symbol").agg(F.max("dd").alias("max_drawdown"), F.max("n").alias("longest")), "symbol", "longest", plain=("max_drawdown",))


# suppliers as a raw catalogue: of two exchanges and types, with and without the suffix, in small letters, with blanks, some codes and names twice
_RAW = """rw AS (SELECT (CASE WHEN s_suppkey % 4 = 0 THEN '884' WHEN s_suppkey % 4 = 1 THEN '885' ELSE '886' END || lpad((s_suppkey % 90)::VARCHAR, 3, '0') || CASE WHEN s_suppkey % 7 = 0 THEN '.SH' ELSE '.TI' END) AS code, CASE WHEN s_suppkey % 23 = 0 THEN '  ' ELSE ' ' || substr(s_name, 1, 17) || (s_suppkey % 95)::VARCHAR || ' ' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'HK' ELSE 'A' END AS exchange, CASE WHEN s_suppkey % 6 = 0 THEN 'industry' ELSE 'concept' END AS index_type FROM supplier),
ct AS (SELECT upper(trim(code)) AS code, trim(name) AS name FROM rw WHERE exchange = 'A' AND index_type = 'concept' AND left(code, 3) IN ('885', '886') AND right(code, 3) = '.TI')"""


def _raw_catalog(spark, sf_dir):
    k = F.col("s_suppkey")
    code = F.concat(F.when(k % 4 == 0, "884").when(k % 4 == 1, "885").otherwise("886"), F.lpad((k % 90).cast("string"), 3, "0"), F.when(k % 7 == 0, ".SH").otherwise(".TI"))
    name = F.when(k % 23 == 0, "  ").otherwise(F.concat(F.lit(" "), F.substring("s_name", 1, 17), (k % 95).cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "supplier").select(code.alias("code"), name.alias("name"), F.when(k % 5 == 0, "HK").otherwise("A").alias("exchange"), F.when(k % 6 == 0, "industry").otherwise("concept").alias("index_type"))


@query("concepts_of_catalog", f"WITH {_RAW} SELECT code, name FROM ct")
def concepts_of_catalog(spark, sf_dir):
    """The four predicates of a catalogue of concepts."""
    return op.concepts_of(_raw_catalog(spark, sf_dir))


@query("catalog_faults", f"WITH {_RAW} SELECT 'empty' AS fault, '' AS value, count(*) AS n FROM ct WHERE code = '' OR name = '' HAVING count(*) > 0 UNION ALL SELECT 'duplicate_code', code, count(*) FROM ct WHERE code <> '' GROUP BY code HAVING count(*) > 1 UNION ALL SELECT 'duplicate_name', name, count(*) FROM ct WHERE name <> '' GROUP BY name HAVING count(*) > 1")
def catalog_faults(spark, sf_dir):
    return op.catalog_faults(op.concepts_of(_raw_catalog(spark, sf_dir)))


@query("concept_lookup", f"WITH {CON} SELECT code, name FROM k WHERE name = 'NATION_7'")
def concept_lookup(spark, sf_dir):
    """A name's concept; two rows would say that it is ambiguous."""
    return op.unique_match(concepts(spark, sf_dir), "name", "NATION_7").select("code", "name")
