"""Queries on input checks and on historical bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import history, quality
from quantloom.plans.base import Registry, rounded
from quantloom.sources.tables import SUPPLIER_DAY_BARS, supplier_day_bars, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# line items as raw prints in text, with faults that the keys tell: times that are none, markers, fractions, unknown flags
RAW = """raw AS (SELECT l_suppkey AS symbol, l_shipdate::DATE AS day, l_orderkey AS o, l_linenumber AS ln, l_partkey AS pk, l_extendedprice AS ep,
  CASE WHEN l_orderkey % 97 = 0 THEN '25:61' WHEN l_orderkey % 2 = 0 THEN lpad((9 + l_orderkey % 7)::VARCHAR, 2, '0') || ':' || lpad((l_partkey % 60)::VARCHAR, 2, '0') ELSE (33000 + l_partkey % 23000)::VARCHAR END AS time,
  CASE WHEN l_orderkey % 89 = 0 THEN '--' WHEN l_orderkey % 83 = 0 THEN '-1' ELSE (floor(l_extendedprice)::BIGINT)::VARCHAR END AS price, CASE WHEN l_orderkey % 79 = 0 THEN ' NaN ' ELSE (l_quantity::BIGINT)::VARCHAR END AS raw_volume,
  l_linenumber::VARCHAR AS trade_count, CASE WHEN l_orderkey % 73 = 0 THEN '1.5' WHEN l_orderkey % 13 = 0 THEN '9' WHEN l_orderkey % 11 = 0 THEN '5' ELSE (l_orderkey % 3)::VARCHAR END AS flag FROM lineitem)"""


def raw_prints(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    o, pk = F.col("l_orderkey"), F.col("l_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    time = F.when(o % 97 == 0, "25:61").when(o % 2 == 0, F.concat(two(9 + o % 7), F.lit(":"), two(pk % 60))).otherwise((33000 + pk % 23000).cast("string"))
    return li.select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("day"), o.alias("o"), F.col("l_linenumber").alias("ln"), pk.alias("pk"), F.col("l_extendedprice").alias("ep"), time.alias("time"),
        F.when(o % 89 == 0, "--").when(o % 83 == 0, "-1").otherwise(F.floor("l_extendedprice").cast("string")).alias("price"), F.when(o % 79 == 0, " NaN ").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("raw_volume"),
        F.col("l_linenumber").cast("string").alias("trade_count"), F.when(o % 73 == 0, "1.5").when(o % 13 == 0, "9").when(o % 11 == 0, "5").otherwise((o % 3).cast("string")).alias("flag"),
    )


_ORDER = ("second", "o", "ln", "pk", "ep")
PRINTS = RAW + """,
n0 AS (SELECT *, CASE WHEN time LIKE '%:%' THEN CASE WHEN left(time, 2)::INTEGER < 24 AND right(time, 2)::INTEGER < 60 THEN left(time, 2)::INTEGER * 3600 + right(time, 2)::INTEGER * 60 END ELSE time::INTEGER END AS second, CASE WHEN price <> '--' THEN price::DOUBLE END AS p,
         CASE WHEN raw_volume <> ' NaN ' THEN raw_volume::DOUBLE END AS v, flag::DOUBLE AS f FROM raw),
n1 AS (SELECT *, CASE WHEN second IS NULL THEN 'invalid_time' WHEN p IS NULL OR v IS NULL THEN 'missing_field' WHEN f % 1 <> 0 THEN 'non_integer_flag' WHEN p <= 0 THEN 'price_or_count' ELSE '' END AS reason FROM n0),
n AS (SELECT *, CASE WHEN reason = '' THEN CASE f WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END END AS direction, CASE WHEN reason = '' THEN CASE f WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' WHEN 2 THEN 'neutral' WHEN 5 THEN 'after_hours' ELSE 'unknown' END END AS label,
        CASE WHEN reason = '' THEN CASE WHEN second >= 33300 AND second < 34200 THEN 'auction' WHEN second >= 34200 AND second < 41400 OR second >= 46800 AND second < 54000 THEN 'continuous' WHEN second >= 54000 THEN 'after_hours' ELSE 'out' END END AS session FROM n1)"""


@query("print_normalization", f"WITH {PRINTS} SELECT symbol, day, o, ln, pk, ep, reason, direction, label, session, CASE WHEN reason = '' THEN session = 'continuous' AND f <> 5 END AS included, CASE WHEN reason = '' THEN v * 100 END AS volume, CASE WHEN reason = '' THEN p * (v * 100) END AS amount, row_number() OVER (PARTITION BY symbol, day ORDER BY second NULLS FIRST, o, ln, pk, ep) - 1 AS print_id FROM n", dates=("day",))
def print_normalization(spark, sf_dir):
    return quality.normalize_prints(raw_prints(spark, sf_dir), order=_ORDER).select("symbol", "day", "o", "ln", "pk", "ep", "reason", "direction", "label", "session", "included", "volume", "amount", "print_id")


@query("print_policy_drop", f"WITH {PRINTS} SELECT symbol, count(*) AS n_rows, count(*) FILTER (reason <> '') AS n_faulty, count(*) FILTER (session IN ('continuous', 'auction') AND f <> 5) AS n_included, coalesce(sum(v * 100) FILTER (session IN ('continuous', 'auction') AND f <> 5), 0) AS volume FROM n WHERE reason <> '' OR f IN (0, 1, 2, 5) GROUP BY symbol")
def print_policy_drop(spark, sf_dir):
    """Prints whose flag isn't known are dropped, the opening auction counts."""
    n = quality.normalize_prints(raw_prints(spark, sf_dir), include=("continuous", "auction"), unknown="drop", order=_ORDER)
    return n.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("reason") != "").alias("n_faulty"), F.count_if("included").alias("n_included"), F.coalesce(F.sum(F.when(F.col("included"), F.col("volume"))), F.lit(0.0)).alias("volume"))


@query("print_faults", f"WITH {PRINTS} SELECT reason, count(*) AS n, min(day)::VARCHAR AS first_day FROM n WHERE reason <> '' GROUP BY 1")
def print_faults(spark, sf_dir):
    n = quality.normalize_prints(raw_prints(spark, sf_dir), order=_ORDER)
    return n.where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"))


# bars with faults: a NaN, an infinity, a low over the open, a negative volume, a missing close
_SPOILT = """sb AS (SELECT symbol, ts, CASE WHEN symbol % 7 = 1 AND day(ts) = 1 THEN 'nan'::DOUBLE WHEN symbol % 7 = 2 AND day(ts) = 2 THEN 'inf'::DOUBLE ELSE open END AS open, high, CASE WHEN symbol % 7 = 3 AND day(ts) = 3 THEN high + 1 ELSE low END AS low,
  CASE WHEN symbol % 7 = 4 AND day(ts) <= 4 THEN NULL ELSE close END AS close, CASE WHEN symbol % 7 = 5 AND day(ts) = 5 THEN -volume WHEN day(ts) = 6 THEN 0 ELSE volume END AS volume FROM b)"""


def spoilt_bars(spark, sf_dir):
    k, d = F.col("symbol") % 7, F.day("ts")
    return supplier_day_bars(spark, sf_dir).withColumns({
        "open": F.when((k == 1) & (d == 1), float("nan")).when((k == 2) & (d == 2), float("inf")).otherwise(F.col("open")), "low": F.when((k == 3) & (d == 3), F.col("high") + 1).otherwise(F.col("low")),
        "close": F.when((k == 4) & (d <= 4), None).otherwise(F.col("close")), "volume": F.when((k == 5) & (d == 5), -F.col("volume")).when(d == 6, 0.0).otherwise(F.col("volume")),
    })


@query("bar_validity", f"""WITH {SUPPLIER_DAY_BARS}, {_SPOILT} SELECT symbol, ts, CASE WHEN close IS NULL OR isnan(open) THEN 'missing_required' WHEN isinf(open) THEN 'non_finite_required' WHEN NOT (high >= greatest(open, close) AND low <= least(open, close) AND high >= low) THEN 'invalid_ohlc_order' WHEN volume < 0 THEN 'negative_volume' ELSE '' END AS reason, volume = 0 AS zero_volume FROM sb""", dates=("ts",))
def bar_validity(spark, sf_dir):
    return spoilt_bars(spark, sf_dir).select("symbol", "ts", quality.bar_reason().alias("reason"), (F.col("volume") == 0).alias("zero_volume"))


@query("flow_validity", f"""WITH {SUPPLIER_DAY_BARS}, {_SPOILT}, t AS (SELECT symbol, day, sum(volume) AS pv, sum(CASE WHEN volume >= 40 THEN volume ELSE 0 END) AS lv FROM p WHERE flag <> 'N' GROUP BY 1, 2),
x AS (SELECT sb.*, pv * CASE WHEN day(ts) = 8 THEN 0 ELSE 1 END AS pv, lv FROM sb LEFT JOIN t ON t.symbol = sb.symbol AND t.day = sb.ts)
SELECT symbol, ts, CASE WHEN close IS NULL OR isnan(open) OR isinf(open) THEN 'invalid_ohlcv' WHEN NOT (high >= greatest(open, close) AND low <= least(open, close) AND high >= low AND volume >= 0) THEN 'invalid_ohlc_order_or_volume' WHEN pv IS NULL THEN 'transaction_missing' WHEN NOT pv > 0 THEN 'transaction_zero' ELSE '' END AS reason,
  coalesce(CASE WHEN volume > 0 THEN pv / volume END >= 0.9::DOUBLE, false) AND coalesce(CASE WHEN pv > 0 THEN lv / pv END <= 0.95::DOUBLE, false) AS gate FROM x""", dates=("ts",))
def flow_validity(spark, sf_dir):
    from quantloom.functions.expr import ratio
    from quantloom.sources.tables import daily_prints

    big = F.when(F.col("volume") >= 40, F.col("volume")).otherwise(0.0)
    t = daily_prints(spark, sf_dir).where("flag <> 'N'").groupBy("symbol", F.col("day").alias("ts")).agg(F.sum("volume").alias("print_volume"), F.sum(big).alias("large_volume"))
    x = spoilt_bars(spark, sf_dir).join(t, ["symbol", "ts"], "left").withColumn("print_volume", F.col("print_volume") * F.when(F.day("ts") == 8, 0).otherwise(1))
    x = x.withColumns({"observed": F.col("print_volume").isNotNull(), "coverage": ratio("print_volume", "volume"), "large_share": ratio("large_volume", "print_volume")})
    return x.select("symbol", "ts", quality.flow_reason().alias("reason"), quality.gate((0.9, None), (0.0, 0.95)).alias("gate"))


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return quality.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("aliased_columns", "SELECT lpad(trim(c_custkey::VARCHAR), 6, '0') AS symbol, c_acctbal AS amount, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey::DOUBLE END AS rate FROM customer")
def aliased_columns(spark, sf_dir):
    """Provider columns by their aliases, numbers from text with markers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CODE"), F.col("c_acctbal").cast("string").alias("turnover_amount"), F.when(F.col("c_custkey") % 4 == 0, " N/A").otherwise(F.col("c_nationkey").cast("string")).alias("Rate"))
    r = quality.resolve(c, {"symbol": ("code", "ticker"), "amount": ("turnover_amount",), "rate": ("turnover_rate",)})
    return r.select(F.lpad(F.trim(F.col("symbol").cast("string")), 6, "0").alias("symbol"), quality.number("amount").alias("amount"), quality.number("rate").alias("rate"))


@query("chronological_split", f"WITH {SUPPLIER_DAY_BARS} SELECT symbol, CASE WHEN ts <= DATE '1998-12-31' THEN 'train' WHEN ts <= DATE '2000-06-30' THEN 'valid' ELSE 'test' END AS split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY 1, 2", dates=("first_ts", "last_ts"))
def chronological_split(spark, sf_dir):
    s = quality.split_by_date(supplier_day_bars(spark, sf_dir), F.lit("1998-12-31").cast("date"), F.lit("2000-06-30").cast("date"))
    return s.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("calendar_windows", """SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE::VARCHAR AS three_months_before, (SELECT string_agg(d::VARCHAR, ',' ORDER BY d) FROM (SELECT d FROM (SELECT (o_orderdate::DATE + k::INTEGER)::DATE AS d FROM range(1, 10) r(k)) WHERE isodow(d) < 6 ORDER BY d LIMIT 3)) AS next_days, printf('%.2f', o_totalprice) || '%' AS price_text FROM orders""")
def calendar_windows(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    days = F.transform(quality.next_business_days(d, 3), lambda x: x.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.month_window(d, 3).cast("string").alias("three_months_before"), F.array_join(days, ",").alias("next_days"), F.format_string("%.2f%%", "o_totalprice").alias("price_text"))


@query("execution_keys", "SELECT event_id, (year(ts) * 10000 + month(ts) * 100 + day(ts))::BIGINT * 10000 + hour(ts) * 100 + minute(ts) AS minute_key FROM events")
def execution_keys(spark, sf_dir):
    ts = F.col("ts")
    day = F.date_format(ts, "yyyyMMdd").cast("int")
    return table(spark, sf_dir, "events").select("event_id", quality.minute_key(day, F.hour(ts) * 60 + F.minute(ts)).alias("minute_key"))


@query("strict_json", f"""WITH {SUPPLIER_DAY_BARS}, {_SPOILT} SELECT symbol, count(*) AS n, count(*) FILTER (isnan(open) OR isinf(open)) AS n_open_null, count(*) FILTER (close IS NULL) AS n_close_null FROM sb GROUP BY 1""")
def strict_json(spark, sf_dir):
    """Bars as JSON lines and read back with a strict schema: what isn't finite comes back as NULL."""
    text = quality.finite_json(spoilt_bars(spark, sf_dir).select("symbol", "ts", "open", "close"))
    back = text.select(F.from_json("json", "symbol bigint, ts date, open double, close double", {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("open").isNull()).alias("n_open_null"), F.count_if(F.col("close").isNull()).alias("n_close_null"))


@query("security_master", "SELECT lpad(trim(s_suppkey::VARCHAR), 6, '0') AS code, s_name AS name FROM supplier ORDER BY code")
def security_master(spark, sf_dir):
    return history.security_master(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name")))


@query("qualified_codes", """WITH k AS (SELECT DISTINCT lpad(((l_partkey * 7919) % 1000000)::VARCHAR, 6, '0') AS code FROM lineitem), l AS (SELECT lpad(((p_partkey * 7919) % 1000000)::VARCHAR, 6, '0') AS code, p_partkey FROM part WHERE p_partkey % 3 > 0),
t AS (SELECT code, code || '.SH' AS ts_code FROM l UNION ALL SELECT code, code || '.HK' FROM l WHERE p_partkey % 9 = 1), s AS (SELECT code, count(DISTINCT ts_code) AS n, min(ts_code) AS ts_code FROM t GROUP BY 1)
SELECT code, CASE WHEN n > 1 THEN 'ambiguous' WHEN ts_code IS NOT NULL THEN ts_code WHEN code[1] = '6' THEN code || '.SH' WHEN code[1] IN ('0', '3') THEN code || '.SZ' WHEN code[1] IN ('4', '8', '9') THEN code || '.BJ' END AS ts_code FROM k LEFT JOIN s USING (code)""")
def qualified_codes(spark, sf_dir):
    code = lambda c: F.lpad((F.col(c) * 7919 % 1000000).cast("string"), 6, "0").alias("code")
    listed = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(code("p_partkey"), "p_partkey")
    both = listed.select("code", F.concat("code", F.lit(".SH")).alias("ts_code")).unionByName(listed.where("p_partkey % 9 = 1").select("code", F.concat("code", F.lit(".HK")).alias("ts_code")))
    return history.qualified(table(spark, sf_dir, "lineitem").select(code("l_partkey")).distinct(), both)


@query("panel_missing", "SELECT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def panel_missing(spark, sf_dir):
    """Which of the wanted symbols have no bars at all."""
    return history.panel(supplier_day_bars(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")))[1]


@query("panel_fetch", f"WITH {SUPPLIER_DAY_BARS} SELECT symbol, count(*) AS n, sum(volume) AS volume FROM b WHERE symbol IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def panel_fetch(spark, sf_dir):
    found = history.panel(supplier_day_bars(spark, sf_dir), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("symbol")))[0]
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


def snapshot(spark, sf_dir):
    """The daily snapshot: bars with the close before, changes that are missing on even days, turnover and a cumulative factor."""
    s = Window.partitionBy("symbol").orderBy("ts")
    b = supplier_day_bars(spark, sf_dir).withColumn("prev_close", F.lag("close").over(s))
    odd = F.day("ts") % 2 == 1
    return b.withColumns({"change": F.when(odd, F.col("close") - F.col("prev_close")), "pct_change": F.when(odd, (F.col("close") / F.col("prev_close") - 1) * 100), "turnover": F.when(F.day("ts") % 5 > 0, F.col("volume") / 64), "factor": 1 + F.year("ts") % 8 / 16.0})


_SNAP = SUPPLIER_DAY_BARS + """,
h0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, CASE WHEN day(ts) % 5 > 0 THEN volume / 64 END AS turnover, 1 + (year(ts) % 8) / 16.0::DOUBLE AS factor FROM b)"""
_RANGE = "ts BETWEEN DATE '1997-03-05' AND DATE '1999-02-10'"
_AMP = "round(CASE WHEN pc <> 0 THEN (high - low) / pc * 100 END, 6) AS amplitude, round(CASE WHEN pc <> 0 THEN (close - pc) / pc * 100 END, 6) AS pct_change, round(close - pc, 6) AS change"


def _history(period: str, adjust: str):
    def run(spark, sf_dir):
        return rounded(history.historical_bars(snapshot(spark, sf_dir), "1997-03-05", "1999-02-10", period, adjust), "day", "code", "volume", "amount", plain=("open", "close", "high", "low", "amplitude", "pct_change", "change", "turnover"))

    return run


_COLS = "ts AS day, symbol::VARCHAR AS code, volume, amount, round(open, 6) AS open, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, round(turnover, 6) AS turnover"
query("history_daily", f"WITH {_SNAP} SELECT {_COLS}, {_AMP} FROM h0 WHERE {_RANGE}", dates=("day",))(_history("daily", ""))
for _kind, _scale in (("hfq", "factor"), ("qfq", "(factor / latest)")):
    _ADJ = f"""{_SNAP}, lf AS (SELECT symbol, arg_max(factor, ts) AS latest FROM h0 GROUP BY 1), h1 AS (SELECT symbol, ts, volume, amount, turnover, open * {_scale} AS open, high * {_scale} AS high, low * {_scale} AS low, close * {_scale} AS close FROM h0 JOIN lf USING (symbol)),
h2 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM h1)"""
    query(f"history_daily_{_kind}", f"WITH {_ADJ} SELECT {_COLS}, {_AMP} FROM h2 WHERE {_RANGE}", dates=("day",))(_history("daily", _kind))
    for _period, _key in (("weekly", "(date_trunc('week', ts + 2)::DATE + 4)"), ("monthly", "date_trunc('month', ts)::DATE")):
        query(
            f"history_{_period}_{_kind}",
            f"""WITH {_ADJ}, h3 AS (SELECT symbol, {_key} AS k, max(ts) AS ts, arg_min(open, ts) AS open, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume, sum(amount) AS amount, sum(turnover) AS turnover, min(ts) AS first_ts FROM h2 WHERE {_RANGE} GROUP BY 1, 2),
h4 AS (SELECT h3.*, h2.pc FROM h3 JOIN h2 ON h2.symbol = h3.symbol AND h2.ts = h3.first_ts) SELECT {_COLS}, {_AMP} FROM h4""",
            dates=("day",),
        )(_history(_period, _kind))


@query("history_empty", f"WITH {SUPPLIER_DAY_BARS} SELECT ts AS day, symbol::VARCHAR AS code, open, close, high, low, volume, amount, 0.0::DOUBLE AS amplitude, 0.0::DOUBLE AS pct_change, 0.0::DOUBLE AS change, 0.0::DOUBLE AS turnover FROM b WHERE ts > DATE '2030-01-01'", dates=("day",))
def history_empty(spark, sf_dir):
    """No bar in the range: no rows in the same shape."""
    return history.historical_bars(snapshot(spark, sf_dir), "2030-01-02", "2030-12-31", "daily", "")


@query("fine_coarse_check", f"""WITH {SUPPLIER_DAY_BARS}, f AS (SELECT symbol, day, sum(volume) AS fine FROM p WHERE l_linenumber < 7 GROUP BY 1, 2)
SELECT f.symbol, f.day, fine, b.volume AS coarse, round(fine / b.volume, 6) AS share, abs(fine / b.volume - 1) > 0.05::DOUBLE AS mismatch FROM f JOIN b ON b.symbol = f.symbol AND b.ts = f.day""", dates=("day",))
def fine_coarse_check(spark, sf_dir):
    from quantloom.sources.tables import daily_prints

    out = history.cross_check(daily_prints(spark, sf_dir).where("trade_count < 7"), supplier_day_bars(spark, sf_dir).withColumnRenamed("ts", "day"))
    return rounded(out, "symbol", "day", "fine", "coarse", "mismatch", plain=("share",))


_WORDS = ("' TRUE '", "'t'", "'No'", "'1.0'", "'0'", "''", "NULL", "'maybe'", "'on'")


def _boolean_sql(kind: str, default: str) -> str:
    from quantloom.functions.expr import BOOLEANS

    yes, no, numbers = BOOLEANS[kind]
    listed = lambda words: ", ".join(f"'{x}'" for x in words)
    number = lambda v: f" OR TRY_CAST(c AS DOUBLE) = {v}" if numbers else ""
    missing = "c IS NULL" if kind == "setting" else "c IS NULL OR c = ''"
    return f"CASE WHEN {missing} THEN {default} WHEN c IN ({listed(yes)}){number(1)} THEN true WHEN c IN ({listed(no)}){number(0)} THEN false END"


@query("boolean_columns", f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE (l_orderkey + l_linenumber) % 9 {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(_WORDS))} END AS raw FROM lineitem), u AS (SELECT *, lower(trim(raw)) AS c FROM t) SELECT l_orderkey, l_linenumber, l_partkey, {_boolean_sql('setting', 'false')} AS as_setting, {_boolean_sql('flag', 'false')} AS as_flag, {_boolean_sql('feature', 'true')} AS as_feature FROM u")
def boolean_columns(spark, sf_dir):
    """One text read by each law; what a law does not know is NULL."""
    from quantloom.functions.expr import parse_boolean

    raw = F.lit(None).cast("string")
    for k, x in enumerate(_WORDS):
        raw = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 9 == k, F.expr(x).cast("string")).otherwise(raw)
    t = table(spark, sf_dir, "lineitem").withColumn("raw", raw)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", parse_boolean("raw", strict=False).alias("as_setting"), parse_boolean("raw", "flag", strict=False).alias("as_flag"), parse_boolean("raw", "feature", True, strict=False).alias("as_feature"))
