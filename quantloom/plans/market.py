"""Queries on bars: resampling, adjustment, volume-spread analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import resample, vsa
from quantloom.plans.base import Registry, rounded, six
from quantloom.sources.tables import DAILY_PRINTS, MONTH_BARS, SUPPLIER_DAY_BARS, daily_prints, month_bars, supplier_day_bars

CFG = vsa.Config(window=10)
query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

VSA_SQL = MONTH_BARS + """,
f0 AS (SELECT *, high - low AS spread, lag(close) OVER s AS prior_close,
         CASE WHEN count(volume) OVER p10 >= 10 THEN median(volume) OVER p10 END AS volume_base, CASE WHEN count(*) OVER p10 >= 10 THEN median(high - low) OVER p10 END AS spread_base,
         CASE WHEN count(*) OVER p10 >= 10 THEN max(high) OVER p10 END AS prior_high, CASE WHEN count(*) OVER p10 >= 10 THEN min(low) OVER p10 END AS prior_low,
         CASE WHEN count(*) OVER p10 >= 10 THEN avg(close) OVER p10 END AS close_base
       FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts), p10 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN spread > 0 THEN (close - low) / spread END AS close_location, CASE WHEN spread > 0 THEN (2 * close - high - low) / spread END AS clv,
        CASE WHEN volume_base > 0 THEN volume / volume_base END AS volume_ratio, CASE WHEN spread_base > 0 THEN spread / spread_base END AS spread_ratio,
        CASE WHEN prior_high - prior_low > 0 THEN (close - prior_low) / (prior_high - prior_low) END AS range_position,
        CASE WHEN close_base > 0 THEN (prior_close - close_base) / close_base END AS trend_return, CASE WHEN prior_close > 0 THEN (close - prior_close) / prior_close END AS bar_return,
        volume_base IS NOT NULL AS ready FROM f0)"""
SIGNAL_SQL = VSA_SQL + """,
c AS (SELECT *, CASE
    WHEN NOT ready THEN NULL
    WHEN close < open AND spread_ratio <= 0.8 AND volume_ratio <= 0.8 AND close_location >= 0.7 AND (range_position <= 0.25 OR low <= prior_low) THEN 'test'
    WHEN close < open AND spread_ratio >= 1.5 AND volume_ratio >= 1.5 AND NOT coalesce(close_location <= 0.3, false) AND (range_position <= 0.25 OR low <= prior_low) THEN 'stopping_volume'
    WHEN close > open AND spread_ratio >= 1.5 AND volume_ratio >= 1.5 AND close_location <= 0.3 AND (range_position >= 0.75 OR high >= prior_high) THEN 'upthrust'
    WHEN close > open AND spread_ratio <= 0.8 AND volume_ratio <= 0.8 AND NOT coalesce(close_location <= 0.3, false) AND trend_return >= 0 THEN 'no_demand'
    WHEN close < open AND spread_ratio <= 0.8 AND volume_ratio <= 0.8 AND NOT coalesce(close_location <= 0.3, false) AND trend_return <= 0 THEN 'no_supply' END AS candidate FROM f),
k AS (SELECT *, coalesce(CASE candidate WHEN 'test' THEN 3 WHEN 'stopping_volume' THEN 2 WHEN 'upthrust' THEN -2 WHEN 'no_demand' THEN -1 WHEN 'no_supply' THEN 1 END, 0) AS candidate_code,
        lead(ts) OVER s AS n_ts, lead(close) OVER s AS n_close, lead(open) OVER s AS n_open, lead(clv) OVER s AS n_clv FROM c WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
t AS (SELECT *, CASE WHEN candidate_code = 0 THEN NULL WHEN n_ts IS NULL THEN 'pending'
    WHEN candidate_code > 0 AND n_close > close AND n_close > n_open AND n_clv >= 0 OR candidate_code < 0 AND n_close < close AND n_close < n_open AND n_clv <= 0 THEN 'confirmed'
    WHEN candidate_code > 0 AND n_close < low OR candidate_code < 0 AND n_close > high THEN 'invalidated' ELSE 'expired' END AS status FROM k),
g AS (SELECT *, CASE WHEN lag(status) OVER s = 'confirmed' THEN CASE WHEN lag(candidate_code) OVER s > 0 THEN 1 ELSE -1 END ELSE 0 END AS signal,
        CASE WHEN lag(status) OVER s = 'confirmed' AND lag(candidate_code) OVER s > 0 THEN lag(low) OVER s * (1 - 0.003::DOUBLE) END AS stop FROM t WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""


@query("vsa_ready_bars", f"WITH {VSA_SQL} SELECT symbol, ts, {six('close_location', 'clv', 'volume_ratio', 'spread_ratio', 'range_position', 'trend_return', 'bar_return')} FROM f WHERE ready", dates=("ts",))
def vsa_ready(spark, sf_dir):
    f = vsa.features(month_bars(spark, sf_dir), CFG).where("ready AND valid")
    return rounded(f, "symbol", "ts", six=("close_location", "clv", "volume_ratio", "spread_ratio", "range_position", "trend_return", "bar_return"))


_SHAPES = ("body_ratio", "upper_wick_ratio", "lower_wick_ratio", "close_location", "gap_return", "bar_return", "trend_return", "volume_ratio")


@query("vsa_bar_shapes", f"""WITH {VSA_SQL}, q AS (SELECT *, CASE WHEN spread > 0 THEN abs(close - open) / spread END AS body_ratio, CASE WHEN spread > 0 THEN (high - greatest(open, close)) / spread END AS upper_wick_ratio, CASE WHEN spread > 0 THEN (least(open, close) - low) / spread END AS lower_wick_ratio, CASE WHEN prior_close > 0 THEN (open - prior_close) / prior_close END AS gap_return FROM f)
SELECT symbol, ts, ready AND spread_base IS NOT NULL AS ready, spread, {six(*_SHAPES)} FROM q""", dates=("ts",))
def vsa_bar_shapes(spark, sf_dir):
    """Every bar's shape, also before there is a baseline."""
    return rounded(vsa.features(month_bars(spark, sf_dir), CFG), "symbol", "ts", "ready", "spread", six=_SHAPES)


@query("bars_month", f"WITH {MONTH_BARS} SELECT * FROM b", dates=("ts",))
def bars_month(spark, sf_dir):
    return month_bars(spark, sf_dir)


@query("vsa_signals", f"WITH {SIGNAL_SQL} SELECT symbol, ts, candidate, candidate_code, status, signal, round(stop, 6) AS stop, round(CASE WHEN close - stop > 0 THEN close + 2 * (close - stop) END, 6) AS target FROM g WHERE candidate_code <> 0 OR signal <> 0", dates=("ts",))
def vsa_signals(spark, sf_dir):
    s = vsa.signals(vsa.features(month_bars(spark, sf_dir), CFG), CFG).where("candidate_code <> 0 OR signal <> 0")
    return rounded(s, "symbol", "ts", "candidate", "candidate_code", "status", "signal", plain=("stop", "target"))


@query(
    "vsa_event_counts",
    f"""WITH {SIGNAL_SQL} SELECT x.candidate, y.status, (SELECT count(*) FROM t WHERE t.candidate = x.candidate AND t.status = y.status) AS n
FROM (VALUES ('test'), ('stopping_volume'), ('upthrust'), ('no_demand'), ('no_supply')) x(candidate), (VALUES ('confirmed'), ('invalidated'), ('invalidated_data'), ('expired'), ('pending')) y(status)""",
)
def vsa_event_counts(spark, sf_dir):
    return vsa.event_counts(vsa.signals(vsa.features(month_bars(spark, sf_dir), CFG), CFG))


def _by_side(name: str, of: str, test: str = "true") -> str:
    return ", ".join(f"coalesce(sum({of}) FILTER ({test} AND direction = {k}), 0) AS {name.format(side)}" for side, k in (("buy", 1), ("sell", -1), ("neutral", 0)))


FLOW_SQL = DAILY_PRINTS + f""",
t AS (SELECT symbol, date_trunc('month', day)::DATE AS ts, {_by_side('{}_volume', 'volume')}, {_by_side('{}_amount', 'price * volume')}, {_by_side('{}_trades', 'trade_count')}, {_by_side('large_{}', 'volume', 'volume >= 40')},
        sum(volume) AS print_volume, sum(price * volume) AS amount, sum(trade_count) AS trade_count, count(*) AS transaction_rows, sum(volume * volume) AS volume_squared, max(volume) AS max_trade,
        coalesce(sum(volume) FILTER (volume >= 40), 0) AS large_volume, count(*) FILTER (volume >= 40) AS large_rows
      FROM p WHERE flag <> 'N' GROUP BY 1, 2),
bf AS (SELECT * FROM (SELECT symbol, date_trunc('month', day)::DATE AS ts, sum(volume) AS volume FROM p GROUP BY 1, 2) LEFT JOIN t USING (symbol, ts))"""


@query(
    "bars_with_flow",
    f"""WITH {FLOW_SQL}
SELECT symbol, ts, print_volume IS NOT NULL AS observed, trade_count::DOUBLE AS trade_count, buy_volume, sell_volume, buy_volume - sell_volume AS delta,
  round(CASE WHEN print_volume > 0 THEN (buy_volume - sell_volume) / print_volume END, 6) AS delta_ratio, round(CASE WHEN print_volume > 0 THEN amount / print_volume END, 6) AS vwap,
  round(CASE WHEN volume > 0 THEN print_volume / volume END, 6) AS coverage, round(CASE WHEN large_volume > 0 THEN (large_buy - large_sell) / large_volume END, 6) AS large_delta_ratio,
  round(CASE WHEN print_volume > 0 THEN volume_squared / (print_volume * print_volume) END, 6) AS concentration, round(CASE WHEN print_volume > 0 THEN max_trade / print_volume END, 6) AS max_share
FROM bf""", dates=("ts",))
def bars_with_flow(spark, sf_dir):
    return rounded(_bars_with_flow(spark, sf_dir).withColumn("trade_count", F.col("trade_count").cast("double")), "symbol", "ts", "observed", "trade_count", "buy_volume", "sell_volume", "delta", plain=("delta_ratio", "vwap", "coverage", "large_delta_ratio", "concentration", "max_share"))


def _bars_with_flow(spark, sf_dir):
    p = daily_prints(spark, sf_dir).withColumn("ts", F.trunc("day", "month"))
    bars = p.groupBy("symbol", "ts").agg(F.sum("volume").alias("volume"))
    return resample.join_flow(bars, resample.flow(p.where("flag <> 'N'"), ["symbol", "ts"], 40), ["symbol", "ts"])


_TOTALS = ("buy_volume", "sell_volume", "neutral_volume", "print_volume", "buy_amount", "sell_amount", "neutral_amount", "amount", "volume_squared", "max_trade", "large_volume", "large_buy", "large_sell", "large_neutral")
_COUNTS = ("trade_count", "transaction_rows", "buy_trades", "sell_trades", "neutral_trades", "large_rows")


@query("print_totals", f"""WITH {FLOW_SQL} SELECT symbol, ts, {', '.join(_TOTALS)}, {', '.join(f'{c}::BIGINT AS {c}' for c in _COUNTS)}, volume - print_volume AS volume_gap, large_buy - large_sell AS large_delta, round(CASE WHEN trade_count > 0 THEN print_volume / trade_count END, 6) AS average_size,
  round(CASE WHEN trade_count > 0 THEN amount / trade_count END, 6) AS average_amount, round(CASE WHEN trade_count > 0 THEN buy_trades / trade_count END, 6) AS buy_trade_share, round(CASE WHEN trade_count > 0 THEN sell_trades / trade_count END, 6) AS sell_trade_share FROM bf""", dates=("ts",))
def print_totals(spark, sf_dir):
    """All twenty totals of each bar's prints, and sizes and shares by number of trades."""
    return rounded(_bars_with_flow(spark, sf_dir), "symbol", "ts", *_TOTALS, *[F.col(c).cast("bigint").alias(c) for c in _COUNTS], "volume_gap", "large_delta", plain=("average_size", "average_amount", "buy_trade_share", "sell_trade_share"))


def _roll_sql(key: str, base: str = "prev_close") -> str:
    return f"""WITH {SUPPLIER_DAY_BARS}, r AS (SELECT symbol, {key} AS period, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, sum(amount) AS amount FROM b GROUP BY 1, 2),
q AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY period) AS prev_close FROM r)
SELECT symbol, period, ts, open, high, low, close, volume, amount, close - {base} AS change, round(CASE WHEN {base} > 0 THEN 100 * ((close - {base}) / {base}) END, 6) AS pct_change, round(CASE WHEN prev_close > 0 THEN 100 * ((high - low) / prev_close) END, 6) AS amplitude FROM q"""


def _roll(period: str):
    def run(spark, sf_dir):
        out = resample.roll_up(supplier_day_bars(spark, sf_dir), period, complete_sums=period == "iso")
        return rounded(out, "symbol", "period", "ts", "open", "high", "low", "close", "volume", "amount", "change", plain=("pct_change", "amplitude"))

    return run


query("roll_up_week_friday", _roll_sql("(date_trunc('week', ts + 2)::DATE + 4)"), dates=("period", "ts"))(_roll("friday"))
query("roll_up_week_iso", _roll_sql("date_trunc('week', ts)::DATE", "open"), dates=("period", "ts"))(_roll("iso"))
query("roll_up_month", _roll_sql("date_trunc('month', ts)::DATE"), dates=("period", "ts"))(_roll("month"))


def _adjust(kind: str):
    def run(spark, sf_dir):
        b = month_bars(spark, sf_dir).withColumn("factor", 1 + F.month("ts") / 64.0)
        return rounded(resample.adjusted(b, kind), "symbol", "ts", plain=("open", "close", "pct_change"))

    return run


for _kind, _scale in (("hfq", "factor"), ("qfq", "factor / latest")):
    query(
        f"adjusted_{_kind}",
        f"""WITH {MONTH_BARS}, a AS (SELECT *, 1 + month(ts) / 64.0::DOUBLE AS factor FROM b), l AS (SELECT symbol, arg_max(factor, ts) AS latest FROM a GROUP BY 1),
x AS (SELECT symbol, ts, open * ({_scale}) AS open, close * ({_scale}) AS close FROM a JOIN l USING (symbol)), y AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM x)
SELECT symbol, ts, round(open, 6) AS open, round(close, 6) AS close, round(CASE WHEN pc > 0 THEN 100 * ((close - pc) / pc) END, 6) AS pct_change FROM y""",
        dates=("ts",),
    )(_adjust(_kind))


@query("period_summary", f"WITH {MONTH_BARS} SELECT symbol, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts, min(low) AS low, max(high) AS high, round(100 * ((arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts)), 6) AS pct_change FROM b GROUP BY symbol", dates=("first_ts", "last_ts"))
def period_summary(spark, sf_dir):
    return rounded(resample.period_summary(month_bars(spark, sf_dir)), "symbol", "n_bars", "first_ts", "last_ts", "low", "high", plain=("pct_change",))


@query(
    "preceding_row_scan",
    f"""WITH {MONTH_BARS}, r AS (SELECT * FROM b WHERE ts BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'), o AS (SELECT symbol, max(ts) AS ts FROM b WHERE ts < DATE '1998-01-01' GROUP BY 1)
SELECT symbol, ts, close FROM r UNION ALL SELECT symbol, ts, close FROM b JOIN o USING (symbol, ts)""", dates=("ts",))
def preceding_row_scan(spark, sf_dir):
    """A date range with the one row of each symbol just before it."""
    b = month_bars(spark, sf_dir).select("symbol", "ts", "close")
    before = b.where("ts < DATE '1998-01-01'").groupBy("symbol").agg(F.max_by(F.struct("ts", "close"), "ts").alias("r")).select("symbol", "r.*")
    return b.where("ts BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'").unionByName(before)
