"""Queries on intraday order flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.expr import in_session, session_class, session_part
from quantloom.operators import order_flow as of
from quantloom.operators import quality, resample
from quantloom.plans.base import Registry, rounded, six
from quantloom.sources.tables import INTRADAY_PRINTS, intraday_prints, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
CFG = of.Config()
#: The SQL of the flow_blended_* queries lets their windows run through a whole date; the flow_segment_* queries restart them with each segment.
DAYS = of.Config(whole_days=True)


def _r(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


BARS_SQL = INTRADAY_PRINTS + f""",
ib AS (SELECT symbol, date_key, (second // 1800 * 30)::INTEGER AS minute, first(price ORDER BY second, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY second, event_id) AS close,
         sum(volume) AS volume, sum(volume) AS print_volume, sum(price * volume) AS amount, sum(trade_count)::BIGINT AS trade_count, sum(volume * volume) AS volume_squared, max(volume) AS max_trade,
         sum(CASE WHEN direction = 1 THEN volume ELSE 0 END) AS buy_volume, sum(CASE WHEN direction = -1 THEN volume ELSE 0 END) AS sell_volume, sum(CASE WHEN direction = 0 THEN volume ELSE 0 END) AS neutral_volume,
         sum(CASE WHEN volume >= 300 THEN volume ELSE 0 END) AS large_volume, sum(CASE WHEN volume >= 300 THEN volume * direction ELSE 0 END) AS large_delta0 FROM e GROUP BY 1, 2, 3),
fb AS (SELECT *, buy_volume - sell_volume AS delta, {_r('buy_volume - sell_volume', 'print_volume')} AS delta_ratio, {_r('amount', 'print_volume')} AS vwap, {_r('print_volume', 'volume')} AS coverage,
         {_r('large_delta0', 'large_volume')} AS large_delta_ratio, {_r('large_volume', 'print_volume')} AS large_share, {_r('volume_squared', 'print_volume * print_volume')} AS concentration,
         {_r('close - low', 'high - low')} AS close_location, {_r('2 * close - high - low', 'high - low')} AS clv, {_r('close - open', 'open')} AS bar_return FROM ib)"""


def _base(c: str, kind: str = "median") -> str:
    return f"CASE WHEN count({c}) OVER sp >= 10 THEN {kind}({c}) OVER sp END"


FEAT_SQL = BARS_SQL + f""",
g0 AS (SELECT *, {_r('close - vwap', 'vwap')} AS vwap_distance, {_base('volume')} AS volume_base, {_base('print_volume')} AS print_base, {_base('delta_ratio')} AS delta_base, {_base('delta_ratio', 'stddev_pop')} AS delta_std,
         row_number() OVER sl - 1 AS observations, sum(delta) OVER (PARTITION BY symbol ORDER BY date_key, minute ROWS UNBOUNDED PRECEDING) AS cvd, sum(delta) OVER (PARTITION BY symbol, date_key ORDER BY minute ROWS UNBOUNDED PRECEDING) AS session_cvd
       FROM fb WINDOW sl AS (PARTITION BY symbol, minute ORDER BY date_key), sp AS (PARTITION BY symbol, minute ORDER BY date_key ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
g1 AS (SELECT *, {_r('volume', 'volume_base')} AS relative_volume, {_r('print_volume', 'print_base')} AS relative_prints, {_r('delta_ratio - delta_base', 'delta_std')} AS delta_z, observations >= 10 AND coalesce(volume_base > 0, false) AS ready FROM g0),
g AS (SELECT *, {_r('bar_return', 'relative_volume')} AS impact, abs(bar_return) / greatest(abs(delta_ratio), 1e-9) AS efficiency,
        CASE WHEN delta_ratio >= 0.2 AND bar_return <= -0.001 THEN 1 WHEN delta_ratio <= -0.2 AND bar_return >= 0.001 THEN -1 ELSE 0 END AS divergence,
        coalesce(relative_volume >= 1.5 AND abs(bar_return) <= 0.002 AND delta_ratio <= -0.2 AND close_location >= 0.6, false) AS bullish_absorption,
        coalesce(relative_volume >= 1.5 AND abs(bar_return) <= 0.002 AND delta_ratio >= 0.2 AND close_location <= 0.4, false) AS bearish_absorption FROM g1)"""


def features(spark, sf_dir):
    return of.baseline_features(of.flow_bars(intraday_prints(spark, sf_dir), CFG), CFG)


_BAR = ("delta_ratio", "vwap", "coverage", "large_delta_ratio", "large_share", "concentration")


@query("flow_bars", f"WITH {BARS_SQL} SELECT symbol, date_key, minute, open, high, low, close, volume, trade_count, delta, {six(*_BAR)} FROM fb")
def flow_bars(spark, sf_dir):
    return rounded(of.flow_bars(intraday_prints(spark, sf_dir), CFG), "symbol", "date_key", "minute", "open", "high", "low", "close", "volume", "trade_count", "delta", six=_BAR)


_F1 = ("volume_base", "delta_base", "delta_std", "relative_volume", "relative_prints", "delta_z", "vwap_distance", "impact", "efficiency")


@query("flow_baseline_features", f"WITH {FEAT_SQL} SELECT symbol, date_key, minute, divergence, bullish_absorption, bearish_absorption, cvd, session_cvd, {six(*_F1)} , ready FROM g")
def flow_baseline_features(spark, sf_dir):
    return rounded(features(spark, sf_dir), "symbol", "date_key", "minute", "ready", "divergence", "bullish_absorption", "bearish_absorption", "cvd", "session_cvd", six=_F1)


SIG_SQL = FEAT_SQL + """,
h AS (SELECT *, CASE WHEN ready AND delta_ratio >= 0.2 AND relative_volume >= 1.2 AND close_location >= 0.6 AND bar_return >= 0 AND vwap_distance >= 0 THEN 1
        WHEN ready AND (delta_ratio <= -0.2 AND relative_volume >= 1.2 AND close_location <= 0.4 OR bearish_absorption OR divergence = 1) THEN -1 ELSE 0 END AS signal FROM g)"""


@query("flow_baseline_signals", f"WITH {SIG_SQL} SELECT symbol, date_key, minute, signal FROM h WHERE signal <> 0")
def flow_baseline_signals(spark, sf_dir):
    return of.baseline_signals(features(spark, sf_dir), CFG).where("signal <> 0").select("symbol", "date_key", "minute", "signal")


@query("flow_baseline_summary", f"WITH {SIG_SQL} SELECT symbol, count(*) AS n_bars, count(*) AS n_valid, count(*) FILTER (ready) AS n_ready, count(*) FILTER (signal = 1) AS n_entry, count(*) FILTER (signal = -1) AS n_exit, median(coverage) AS median_coverage FROM h GROUP BY symbol")
def flow_baseline_summary(spark, sf_dir):
    return of.baseline_summary(of.baseline_signals(features(spark, sf_dir), CFG))


def _clip(x: str, a: float, b: float) -> str:
    return f"least(greatest({x}, {a}::DOUBLE), {b}::DOUBLE)"


def _ewm(span: int) -> str:
    a = 2 / (span + 1)
    return f"list_reduce(list(flow) OVER du, lambda m, x: {1 - a!r}::DOUBLE * m + {a!r}::DOUBLE * x)"


def _rank(c: str) -> str:
    h = f"(list({c}) FILTER ({c} IS NOT NULL) OVER d8)"
    return f"CASE WHEN {c} IS NOT NULL AND len({h}) >= 2 THEN (len(list_filter({h}, lambda x: x < {c})) + 0.5::DOUBLE * len(list_filter({h}, lambda x: x = {c}))) / len({h}) END"


def _mean(cols: tuple[str, ...], least: int) -> str:
    n = " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in cols)
    return f"CASE WHEN {n} >= {least} THEN ({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / ({n}) END"


_WIN = "WINDOW d AS (PARTITION BY symbol, date_key ORDER BY minute), du AS (PARTITION BY symbol, date_key ORDER BY minute ROWS UNBOUNDED PRECEDING), d4 AS (PARTITION BY symbol, date_key ORDER BY minute ROWS 3 PRECEDING), d8 AS (PARTITION BY symbol, date_key ORDER BY minute ROWS 7 PRECEDING)"
BLEND_SQL = FEAT_SQL + f""",
v0 AS (SELECT *, {_clip('delta / print_volume', -1, 1)} AS flow FROM g),
v1 AS (SELECT *, {_ewm(3)} AS ema_fast, {_ewm(12)} AS ema_medium, {_ewm(48)} AS ema_slow, sum(delta) OVER d4 AS ds, sum(abs(delta)) OVER d4 AS das, sum(buy_volume) OVER d4 AS bs, sum(sell_volume) OVER d4 AS ss, sum(neutral_volume) OVER d4 AS ns,
         {_r('high - low', 'close')} AS range_pct, lag(close, 4) OVER d AS past, lag(close) OVER d AS c1, sum(flow) OVER d4 AS fs, coalesce(CASE WHEN relative_prints > 0 THEN relative_prints END, print_volume) AS activity0,
         CASE WHEN count(bar_return) OVER d4 >= 3 THEN round(stddev_samp(bar_return) OVER d4, 12) END AS volatility FROM v0 {_WIN}),
v2 AS (SELECT *, (ema_fast + ema_medium + ema_slow) / 3 AS pressure, {_clip('ema_fast - lag(ema_fast) OVER d', -1, 1)} AS acceleration, CASE WHEN das > 0 THEN abs(ds) / das END AS consistency, CASE WHEN bs + ss + ns > 0 THEN das / (bs + ss + ns) END AS toxicity, bs + ss + ns AS tot,
         CASE WHEN count(range_pct) OVER d4 >= 2 THEN median(range_pct) OVER d4 END AS atr_pct, abs(flow) AS flow_size, abs(close - c1) AS move FROM v1 {_WIN}),
v3 AS (SELECT *, {_rank('activity0')} AS activity_rank, {_rank('large_share')} AS large_rank, {_rank('flow_size')} AS pressure_rank, {_rank('toxicity')} AS toxicity_rank, {_rank('concentration')} AS concentration_rank, {_rank('volatility')} AS volatility_rank,
         CASE WHEN tot > 0 THEN -(greatest(bs / tot, 1e-12) * ln(greatest(bs / tot, 1e-12)) + greatest(ss / tot, 1e-12) * ln(greatest(ss / tot, 1e-12)) + greatest(ns / tot, 1e-12) * ln(greatest(ns / tot, 1e-12))) / ln(3) END AS entropy,
         CASE WHEN atr_pct > 1e-8 THEN tanh(bar_return / atr_pct) * sign(pressure) END AS response, sum(move) OVER d4 AS path FROM v2 {_WIN}),
v4 AS (SELECT *, 100 * {_mean(of.STRENGTH, 3)} AS strength, ({' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in of.STRENGTH)}) AS n_strength, {_mean(('activity_rank', 'large_rank', 'toxicity_rank'), 1)} AS force, CASE WHEN response IS NOT NULL THEN 1 - least(abs(response), 1) END AS calm, (clv + 1) / 2 AS location,
         response * (0.5 + 0.5 * consistency) AS execution_quality, CASE WHEN past > 0 AND atr_pct > 0 THEN tanh(((close - past) / past) / (atr_pct * 2)) END AS pn, tanh(fs) AS fn, CASE WHEN path > 0 THEN sign(close - past) * least(abs(close - past) / path, 1) END AS regime_score,
         large_delta_ratio * large_share AS large_flow FROM v3),
v5 AS (SELECT *, greatest(-pressure, 0) * force * calm * (0.5 + 0.5 * location) - greatest(pressure, 0) * force * calm * (1 - 0.5 * location) AS absorption, -sign(pressure) * abs(pressure) * force * {_clip('-acceleration * sign(pressure)', 0, 1)} AS exhaustion0, acceleration IS NOT NULL AS accelerated,
         CASE WHEN coalesce(pn * fn < 0, false) THEN -fn * least(abs(fn), abs(pn)) ELSE 0 END AS divergence_score, pressure * regime_score AS alignment FROM v4),
v AS (SELECT *, CASE WHEN accelerated THEN exhaustion0 END AS exhaustion, CASE WHEN n_strength >= 3 THEN {_mean(of.SCORE, 3)} END AS score,
        CASE WHEN volatility_rank >= 0.8 THEN 'high_volatility' WHEN regime_score >= 0.35 THEN 'trend_up' WHEN regime_score <= -0.35 THEN 'trend_down' ELSE 'range' END AS regime FROM v5)"""
_F2 = ("ema_fast", "ema_slow", "pressure", "consistency", "entropy", "toxicity", "strength", "absorption", "divergence_score", "score")


@query("flow_blended_features", f"WITH {BLEND_SQL} SELECT symbol, date_key, minute, regime, {six(*_F2)} FROM v")
def flow_blended_features(spark, sf_dir):
    return rounded(of.blended_features(features(spark, sf_dir), DAYS), "symbol", "date_key", "minute", "regime", six=_F2)


BLEND_SIG_SQL = BLEND_SQL + """,
x0 AS (SELECT *, score IS NOT NULL AND n_strength >= 3 AND ((coalesce(score >= 0.2, false) OR coalesce(absorption >= 0.2 AND pressure <= 0, false)) AND (coalesce(strength >= 75 AND 100 * pressure >= 30, false) OR coalesce(absorption >= 0.2 AND pressure <= 0, false))) AS en,
         score IS NOT NULL AND n_strength >= 3 AND (coalesce(score <= -0.2, false) OR coalesce(strength >= 75 AND 100 * pressure <= -30, false) OR coalesce(absorption <= -0.2 AND pressure >= 0, false) OR coalesce(exhaustion <= -0.1, false)) AS ex FROM v),
x AS (SELECT *, CASE WHEN sum(en::INTEGER) OVER d2 = 2 THEN 1 WHEN sum(ex::INTEGER) OVER d2 = 2 THEN -1 ELSE 0 END AS signal FROM x0 WINDOW d2 AS (PARTITION BY symbol, date_key ORDER BY minute ROWS 1 PRECEDING))"""


@query("flow_blended_signals", f"WITH {BLEND_SIG_SQL} SELECT symbol, date_key, minute, signal FROM x WHERE signal <> 0")
def flow_blended_signals(spark, sf_dir):
    return of.blended_signals(of.blended_features(features(spark, sf_dir), DAYS), DAYS).where("signal <> 0").select("symbol", "date_key", "minute", "signal")


def _blended_totals(s):
    return rounded(s.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("signal") == 1).alias("n_entry"), F.count_if(F.col("signal") == -1).alias("n_exit"), F.avg("score").alias("mean_score"), F.percentile("score", 0.5).alias("median_score")), "regime", "n", "n_entry", "n_exit", plain=("mean_score", "median_score"))


@query("flow_blended_summary", f"WITH {BLEND_SIG_SQL} SELECT regime, count(*) AS n, count(*) FILTER (signal = 1) AS n_entry, count(*) FILTER (signal = -1) AS n_exit, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score FROM x GROUP BY regime")
def flow_blended_summary(spark, sf_dir):
    return _blended_totals(of.blended_signals(of.blended_features(features(spark, sf_dir), DAYS), DAYS))

def _in_segments(sql: str) -> str:
    """The blended SQL with its windows restarting at half sessions, missing bars and invalid bars."""
    part = "CASE WHEN minute BETWEEN 570 AND 690 THEN 'am' WHEN minute BETWEEN 780 AND 899 THEN 'pm' END"
    ok = "(print_volume > 0 AND high >= low AND low > 0)"
    cut = f"""{FEAT_SQL},
s0 AS (SELECT *, CASE WHEN {part} = lag({part}) OVER d AND minute - lag(minute) OVER d <= 30 AND {ok} AND lag({ok}) OVER d THEN 0 ELSE 1 END AS starts FROM g WINDOW d AS (PARTITION BY symbol, date_key ORDER BY minute)),
s1 AS (SELECT *, sum(starts) OVER (PARTITION BY symbol, date_key ORDER BY minute ROWS UNBOUNDED PRECEDING) AS segment FROM s0)"""
    rest = sql.removeprefix(FEAT_SQL).replace("AS flow FROM g)", "AS flow FROM s1)")
    return cut + rest.replace("PARTITION BY symbol, date_key ORDER BY minute", "PARTITION BY symbol, date_key, segment ORDER BY minute")


SEGMENT_SQL, SEGMENT_SIG_SQL = _in_segments(BLEND_SQL), _in_segments(BLEND_SIG_SQL)


def segment_signals(spark, sf_dir):
    return of.blended_signals(of.blended_features(features(spark, sf_dir), CFG), CFG)


@query("flow_segment_features", f"WITH {SEGMENT_SQL} SELECT symbol, date_key, minute, segment, regime, {six(*_F2)} FROM v")
def flow_segment_features(spark, sf_dir):
    return rounded(of.blended_features(features(spark, sf_dir), CFG), "symbol", "date_key", "minute", "segment", "regime", six=_F2)


@query("flow_segment_signals", f"WITH {SEGMENT_SIG_SQL} SELECT symbol, date_key, minute, signal FROM x WHERE signal <> 0")
def flow_segment_signals(spark, sf_dir):
    return segment_signals(spark, sf_dir).where("signal <> 0").select("symbol", "date_key", "minute", "signal")


@query("flow_segment_summary", f"WITH {SEGMENT_SIG_SQL} SELECT regime, count(*) AS n, count(*) FILTER (signal = 1) AS n_entry, count(*) FILTER (signal = -1) AS n_exit, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score FROM x GROUP BY regime")
def flow_segment_summary(spark, sf_dir):
    return _blended_totals(segment_signals(spark, sf_dir))


_PROXY = ("persistence", "kyle_lambda", "impact_score", "rolling_vwap", "rolling_vwap_distance", "cvd_slope", "price_flow_divergence", "buy_share", "sell_share", "neutral_share", "trade_intensity")
_SEG = "PARTITION BY symbol, date_key, segment ORDER BY minute"
PROXY_SQL = SEGMENT_SQL + f""",
z0 AS (SELECT *, abs(bar_return) / sqrt(print_volume / median(print_volume) OVER d4) AS kyle_lambda, CASE WHEN count(flow) OVER d4 >= 2 THEN avg(sign(flow)) OVER d4 END AS persistence, sum(amount) OVER d4 / sum(print_volume) OVER d4 AS rolling_vwap, sum(abs(flow)) OVER d4 AS fp,
         CASE WHEN count(trade_count) OVER sp >= 2 THEN median(trade_count) OVER sp END AS trade_base FROM v WINDOW d4 AS ({_SEG} ROWS 3 PRECEDING), sp AS (PARTITION BY symbol, minute ORDER BY date_key ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
z1 AS (SELECT *, CASE WHEN count(kyle_lambda) OVER d4 >= 3 THEN median(kyle_lambda) OVER d4 END AS lm, CASE WHEN count(kyle_lambda) OVER d4 >= 3 THEN stddev_samp(kyle_lambda) OVER d4 END AS ls FROM z0 WINDOW d4 AS ({_SEG} ROWS 3 PRECEDING)),
z AS (SELECT * REPLACE (CASE WHEN fp > 0 THEN fs / fp END AS fs), tanh({_clip('CASE WHEN ls > 0 THEN (kyle_lambda - lm) / ls END', -4, 4)} / 2) * sign(pressure) AS impact_score0, ls IS NOT NULL AND ls > 0 AS zed, (close - rolling_vwap) / rolling_vwap AS rolling_vwap_distance, -divergence_score AS price_flow_divergence,
        buy_volume / print_volume AS buy_share, sell_volume / print_volume AS sell_share, neutral_volume / print_volume AS neutral_share, {_r('trade_count', 'trade_base')} AS trade_intensity, minute + 30 >= 900 AND (minute BETWEEN 570 AND 690 OR minute BETWEEN 780 AND 899) AS session_last FROM z1)"""


@query("flow_segment_proxies", f"WITH {PROXY_SQL}, zz AS (SELECT *, fs AS cvd_slope, CASE WHEN zed THEN impact_score0 END AS impact_score FROM z) SELECT symbol, date_key, minute, segment, session_last, {six(*_PROXY)} FROM zz")
def flow_segment_proxies(spark, sf_dir):
    return rounded(of.blended_proxies(of.blended_features(features(spark, sf_dir), CFG), CFG).withColumnRenamed("lambda", "kyle_lambda"), "symbol", "date_key", "minute", "segment", "session_last", six=_PROXY)


@query("daily_score_factor", f"WITH {SEGMENT_SQL} SELECT symbol, date_key, count(score) AS n_scored, round(avg(score), 6) AS score_factor FROM v GROUP BY 1, 2")
def daily_score_factor(spark, sf_dir):
    return rounded(of.daily_score_factor(of.blended_features(features(spark, sf_dir), CFG)), "symbol", "date_key", "n_scored", plain=("score_factor",))


_QUOTES = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS bid1, l_extendedprice * (1 + (l_tax - 0.01::DOUBLE)) AS ask1, CASE WHEN l_orderkey % 5 > 0 THEN l_quantity END AS bid_vol1, CASE WHEN l_orderkey % 3 > 0 THEN l_linenumber::DOUBLE END AS bid_vol2, CASE WHEN l_orderkey % 7 > 0 THEN l_quantity + 1 END AS ask_vol1 FROM lineitem)"""


@query("quote_imbalance", f"""WITH {_QUOTES}, r AS (SELECT *, CASE WHEN bid_vol1 IS NOT NULL OR bid_vol2 IS NOT NULL THEN coalesce(bid_vol1, 0) + coalesce(bid_vol2, 0) END AS b, ask_vol1 AS a, (bid1 + ask1) / 2 AS m FROM q),
t AS (SELECT *, CASE WHEN a + b > 0 THEN (b - a) / (a + b) END AS im, CASE WHEN a + b > 0 AND m > 0 THEN ((ask1 * b + bid1 * a) / (a + b) - m) / m END AS ed FROM r), u AS (SELECT *, coalesce(im IS NOT NULL AND ed IS NOT NULL AND bid1 > 0 AND ask1 >= bid1, false) AS observed FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, bid1, observed, round(CASE WHEN observed THEN im END, 6) + 0.0::DOUBLE AS imbalance, round(CASE WHEN observed THEN ed END, 6) + 0.0::DOUBLE AS microprice_edge FROM u""")
def quote_imbalance(spark, sf_dir):
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    none = F.lit(None).cast("double")
    q = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("bid1"), (F.col("l_extendedprice") * (1 + (F.col("l_tax") - 0.01))).alias("ask1"), F.when(k % 5 > 0, F.col("l_quantity")).alias("bid_vol1"),
        F.when(k % 3 > 0, F.col("l_linenumber").cast("double")).alias("bid_vol2"), F.when(k % 7 > 0, F.col("l_quantity") + 1).alias("ask_vol1"), none.alias("ask_vol2"),
    )
    return rounded(of.quote_proxies(q, 2), "l_orderkey", "l_linenumber", "l_partkey", "bid1", "observed", plain=("imbalance", "microprice_edge"))


def _prank(c: str) -> str:
    h = f"(list({c}) FILTER ({c} IS NOT NULL) OVER sp)"
    return f"CASE WHEN {c} IS NOT NULL AND len({h}) >= 10 THEN CASE WHEN {c} = 0 AND len(list_filter({h}, lambda x: x < 0)) = 0 THEN 0 ELSE (len(list_filter({h}, lambda x: x < {c})) + 0.5::DOUBLE * len(list_filter({h}, lambda x: x = {c}))) / len({h}) END END"


_SP = "WINDOW sp AS (PARTITION BY symbol, minute ORDER BY date_key ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
PART_SQL = FEAT_SQL + f""",
y0 AS (SELECT *, CASE WHEN large_volume = 0 THEN 0 ELSE large_delta_ratio END AS large_delta, amount / trade_count AS average_amount, abs(delta_ratio) AS delta_size, abs(bar_return) AS return_size, abs(vwap_distance) AS vwap_size,
         CASE WHEN minute IS NOT DISTINCT FROM lag(minute) OVER d + 30 THEN 0 ELSE 1 END AS gap FROM g WINDOW d AS (PARTITION BY symbol, date_key ORDER BY minute)),
y1 AS (SELECT *, abs(large_delta) AS large_delta_size, sum(gap) OVER (PARTITION BY symbol, date_key ORDER BY minute ROWS UNBOUNDED PRECEDING) AS run FROM y0),
y2 AS (SELECT *, sum(delta) OVER r3 / sum(print_volume) OVER r3 AS held_delta, {', '.join(f'{_prank(c)} AS {k}' for k, c in of.RANKS.items())} FROM y1 {_SP}, r3 AS (PARTITION BY symbol, date_key, run ORDER BY minute ROWS 2 PRECEDING)),
y3 AS (SELECT *, (volume_rank + count_rank) / 2 AS activity, (amount_rank + share_rank) / 2 AS size, (delta_rank + large_delta_rank) / 2 AS imbalance, {_mean(('delta_ratio', 'large_delta', 'held_delta'), 1)} AS flow_direction,
         {_mean(('(sign(bar_return) * return_rank)', '(sign(vwap_distance) * vwap_rank)', 'clv'), 1)} AS price_direction, {_mean(('sign(bar_return)', 'sign(vwap_distance)', 'clv'), 1)} AS raw FROM y2),
y4 AS (SELECT *, greatest(abs(flow_direction * raw), CASE WHEN bullish_absorption OR bearish_absorption THEN abs(flow_direction) ELSE 0 END) AS control_raw FROM y3),
y5 AS (SELECT *, {_prank('control_raw')} AS control FROM y4 {_SP}),
y6 AS (SELECT *, ready AND activity IS NOT NULL AND size IS NOT NULL AND imbalance IS NOT NULL AND control IS NOT NULL AS eligible FROM y5),
y7 AS (SELECT *, CASE WHEN eligible THEN 25 * (activity + size + imbalance + control) END AS participation_score, CASE WHEN eligible THEN CASE WHEN bearish_absorption THEN -abs(100 * flow_direction) WHEN bullish_absorption THEN abs(100 * flow_direction) ELSE 100 * flow_direction END END AS direction_score FROM y6),
y8 AS (SELECT *, coalesce(participation_score >= 60, false) AS strong FROM y7),
y9 AS (SELECT *, CASE WHEN NOT eligible THEN 'unavailable' WHEN NOT strong THEN 'no_clear_evidence' WHEN bullish_absorption THEN 'passive_buy_absorption' WHEN bearish_absorption THEN 'passive_sell_distribution'
         WHEN 100 * flow_direction >= 30 AND price_direction >= 0 THEN 'active_buy' WHEN 100 * flow_direction <= -30 AND price_direction <= 0 THEN 'active_sell' ELSE 'conflicting_evidence' END AS state,
         CASE WHEN direction_score >= 30 THEN 1 WHEN direction_score <= -30 THEN -1 ELSE 0 END AS side FROM y8),
y AS (SELECT *, coalesce(sum((state IN ('active_buy', 'active_sell', 'passive_buy_absorption', 'passive_sell_distribution') AND side = 1)::INTEGER) OVER r2 = 2 OR sum((state IN ('active_buy', 'active_sell', 'passive_buy_absorption', 'passive_sell_distribution') AND side = -1)::INTEGER) OVER r2 = 2, false) AS confirmed
      FROM y9 WINDOW r2 AS (PARTITION BY symbol, date_key, run ORDER BY minute ROWS 1 PRECEDING))"""
_F3 = ("activity", "size", "imbalance", "control", "participation_score", "direction_score")


def part(spark, sf_dir):
    return of.participation(features(spark, sf_dir), CFG)


@query("participation", f"WITH {PART_SQL} SELECT symbol, date_key, minute, state, side, confirmed, {six(*_F3)} FROM y")
def participation(spark, sf_dir):
    return rounded(part(spark, sf_dir), "symbol", "date_key", "minute", "state", "side", "confirmed", six=_F3)


@query("participation_quality", f"""WITH {PART_SQL}, w AS (SELECT *, (activity IS NOT NULL)::INTEGER + (size IS NOT NULL)::INTEGER + (imbalance IS NOT NULL)::INTEGER + (control IS NOT NULL)::INTEGER AS parts, coalesce({_clip('1 - abs(participation_score - lag(participation_score) OVER r) / 100', 0, 1)}, 0.5) AS st0, lag(participation_score) OVER r AS before FROM y WINDOW r AS (PARTITION BY symbol, date_key, run ORDER BY minute)),
x AS (SELECT *, CASE WHEN participation_score IS NULL OR before IS NULL THEN 0.5::DOUBLE ELSE st0 END AS score_stability FROM w)
SELECT symbol, date_key, minute, round(score_stability, 6) AS score_stability, round(100 * ({_clip('1 - abs(coverage - 1)', 0, 1)} + {_clip('observations / 10.0::DOUBLE', 0, 1)} + parts / 4.0::DOUBLE + score_stability) / 4, 6) AS participation_confidence FROM x""")
def participation_quality(spark, sf_dir):
    return rounded(part(spark, sf_dir), "symbol", "date_key", "minute", plain=("score_stability", "participation_confidence"))


@query("participation_states", f"WITH {PART_SQL} SELECT state, count(*) AS n FROM y GROUP BY state")
def participation_states(spark, sf_dir):
    return part(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "participation_sessions",
    f"""WITH {PART_SQL}, st AS (SELECT symbol, date_key, state, round(sum(participation_score), 6) AS wt FROM y WHERE strong GROUP BY 1, 2, 3), dm AS (SELECT symbol, date_key, first(state ORDER BY wt DESC, state) AS dominant FROM st GROUP BY 1, 2),
ss AS (SELECT symbol, date_key, count(*) AS n_bars, quantile_cont(participation_score, 0.9) AS p90, avg(participation_score) AS mean_score, max(participation_score) AS max_score, sum(participation_score * direction_score) / sum(participation_score) AS direction,
  CASE WHEN count(*) FILTER (eligible) > 0 THEN count(*) FILTER (strong) / (count(*) FILTER (eligible))::DOUBLE END AS strong_share, count(*) FILTER (confirmed) AS n_confirmed FROM y GROUP BY 1, 2)
SELECT symbol, date_key, n_bars, dominant, n_confirmed, {six('p90', 'mean_score', 'max_score', 'direction', 'strong_share')} FROM ss LEFT JOIN dm USING (symbol, date_key)""",
)
def participation_sessions(spark, sf_dir):
    return rounded(of.session_summary(part(spark, sf_dir)), "symbol", "date_key", "n_bars", "dominant", "n_confirmed", six=("p90", "mean_score", "max_score", "direction", "strong_share"))


@query(
    "daily_factors",
    f"""WITH {PART_SQL} SELECT symbol, date_key, round(sum(buy_volume - sell_volume) / sum(print_volume), 6) AS delta_factor, round(quantile_cont(participation_score, 0.9), 6) AS participation_factor FROM y GROUP BY 1, 2""",
)
def daily_factors(spark, sf_dir):
    return rounded(of.daily_factors(part(spark, sf_dir)), "symbol", "date_key", plain=("delta_factor", "participation_factor"))


@query(
    "forward_labels",
    f"""WITH {BARS_SQL}, l0 AS (SELECT *, lead(minute) OVER d AS m1, lead(minute, 3) OVER d AS m3, lead(open) OVER d AS o1, lead(open, 3) OVER d AS o3 FROM ib WINDOW d AS (PARTITION BY symbol, date_key ORDER BY minute)),
l AS (SELECT *, CASE WHEN m1 IS NULL THEN 'no_entry_bar' WHEN m1 <> minute + 30 THEN 'entry_gap' WHEN m3 IS NULL THEN 'no_exit_bar' WHEN m3 <> minute + 90 THEN 'exit_gap' WHEN NOT o1 > 0 THEN 'entry_price' END AS reason FROM l0)
SELECT symbol, date_key, minute, coalesce(reason, '') AS reason, round(CASE WHEN reason IS NULL THEN (o3 - o1) / o1 - 0.0006::DOUBLE END, 6) AS net_return FROM l""",
)
def forward_labels(spark, sf_dir):
    out = of.forward_labels(of.flow_bars(intraday_prints(spark, sf_dir), CFG), 30, 2, 0.0006)
    return rounded(out.withColumn("reason", F.coalesce("reason", F.lit(""))), "symbol", "date_key", "minute", "reason", plain=("net_return",))


# the intraday bars as they are; those of S1 relabelled by their ends; those of S2 without the first bar of each half session, by their ends; of S3 without it, by their starts
_LABELLED = """k0 AS (SELECT symbol, date_key AS day, minute + CASE WHEN symbol IN ('S1', 'S2') THEN 30 ELSE 0 END AS minute FROM ib WHERE NOT (symbol IN ('S2', 'S3') AND minute IN (570, 780)))"""


@query("label_convention", f"""WITH {BARS_SQL}, {_LABELLED}, k AS (SELECT *, CASE WHEN minute >= 570 AND minute <= 690 THEN 1 WHEN minute >= 780 AND minute <= 900 THEN 2 END AS s FROM k0),
f AS (SELECT symbol, day, s, min(minute) AS a, max(minute) AS z, CASE s WHEN 1 THEN 570 ELSE 780 END AS b, CASE s WHEN 1 THEN 690 ELSE 900 END AS e FROM k WHERE s IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT symbol, count(*) FILTER (a = b) AS fv, count(*) FILTER (a = b + 30) AS cv, count(*) FILTER (z = e - 30) AS fl, count(*) FILTER (z = e) AS cl FROM f GROUP BY 1), x AS (SELECT symbol, bool_or(minute IN (570, 780)) AS fb, bool_or(minute IN (600, 810)) AS cb FROM k0 GROUP BY 1)
SELECT symbol, fv AS floor_votes, cv AS ceil_votes, fl AS floor_last, cl AS ceil_last, CASE WHEN cv > fv THEN 'ceil' WHEN fv > cv THEN 'floor' WHEN cb AND NOT fb OR cl > fl AND cl > 0 THEN 'ceil' ELSE 'floor' END AS convention FROM v JOIN x USING (symbol)""")
def label_convention(spark, sf_dir):
    b = of.flow_bars(intraday_prints(spark, sf_dir), CFG).where("NOT (symbol IN ('S2', 'S3') AND minute IN (570, 780))")
    return resample.label_convention(b.select("symbol", F.col("date_key").alias("day"), (F.col("minute") + F.when(F.col("symbol").isin("S1", "S2"), 30).otherwise(0)).alias("minute")), 30)


@query("session_classes", f"WITH {INTRADAY_PRINTS}, t AS (SELECT *, second - 1800 AS s2 FROM e) SELECT CASE WHEN s2 >= 33300 AND s2 < 34200 THEN 'auction' WHEN s2 >= 34200 AND s2 < 41400 OR s2 >= 46800 AND s2 < 54000 THEN 'continuous' WHEN s2 >= 54000 THEN 'after_hours' ELSE 'out' END AS session, CASE WHEN s2 // 60 BETWEEN 570 AND 690 THEN 'am' WHEN s2 // 60 BETWEEN 780 AND 899 THEN 'pm' ELSE 'out' END AS part, count(*) AS n FROM t GROUP BY 1, 2")
def session_classes(spark, sf_dir):
    s = F.col("second") - 1800
    return intraday_prints(spark, sf_dir).groupBy(session_class(s).alias("session"), session_part(F.floor(s / 60)).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("last_sessions", f"WITH {BARS_SQL}, k AS (SELECT symbol, date_key, row_number() OVER (PARTITION BY symbol ORDER BY date_key DESC) AS age FROM (SELECT DISTINCT symbol, date_key FROM ib)) SELECT symbol, date_key, minute, close, age FROM ib JOIN k USING (symbol, date_key) WHERE age <= 5")
def last_sessions(spark, sf_dir):
    return of.last_sessions(of.flow_bars(intraday_prints(spark, sf_dir), CFG), 5).select("symbol", "date_key", "minute", "close", "age")


# every kind of row that can't be used: labels an hour later on some days, gaps, invalid bars, missing and infinite factors, opens of zero
_ODD = """pk AS (SELECT *, date_key * 13 + minute + event_no AS k FROM (SELECT *, ascii(symbol[2]) AS event_no FROM g)),
p0 AS (SELECT symbol, date_key, minute + CASE WHEN date_key % 7 = 0 THEN 60 ELSE 0 END AS minute, k % 19 <> 0 AS valid, ready, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 23 = 0 THEN 'inf'::DOUBLE ELSE delta_ratio END AS factor, CASE WHEN k % 29 = 0 THEN 0 ELSE open END AS open FROM pk WHERE k % 17 <> 0),
p1 AS (SELECT *, CASE WHEN minute BETWEEN 570 AND 690 THEN 'am' WHEN minute BETWEEN 780 AND 899 THEN 'pm' ELSE 'out' END AS part FROM p0),
p2 AS (SELECT *, lead(open) OVER d AS eo, lead(open, 3) OVER d AS xo, lead(minute) OVER d AS em, lead(minute, 3) OVER d AS xm, lag(factor) OVER d AS factor_lag_1, lag(factor, 2) OVER d AS factor_lag_2 FROM p1 WINDOW d AS (PARTITION BY symbol, date_key, part ORDER BY minute)),
p3 AS (SELECT *, coalesce(em = minute + 30 AND xm = minute + 90, false) AS time_aligned, coalesce(eo > 0 AND xo > 0, false) AS price, valid AND ready AND factor IS NOT NULL AND isfinite(factor) AND open > 0 AND part <> 'out' AS feature_eligible FROM p2),
pf AS (SELECT *, time_aligned AND price AS target_available, CASE WHEN part = 'out' THEN 'out_of_session' WHEN NOT valid THEN 'invalid_order_flow_data' WHEN NOT ready THEN 'history_not_ready' WHEN factor IS NULL THEN 'factor_missing' WHEN NOT isfinite(factor) THEN 'factor_non_finite' WHEN NOT open > 0 THEN 'current_open_invalid'
  WHEN em IS NULL OR xm IS NULL THEN 'future_window_missing' WHEN NOT time_aligned THEN 'bar_interval_or_gap' WHEN NOT price THEN 'future_price_invalid' ELSE '' END AS invalid_reason FROM p3)"""
_PRED = ("symbol", "date_key", "minute", "part", "feature_eligible", "time_aligned", "target_available", "eligible", "invalid_reason")
_PRED_SIX = ("future_return", "factor_lag_1", "factor_lag_2")


def prediction_rows(spark, sf_dir):
    k = F.col("date_key") * 13 + F.col("minute") + F.ascii(F.substring("symbol", 2, 1))
    f = features(spark, sf_dir).withColumn("k", k).where("k % 17 <> 0")
    f = f.withColumn("minute", F.col("minute") + F.when(F.col("date_key") % 7 == 0, 60).otherwise(0))
    factor = F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 23 == 0, float("inf")).otherwise(F.col("delta_ratio"))
    f = f.select("symbol", "date_key", "minute", (F.col("k") % 19 != 0).alias("valid"), "ready", factor.alias("factor"), F.when(F.col("k") % 29 == 0, 0.0).otherwise(F.col("open")).alias("open"))
    return of.prediction_frame(f, "factor", 30, horizon=2, lags=(1, 2))


@query("prediction_frame", f"WITH {FEAT_SQL}, {_ODD} SELECT symbol, date_key, minute, part, feature_eligible, time_aligned, target_available, feature_eligible AND target_available AS eligible, invalid_reason, round(CASE WHEN eo <> 0 THEN xo / eo - 1 END + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS future_return, factor_lag_1::VARCHAR = 'inf' AS lag_1_infinite, round(CASE WHEN isfinite(factor_lag_2) THEN factor_lag_2 END + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS factor_lag_2 FROM pf")
def prediction_frame(spark, sf_dir):
    out = prediction_rows(spark, sf_dir).withColumns({"lag_1_infinite": F.col("factor_lag_1") == float("inf"), "factor_lag_2": F.when(F.col("factor_lag_2") != float("inf"), F.col("factor_lag_2"))})
    return rounded(out, *_PRED, "lag_1_infinite", six=("future_return", "factor_lag_2"))


@query("prediction_reasons", f"WITH {FEAT_SQL}, {_ODD} SELECT invalid_reason, count(*) AS n, count(*) FILTER (feature_eligible) AS n_feature_eligible FROM pf GROUP BY 1")
def prediction_reasons(spark, sf_dir):
    return prediction_rows(spark, sf_dir).groupBy("invalid_reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("feature_eligible").alias("n_feature_eligible"))


_QUALITY = ("all_to_daily", "continuous_to_daily", "continuous_to_target")
# prints half an hour early, so that some lie before the session; the target bars miss a slot, the daily bars some prints
_SIDES = """q0 AS (SELECT symbol, date_key AS day, volume AS shares, CASE WHEN second - 1800 >= 33300 AND second - 1800 < 34200 THEN 'auction' WHEN second - 1800 >= 34200 AND second - 1800 < 41400 OR second - 1800 >= 46800 AND second - 1800 < 54000 THEN 'continuous' ELSE 'out' END AS session FROM e),
qs AS (SELECT symbol, day, count(*) AS transaction_rows, sum(shares) AS shares_all, coalesce(sum(shares) FILTER (session = 'continuous'), 0) AS shares_continuous FROM q0 GROUP BY 1, 2), qt AS (SELECT symbol, date_key AS day, sum(volume) AS target_shares FROM ib WHERE minute <> 570 GROUP BY 1, 2), qd AS (SELECT symbol, date_key AS day, sum(volume) AS daily_shares FROM e WHERE event_id % 13 > 0 GROUP BY 1, 2),
q1 AS (SELECT qs.*, coalesce(target_shares, 0) AS target_shares, daily_shares, shares_all - shares_continuous AS excluded_shares, CASE WHEN daily_shares > 0 THEN shares_all / daily_shares END AS all_to_daily, CASE WHEN daily_shares > 0 THEN shares_continuous / daily_shares END AS continuous_to_daily, CASE WHEN target_shares > 0 THEN shares_continuous / target_shares END AS continuous_to_target FROM qs LEFT JOIN qt USING (symbol, day) LEFT JOIN qd USING (symbol, day))"""


@query("print_quality", f"WITH {BARS_SQL}, {_SIDES} SELECT symbol, day, transaction_rows, shares_all, shares_continuous, excluded_shares, target_shares, daily_shares, {six(*_QUALITY)}, CASE WHEN abs(all_to_daily - 1) > 0.05::DOUBLE AND abs(continuous_to_target - 1) > 0.05::DOUBLE THEN 'all_differ_from_daily_bar|continuous_differ_from_target_bars' WHEN abs(all_to_daily - 1) > 0.05::DOUBLE THEN 'all_differ_from_daily_bar' WHEN abs(continuous_to_target - 1) > 0.05::DOUBLE THEN 'continuous_differ_from_target_bars' ELSE '' END AS warnings FROM q1")
def print_quality(spark, sf_dir):
    """Prints, target bars and daily bars side by side, day by day."""
    p = intraday_prints(spark, sf_dir)
    prints = p.select("symbol", F.col("date_key").alias("day"), session_class(F.col("second") - 1800).alias("session"), F.col("volume").alias("shares"))
    target = of.flow_bars(p, CFG).where("minute <> 570").select("symbol", F.col("date_key").alias("day"), "volume")
    out = quality.print_quality(prints, target, p.where("event_id % 13 > 0").select("symbol", F.col("date_key").alias("day"), "volume"))
    return rounded(out.withColumn("warnings", F.array_join("warnings", "|")), "symbol", "day", "transaction_rows", "shares_all", "shares_continuous", "excluded_shares", "target_shares", "daily_shares", "warnings", six=_QUALITY)


@query("flag_histogram", "SELECT l_linenumber AS flag, count(*) AS n, l_linenumber IN (0, 1, 2) AS known FROM lineitem GROUP BY 1")
def flag_histogram(spark, sf_dir):
    return quality.flag_histogram(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("flag")), (0, 1, 2))


_CONFIDENCE = f"""w0 AS (SELECT *, (activity IS NOT NULL)::INTEGER + (size IS NOT NULL)::INTEGER + (imbalance IS NOT NULL)::INTEGER + (control IS NOT NULL)::INTEGER AS parts, lag(participation_score) OVER r AS before FROM y WINDOW r AS (PARTITION BY symbol, date_key, run ORDER BY minute)),
w1 AS (SELECT *, CASE WHEN participation_score IS NULL OR before IS NULL THEN 0.5::DOUBLE ELSE {_clip('1 - abs(participation_score - before) / 100', 0, 1)} END AS stable FROM w0),
w2 AS (SELECT *, 100 * ({_clip('1 - abs(coverage - 1)', 0, 1)} + {_clip('observations / 10.0::DOUBLE', 0, 1)} + parts / 4.0::DOUBLE + stable) / 4 AS participation_confidence FROM w1)"""
_REPORT = ("p90", "mean_score", "peak_score", "direction", "latest_score", "latest_direction", "latest_confidence", "strong_share", "confirmed_share", "confirmed_buy_share", "confirmed_sell_share", "confidence")


@query(
    "participation_session_report",
    f"""WITH {PART_SQL}, {_CONFIDENCE}, st AS (SELECT symbol, date_key, state, round(sum(participation_score), 6) AS wt FROM w2 WHERE strong GROUP BY 1, 2, 3), dm AS (SELECT symbol, date_key, first(state ORDER BY wt DESC, state) AS dominant FROM st GROUP BY 1, 2),
vb AS (SELECT symbol, date_key, count(*) AS valid_bars, quantile_cont(participation_score, 0.9) AS p90, avg(participation_score) AS mean_score, max(participation_score) AS peak_score, CASE WHEN sum(participation_score) FILTER (direction_score IS NOT NULL) > 0 THEN sum(participation_score * direction_score) / sum(participation_score) FILTER (direction_score IS NOT NULL) ELSE avg(direction_score) END AS direction,
  arg_max(participation_score, minute) AS latest_score, arg_max(direction_score, minute) AS latest_direction, arg_max(state, minute) AS latest_state, arg_max(confirmed, minute) AS latest_confirmed, arg_max(participation_confidence, minute) AS latest_confidence, avg(strong::INTEGER) AS strong_share, avg(confirmed::INTEGER) AS confirmed_share,
  avg((confirmed AND side = 1)::INTEGER) AS confirmed_buy_share, avg((confirmed AND side = -1)::INTEGER) AS confirmed_sell_share, median(participation_confidence) AS confidence FROM w2 WHERE participation_score IS NOT NULL GROUP BY 1, 2),
tb AS (SELECT symbol, date_key, count(*) AS total_bars, max(minute) AS last_minute FROM w2 GROUP BY 1, 2)
SELECT symbol, date_key, total_bars, last_minute, coalesce(valid_bars, 0) AS valid_bars, coalesce(latest_state, 'unavailable') AS latest_state, coalesce(latest_confirmed, false) AS latest_confirmed, CASE WHEN valid_bars IS NULL THEN 'unavailable' ELSE coalesce(dominant, 'no_clear_evidence') END AS dominant,
  CASE WHEN confirmed_buy_share > 0 AND confirmed_sell_share > 0 THEN 'mixed' WHEN confirmed_buy_share > 0 THEN 'buy' WHEN confirmed_sell_share > 0 THEN 'sell' ELSE 'none' END AS confirmed_direction, {six(*_REPORT)} FROM tb LEFT JOIN vb USING (symbol, date_key) LEFT JOIN dm USING (symbol, date_key)""",
)
def participation_session_report(spark, sf_dir):
    """All that is said of a session, also where no bar could be scored."""
    return rounded(of.session_report(part(spark, sf_dir)), "symbol", "date_key", "total_bars", "last_minute", "valid_bars", "latest_state", "latest_confirmed", "dominant", "confirmed_direction", six=_REPORT)


@query("session_mask", f"WITH {BARS_SQL} SELECT symbol, date_key, minute, minute >= 570 AND minute < 690 OR minute >= 780 AND minute < 900 AS by_start, minute + 30 > 570 AND minute + 30 <= 690 OR minute + 30 > 780 AND minute + 30 <= 900 AS by_end, minute > 570 AND minute <= 690 OR minute > 780 AND minute <= 900 AS misread FROM ib")
def session_mask(spark, sf_dir):
    """Bars in a session by their labels: starts, ends, and starts taken for ends."""
    b = of.flow_bars(intraday_prints(spark, sf_dir), CFG)
    return b.select("symbol", "date_key", "minute", in_session("minute", False).alias("by_start"), in_session(F.col("minute") + 30, True).alias("by_end"), in_session("minute", True).alias("misread"))


@query("simulator_frame", f"WITH {FEAT_SQL}, {_ODD} SELECT symbol, date_key, minute, valid, ready, factor, factor_lag_1, open FROM pf WHERE factor IS NOT NULL AND isfinite(factor) AND factor_lag_1 IS NOT NULL AND isfinite(factor_lag_1)")
def simulator_frame(spark, sf_dir):
    """What a simulation may see of the prediction frame: rows whose features are all there, without anything that came later."""
    out = quality.without_labels(prediction_rows(spark, sf_dir).where(quality.complete(["factor", "factor_lag_1"])))
    return out.select([c for c in out.columns if c not in ("part", "factor_lag_2")])
