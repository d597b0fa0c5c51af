"""Queries on the panel of suppliers and months: indicators, features, labels, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.operators import daily, technical
from quantloom.plans.base import Registry, rounded, six
from quantloom.sources.tables import MONTH_BARS, SUPPLIER_DAY_BARS, month_bars, supplier_day_bars

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

def _last(n: int, f: str) -> str:
    return f"{f} OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


def _prior(n: int, f: str) -> str:
    return f"{f} OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _trend_sql(a: str, b: str, c: str) -> str:
    return f"CASE WHEN close > {a} AND {a} > {b} AND ({c} IS NULL OR close > {c}) THEN 'uptrend' WHEN close < {a} AND {a} < {b} AND ({c} IS NULL OR close < {c}) THEN 'downtrend' WHEN close > {a} THEN 'recovering' WHEN close < {a} THEN 'weakening' ELSE 'range_or_transition' END"


# the weekly side keeps lists of the closes, highs and lows of the weeks before and appends the current one
IND_SQL = SUPPLIER_DAY_BARS + f""",
i0 AS (SELECT *, lag(close) OVER s AS prev, row_number() OVER s AS n, lag(close, 5) OVER s AS c5, lag(close, 20) OVER s AS c20, date_trunc('week', ts)::DATE AS week FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
i1 AS (SELECT *, greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr, {', '.join(f"CASE WHEN n >= {k} THEN round({_last(k, 'avg(close)')}, 4) END AS sma{k}" for k in (20, 50, 200))} FROM i0),
i2 AS (SELECT *, CASE WHEN n > 14 THEN {_last(14, 'avg(greatest(close - prev, 0))')} END AS up, CASE WHEN n > 14 THEN {_last(14, 'avg(greatest(prev - close, 0))')} END AS down,
         CASE WHEN n >= 14 THEN round({_last(14, 'avg(tr)')}, 4) END AS atr, round({_prior(20, 'avg(volume)')}, 4) AS vbase, round({_last(20, 'avg(volume)')}, 4) AS volume_average,
         {_last(60, 'max(high)')} AS top60, {_last(60, 'min(low)')} AS support_lower, {_last(60, 'max(close)')} AS peak, {_last(20, 'max(high)')} AS resistance_upper,
         CASE WHEN n > 20 THEN {_prior(20, 'max(high)')} END AS prior_high, CASE WHEN n > 20 THEN {_prior(20, 'min(low)')} END AS prior_low, lag(sma20, 5) OVER (PARTITION BY symbol ORDER BY ts) AS sma20_before,
         max(high) OVER (PARTITION BY symbol, week ORDER BY ts) AS wh0, min(low) OVER (PARTITION BY symbol, week ORDER BY ts) AS wl0 FROM i1),
wk AS (SELECT symbol, week, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM i0 GROUP BY 1, 2),
wl AS (SELECT symbol, week, row_number() OVER (PARTITION BY symbol ORDER BY week) AS weeks, list(c) OVER q AS cs, list(h) OVER q AS hs, list(l) OVER q AS ls FROM wk WINDOW q AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
x0 AS (SELECT i2.*, weeks, list_append(coalesce(cs, []), close) AS wc, list_append(coalesce(hs, []), wh0) AS wh, list_append(coalesce(ls, []), wl0) AS wlow FROM i2 JOIN wl USING (symbol, week)),
x1 AS (SELECT *, {', '.join(f"CASE WHEN len(wc) >= {k} THEN round(list_avg(wc[-{k}:]), 4) END AS week_sma{k}" for k in (10, 20, 40))},
         CASE WHEN len(wc) >= 24 THEN round(list_avg(wc[-24:-5]), 4) END AS far, CASE WHEN len(wc) > 14 THEN list_sum(list_transform(range(1, 15), lambda k: greatest(wc[-k] - wc[-k - 1], 0))) / 14 END AS wup,
         CASE WHEN len(wc) > 14 THEN list_sum(list_transform(range(1, 15), lambda k: greatest(wc[-k - 1] - wc[-k], 0))) / 14 END AS wdown,
         CASE WHEN len(wc) >= 14 THEN round(list_sum(list_transform(range(1, 15), lambda k: greatest(wh[-k] - wlow[-k], coalesce(abs(wh[-k] - wc[-k - 1]), 0), coalesce(abs(wlow[-k] - wc[-k - 1]), 0)))) / 14, 4) END AS week_atr,
         list_max(wh[-20:]) AS wtop, list_min(wlow[-20:]) AS wfloor FROM x0),
i AS (SELECT *, round((close / c5 - 1) * 100, 2) AS return_5, round((close / c20 - 1) * 100, 2) AS return_20, round(sma20 - sma20_before, 4) AS slope, CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END ELSE round(100 - 100 / (1 + up / down), 2) END AS rsi,
        CASE WHEN atr <> 0 THEN round(atr / close * 100, 2) END AS atr_pct, CASE WHEN vbase > 0 THEN round(volume / vbase, 3) END AS volume_ratio, CASE WHEN top60 > support_lower THEN round((close - support_lower) / (top60 - support_lower) * 100, 2) END AS position, round((close / peak - 1) * 100, 2) AS drawdown,
        {_trend_sql('sma20', 'sma50', 'sma200')} AS trend, {_trend_sql('week_sma10', 'week_sma20', 'week_sma40')} AS week_trend, round(support_lower + greatest(coalesce(atr, 0) * 0.5::DOUBLE, close * 0.005::DOUBLE), 4) AS support_upper, round(resistance_upper - greatest(coalesce(atr, 0) * 0.5::DOUBLE, close * 0.005::DOUBLE), 4) AS resistance_lower,
        CASE WHEN close > prior_high THEN 'up' WHEN close < prior_low THEN 'down' ELSE 'none' END AS direction, round((close / wc[-5] - 1) * 100, 2) AS week_return_4, round((close / wc[-13] - 1) * 100, 2) AS week_return_12, round(week_sma20 - far, 4) AS week_slope,
        CASE WHEN wdown = 0 THEN CASE WHEN wup > 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END ELSE round(100 - 100 / (1 + wup / wdown), 2) END AS week_rsi, CASE WHEN wtop > wfloor THEN round((close - wfloor) / (wtop - wfloor) * 100, 2) END AS week_position FROM x1),
o0 AS (SELECT *, CASE WHEN n <= 20 THEN 'insufficient_data' WHEN direction = 'none' THEN 'none' WHEN volume_ratio >= 1.2::DOUBLE THEN 'confirmed' ELSE 'needs_volume_confirmation' END AS breakout, CASE WHEN atr <> 0 THEN atr ELSE greatest(close * 0.03::DOUBLE, 0.01::DOUBLE) END AS u FROM i),
o1 AS (SELECT *, CASE WHEN direction = 'up' THEN close WHEN resistance_upper <= close THEN close + u ELSE resistance_upper END AS trigger FROM o0),
o2 AS (SELECT *, CASE WHEN support_lower < trigger THEN greatest(0.01::DOUBLE, close - u * 1.5::DOUBLE, least(support_lower, trigger - 0.01::DOUBLE)) ELSE greatest(0.01::DOUBLE, close - u * 1.5::DOUBLE) END AS s0 FROM o1),
o3 AS (SELECT *, CASE WHEN s0 >= trigger THEN greatest(0.01::DOUBLE, trigger - greatest(u, trigger * 0.03::DOUBLE)) ELSE s0 END AS stop FROM o2),
o AS (SELECT * REPLACE (round(trigger, 4) AS trigger, round(stop, 4) AS stop), round(trigger + 2 * greatest(trigger - stop, 0.01::DOUBLE), 4) AS target, round((trigger + 2 * greatest(trigger - stop, 0.01::DOUBLE) - trigger) / greatest(trigger - stop, 0.01::DOUBLE), 2) AS risk_reward,
        CASE WHEN direction = 'up' AND breakout = 'confirmed' THEN 'bullish' WHEN week_trend = 'downtrend' AND trend IN ('downtrend', 'weakening') THEN 'bearish' ELSE 'neutral' END AS stance,
        CASE WHEN direction = 'up' AND breakout = 'confirmed' THEN 'volume_breakout' WHEN week_trend = 'downtrend' AND trend IN ('downtrend', 'weakening') THEN 'both_timeframes_weak' WHEN rsi >= 75 THEN 'overheated' ELSE 'unfinished' END AS headline,
        CASE WHEN direction = 'up' THEN 'breakout_wait_for_retest' WHEN week_trend = 'downtrend' OR trend = 'downtrend' THEN 'long_setup_suspended' ELSE 'wait_for_volume_breakout' END AS setup FROM o3)"""


def _outlook(spark, sf_dir):
    return technical.outlook(supplier_day_bars(spark, sf_dir))


_IND = ("return_5", "return_20", "sma20", "sma50", "sma200", "slope", "rsi", "atr", "atr_pct", "volume_average", "volume_ratio", "position", "drawdown", "support_lower", "support_upper", "resistance_lower", "resistance_upper")
_WEEK = ("week_sma10", "week_sma20", "week_sma40", "week_return_4", "week_return_12", "week_slope", "week_rsi", "week_atr", "week_position")


@query("technical_indicators", f"WITH {IND_SQL} SELECT symbol, ts, trend, direction, {six(*_IND)} FROM i", dates=("ts",))
def technical_indicators(spark, sf_dir):
    return rounded(technical.daily(supplier_day_bars(spark, sf_dir)), "symbol", "ts", "trend", "direction", six=_IND)


@query("technical_weekly", f"WITH {IND_SQL} SELECT symbol, ts, weeks, week_trend, {six(*_WEEK)} FROM i", dates=("ts",))
def technical_weekly(spark, sf_dir):
    """The weekly timeframe as far as it had gone at each bar."""
    return rounded(technical.weekly(supplier_day_bars(spark, sf_dir)).withColumn("weeks", F.col("weeks").cast("bigint")), "symbol", "ts", "weeks", "week_trend", six=_WEEK)


@query("technical_outlook", f"WITH {IND_SQL} SELECT symbol, ts, trend, week_trend, direction, breakout, stance, headline, setup, {six('trigger', 'stop', 'target', 'risk_reward')} FROM o", dates=("ts",))
def technical_outlook(spark, sf_dir):
    return rounded(_outlook(spark, sf_dir), "symbol", "ts", "trend", "week_trend", "direction", "breakout", "stance", "headline", "setup", six=("trigger", "stop", "target", "risk_reward"))


@query(
    "technical_patterns",
    f"""WITH {IND_SQL}, z AS (SELECT *, trend = week_trend AND trend IN ('uptrend', 'downtrend') AS al FROM o)
SELECT symbol, ts, 'trend' AS pattern, CASE WHEN al THEN 'aligned' ELSE 'mixed' END AS status, 'not_applicable' AS volume_confirmation, CASE WHEN al THEN 'medium' ELSE 'low' END AS confidence FROM z
UNION ALL SELECT symbol, ts, 'structure_' || direction, CASE WHEN direction = 'none' THEN 'range_or_transition' WHEN breakout = 'confirmed' THEN 'confirmed' ELSE 'needs_confirmation' END, CASE WHEN direction = 'none' THEN 'not_triggered' WHEN breakout = 'confirmed' THEN 'confirmed' ELSE 'weak_or_missing' END, CASE WHEN direction <> 'none' AND breakout = 'confirmed' THEN 'medium' ELSE 'low' END FROM z
UNION ALL SELECT symbol, ts, 'momentum', CASE WHEN rsi IS NULL THEN 'insufficient_data' WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END, 'not_applicable', CASE WHEN rsi >= 70 OR rsi <= 30 THEN 'low' ELSE 'medium' END FROM z""",
    dates=("ts",),
)
def technical_patterns(spark, sf_dir):
    return technical.patterns(_outlook(spark, sf_dir))


def _records(spark, sf_dir):
    """A record for the last bar of each month."""
    out = _outlook(spark, sf_dir).withColumn("newest", F.max("ts").over(Window.partitionBy("symbol", F.trunc("ts", "month"))))
    return out.where("ts = newest").select("symbol", F.col("ts").alias("as_of"), "trigger", "stop", "target")


REC_SQL = IND_SQL + """,
rec AS (SELECT symbol, ts AS as_of, trigger, stop, target FROM o QUALIFY ts = max(ts) OVER (PARTITION BY symbol, date_trunc('month', ts)))"""


@query(
    "setup_review",
    f"""WITH {REC_SQL}, pr AS (SELECT symbol, as_of, lag(as_of) OVER s AS prev_as_of, lag(trigger) OVER s AS pt, lag(stop) OVER s AS ps, lag(target) OVER s AS pg FROM rec WINDOW s AS (PARTITION BY symbol ORDER BY as_of)),
m AS (SELECT pr.symbol, pr.as_of, prev_as_of, count(b.ts) AS n_bars, min(b.ts) AS period_start, max(b.ts) AS period_end, round((arg_max(b.close, b.ts) / arg_min(b.close, b.ts) - 1) * 100, 2) AS pct_change, min(b.low) <= any_value(ps) AS st, max(b.high) >= any_value(pg) AS ta, max(b.high) >= any_value(pt) AS tr
FROM pr LEFT JOIN b ON b.symbol = pr.symbol AND b.ts > prev_as_of AND b.ts <= pr.as_of GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN prev_as_of IS NULL THEN 'not_applicable' WHEN n_bars = 0 THEN 'no_new_bars' WHEN st AND ta THEN 'both_levels_touched_order_unknown' WHEN st THEN 'stop_loss_touched' WHEN ta THEN 'target_touched' WHEN tr THEN 'trigger_touched_pending' ELSE 'not_triggered' END AS outcome FROM m)
SELECT symbol, as_of, prev_as_of, CASE WHEN prev_as_of IS NOT NULL THEN n_bars END AS n_bars, period_start, period_end, pct_change, outcome,
CASE outcome WHEN 'not_applicable' THEN 'not_available' WHEN 'both_levels_touched_order_unknown' THEN 'ambiguous' WHEN 'stop_loss_touched' THEN 'invalidated' WHEN 'target_touched' THEN 'confirmed' ELSE 'pending' END AS thesis FROM r""",
    dates=("as_of", "prev_as_of", "period_start", "period_end"),
)
def setup_review(spark, sf_dir):
    return rounded(technical.review(_records(spark, sf_dir), supplier_day_bars(spark, sf_dir)), "symbol", "as_of", "prev_as_of", "n_bars", "period_start", "period_end", "outcome", "thesis", six=("pct_change",))


@query(
    "as_of_previous_record",
    f"""WITH {REC_SQL} SELECT b.symbol, b.ts, r.as_of AS prev_as_of, round(r.trigger, 6) AS prev_trigger FROM b ASOF LEFT JOIN rec r ON b.symbol = r.symbol AND b.ts > r.as_of""",
    dates=("ts", "prev_as_of"),
)
def as_of_previous_record(spark, sf_dir):
    return rounded(technical.as_of_previous(_records(spark, sf_dir), supplier_day_bars(spark, sf_dir)), "symbol", "ts", "prev_as_of", plain=("prev_trigger",))


def _lagged(n: int) -> str:
    return f"CASE WHEN lag(close, {n}) OVER s > 0 THEN (close - lag(close, {n}) OVER s) / lag(close, {n}) OVER s END AS ret_{n}"


def _dev(n: int) -> str:
    return f"CASE WHEN count(*) OVER w{n} >= {n} AND avg(close) OVER w{n} > 0 THEN (close - avg(close) OVER w{n}) / avg(close) OVER w{n} END AS dev_{n}"


PANEL_SQL = MONTH_BARS + f""",
d0 AS (SELECT *, {', '.join(map(_lagged, (1, 5, 10, 20)))}, {', '.join(map(_dev, (5, 10, 20)))}, CASE WHEN count(*) OVER w5 >= 5 AND avg(volume) OVER w5 > 0 THEN volume / avg(volume) OVER w5 END AS volume_ratio, lead(open) OVER s AS no, lead(close) OVER s AS nc
       FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts), w5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
d1 AS (SELECT *, CASE WHEN count(ret_1) OVER w20 >= 20 THEN stddev_pop(ret_1) OVER w20 END AS vol_20, coalesce(ret_1 >= 0.1::DOUBLE - 1e-6, false) AS limit_up FROM d0 WINDOW w20 AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
d AS (SELECT *, CASE WHEN no > 0 THEN (nc - no) / no END AS next_return, CASE WHEN no IS NULL THEN 'no_next_bar' WHEN limit_up THEN 'close_limit_up' WHEN no >= close * 1.1::DOUBLE - 1e-6 THEN 'next_open_limit_up' END AS reason FROM d1)"""
_FEAT = ("ret_1", "ret_5", "ret_10", "ret_20", "dev_5", "dev_10", "dev_20", "vol_20", "volume_ratio")


@query("panel_features", f"WITH {PANEL_SQL} SELECT symbol, ts, limit_up, {six(*_FEAT)} FROM d", dates=("ts",))
def panel_features(spark, sf_dir):
    return rounded(daily.panel_features(month_bars(spark, sf_dir)), "symbol", "ts", "limit_up", six=_FEAT)


def panel(spark, sf_dir):
    return daily.panel_labels(daily.panel_features(month_bars(spark, sf_dir)))


@query("panel_labels", f"WITH {PANEL_SQL} SELECT symbol, ts, reason, reason IS NULL AS eligible, CASE WHEN reason IS NULL AND next_return > 0 THEN 1 ELSE 0 END AS label, {six('next_return')} FROM d", dates=("ts",))
def panel_labels(spark, sf_dir):
    return rounded(panel(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit(0))), "symbol", "ts", "reason", "eligible", "label", six=("next_return",))


@query("label_exclusion_counts", f"WITH {PANEL_SQL} SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY reason")
def label_exclusion_counts(spark, sf_dir):
    return panel(spark, sf_dir).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def scored(spark, sf_dir):
    """A plain reversal score in [0, 1] against the labels."""
    score = F.round(1 / (1 + F.exp(F.col("dev_5"))), 3)
    return panel(spark, sf_dir).where("eligible AND dev_5 IS NOT NULL").select("symbol", "ts", score.alias("score"), "label", F.col("next_return").alias("outcome"))


SCORED_SQL = PANEL_SQL + ", sc AS (SELECT symbol, ts, round(1 / (1 + exp(dev_5)), 3) AS score, (next_return > 0)::INTEGER AS label, next_return AS outcome FROM d WHERE reason IS NULL AND dev_5 IS NOT NULL)"


@query(
    "score_auc",
    f"""WITH {SCORED_SQL}, g AS (SELECT year(ts) AS year, score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM sc GROUP BY 1, 2),
r AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY year ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * n) AS wins FROM g)
SELECT year, sum(p) AS n_pos, sum(n) AS n_neg, round(sum(wins) / (sum(p) * sum(n)), 6) AS auc FROM r GROUP BY year HAVING sum(p) > 0 AND sum(n) > 0""",
)
def score_auc(spark, sf_dir):
    return rounded(daily.auc(scored(spark, sf_dir).withColumn("year", F.year("ts").cast("bigint")), "year").where("auc IS NOT NULL"), "year", "n_pos", "n_neg", plain=("auc",))


@query(
    "score_auc_all",
    f"""WITH {SCORED_SQL}, g AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM (SELECT * REPLACE (1 / (1 + exp(dev_5)) AS score) FROM sc JOIN (SELECT symbol, ts, dev_5 FROM d) USING (symbol, ts)) GROUP BY 1),
r AS (SELECT *, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * n) AS wins FROM g) SELECT sum(p) AS n_pos, sum(n) AS n_neg, round(sum(wins) / (sum(p) * sum(n)), 6) AS auc FROM r""",
)
def score_auc_all(spark, sf_dir):
    """All rows as one group, scores as they are: about as many ranks as rows."""
    score = 1 / (1 + F.exp(F.col("dev_5")))
    return rounded(daily.auc(panel(spark, sf_dir).where("eligible AND dev_5 IS NOT NULL").select(score.alias("score"), "label")), "n_pos", "n_neg", plain=("auc",))


@query(
    "score_rank_ic",
    f"""WITH {SCORED_SQL}, r AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY score) + (count(*) OVER (PARTITION BY ts, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY ts ORDER BY outcome) + (count(*) OVER (PARTITION BY ts, outcome) - 1) / 2.0::DOUBLE AS b FROM sc)
SELECT ts, count(*) AS n, round(corr(a, b), 6) AS ic FROM r GROUP BY ts HAVING count(*) > 2 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0""",
    dates=("ts",),
)
def score_rank_ic(spark, sf_dir):
    return rounded(daily.rank_ic(scored(spark, sf_dir), "ts").where("n > 2 AND ic IS NOT NULL"), "ts", "n", plain=("ic",))


@query(
    "score_threshold_grid",
    f"""WITH {SCORED_SQL}, g AS (SELECT t AS percent, count(*) FILTER (score >= t / 100.0::DOUBLE AND label = 1) / (count(*) FILTER (label = 1))::DOUBLE - count(*) FILTER (score >= t / 100.0::DOUBLE AND label = 0) / (count(*) FILTER (label = 0))::DOUBLE AS j
FROM sc, range(50, 71) x(t) GROUP BY t) SELECT percent::INTEGER AS percent, round(j, 6) AS j, row_number() OVER (ORDER BY j DESC, percent) = 1 AS best FROM g""",
)
def score_threshold_grid(spark, sf_dir):
    return rounded(daily.threshold_grid(scored(spark, sf_dir)), "percent", "best", plain=("j",))


@query(
    "score_confusion",
    f"""WITH {SCORED_SQL}, m AS (SELECT count(*) FILTER (score >= 0.55 AND label = 1) AS tp, count(*) FILTER (score >= 0.55 AND label = 0) AS fp, count(*) FILTER (score < 0.55 AND label = 1) AS fn, count(*) FILTER (score < 0.55 AND label = 0) AS tn FROM sc)
SELECT round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS "precision", round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM m""",
)
def score_confusion(spark, sf_dir):
    return rounded(daily.confusion(scored(spark, sf_dir), 0.55), plain=("accuracy", "precision", "recall", "f1"))


_MEANS = {"mean_3": ("x", 3), "mean_12": ("x", 12), "mean_48": ("x", 48)}


def _ewm_sql(span: int, i: int) -> str:
    a = 2 / (span + 1)
    d = f"(z.w{i} * {1 - a!r}::DOUBLE)"
    return f"""CASE WHEN g.x IS NULL THEN z.m{i} WHEN z.m{i} IS NULL THEN g.x ELSE ({d} * z.m{i} + {a!r}::DOUBLE * g.x) / ({d} + {a!r}::DOUBLE) END, CASE WHEN g.x IS NULL AND z.m{i} IS NOT NULL THEN {d} ELSE 1 END"""


@query(
    "exponential_means",
    f"""WITH RECURSIVE {SUPPLIER_DAY_BARS}, g AS (SELECT symbol, ts, CASE WHEN volume % 3 > 0 THEN close END AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b),
e(symbol, n, ts, x, m0, w0, m1, w1, m2, w2) AS (SELECT symbol, n, ts, x, x, 1.0::DOUBLE, x, 1.0::DOUBLE, x, 1.0::DOUBLE FROM g WHERE n = 1 UNION ALL SELECT g.symbol, g.n, g.ts, g.x, {', '.join(_ewm_sql(span, i) for i, (_, span) in enumerate(_MEANS.values()))} FROM e z JOIN g ON g.symbol = z.symbol AND g.n = z.n + 1)
SELECT symbol, ts, round(m0, 4) AS mean_3, round(m1, 4) AS mean_12, round(m2, 4) AS mean_48 FROM e""",
    dates=("ts",),
)
def exponential_means(spark, sf_dir):
    """Over a symbol's whole history, a third of its values missing."""
    b = supplier_day_bars(spark, sf_dir).withColumn("x", F.when(F.col("volume") % 3 > 0, F.col("close")))
    return w.ewm(b, _MEANS, ["symbol"], ["ts"], block=16).select("symbol", "ts", *[F.round(c, 4).alias(c) for c in _MEANS])
