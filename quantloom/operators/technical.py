"""Technical indicators for every bar over two timeframes, patterns, conditional set-ups and their review.

Every bar is analysed as if it were the newest: the current week is part of the weekly timeframe as far as it has gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.functions.expr import first_match, true


@dataclass(frozen=True)
class Config:
    daily: tuple[int, int, int] = (20, 50, 200)
    weekly: tuple[int, int, int] = (10, 20, 40)
    span: int = 14
    volume: int = 20
    structure: int = 20
    range: int = 60
    week_range: int = 20
    confirm: float = 1.2
    risk: float = 1.5
    reward: float = 2.0
    slope: int = 5
    week_slope: int = 4
    hot: float = 75.0


def _change(now: Column, before: Column) -> Column:
    """Change in percent, two places; NULL from 0."""
    return F.when(before != 0, F.round((now / before - 1) * 100, 2))


def _rsi(up: Column, down: Column) -> Column:
    return F.when(down == 0, F.when(up > 0, 100.0).otherwise(50.0)).otherwise(F.round(100 - 100 / (1 + up / down), 2))


def _true_range(high: Column, low: Column, before: Column) -> Column:
    # greatest() skips NULLs: the first bar's is high - low
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def _position(close: Column, high: Column, low: Column) -> Column:
    return F.when(high > low, F.round((close - low) / (high - low) * 100, 2))


def _trend(close: Column, short: Column, middle: Column, long: Column) -> Column:
    return first_match([
        ((close > short) & (short > middle) & (long.isNull() | (close > long)), "uptrend"), ((close < short) & (short < middle) & (long.isNull() | (close < long)), "downtrend"),
        (close > short, "recovering"), (close < short, "weakening"),
    ], "range_or_transition")


def daily(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Returns, averages and slope, RSI and ATR from simple means, volume ratio, position in the range, drawdown, levels and breakout of each bar."""
    s = w.by("symbol")
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    a, b, z = cfg.daily
    back = lambda n: s.rowsBetween(-(n - 1), 0)
    out = bars.withColumn("prev", F.lag("close").over(s)).withColumns({f"sma{n}": F.round(w.trailing("mean", "close", s, n), 4) for n in cfg.daily})
    move = c - F.col("prev")
    out = out.withColumns({
        "gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))), "true_range": _true_range(h, lo, F.col("prev")),
    })
    base = F.round(F.avg("volume").over(s.rowsBetween(-cfg.volume, -1)), 4)
    out = out.withColumns({
        "return_5": _change(c, F.lag("close", 5).over(s)), "return_20": _change(c, F.lag("close", 20).over(s)),
        "slope": F.round(F.col(f"sma{a}") - F.lag(f"sma{a}", cfg.slope).over(s), 4),
        "rsi": _rsi(w.trailing("mean", "gain", s, cfg.span), w.trailing("mean", "loss", s, cfg.span)), "atr": F.round(w.trailing("mean", "true_range", s, cfg.span), 4),
        "volume_average": F.round(F.avg("volume").over(back(cfg.volume)), 4), "volume_ratio": F.when(base > 0, F.round(v / base, 3)),
        "position": _position(c, F.max("high").over(back(cfg.range)), F.min("low").over(back(cfg.range))), "drawdown": _change(c, F.max("close").over(back(cfg.range))),
        "support_lower": F.min("low").over(back(cfg.range)), "resistance_upper": F.max("high").over(back(cfg.structure)),
        "prior_high": w.prior("max", "high", s, cfg.structure), "prior_low": w.prior("min", "low", s, cfg.structure),
        "trend": _trend(c, F.col(f"sma{a}"), F.col(f"sma{b}"), F.col(f"sma{z}")),
    })
    buffer = F.greatest(0.5 * F.coalesce("atr", F.lit(0.0)), 0.005 * c)
    direction = first_match([(c > F.col("prior_high"), "up"), (c < F.col("prior_low"), "down")], "none")
    status = first_match([(F.col("prior_high").isNull(), "insufficient_data"), (F.col("direction") == "none", "none"), (F.col("volume_ratio") >= cfg.confirm, "confirmed")], "needs_volume_confirmation")
    out = out.withColumns({"atr_pct": F.when((F.col("atr") != 0) & (c != 0), F.round(F.col("atr") / c * 100, 2)), "support_upper": F.round(F.col("support_lower") + buffer, 4), "resistance_lower": F.round(F.col("resistance_upper") - buffer, 4), "direction": direction})
    return out.withColumn("breakout", status).drop("gain", "loss", "true_range", "prev")


def weekly(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds the weekly averages, slope, returns, RSI, ATR, position, trend and number of weeks, as far as the bar's own ISO week has gone."""
    weeks = bars.groupBy("symbol", F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.max("high").alias("wh"), F.min("low").alias("wl"), F.max_by("close", "ts").alias("wc"))
    s = w.by("symbol", order=("week",))
    before = lambda n, m=1: s.rowsBetween(-n, -m)
    move = F.col("wc") - F.lag("wc").over(s)
    weeks = weeks.withColumns({"gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0)), "tr": _true_range(F.col("wh"), F.col("wl"), F.lag("wc").over(s))})
    k, middle = cfg.span, cfg.weekly[1]
    past = {f"s{n}": F.sum("wc").over(before(n - 1)) for n in cfg.weekly} | {f"c{n}": F.lag("wc", n).over(s) for n in (1, 4, 12)}
    past |= {"weeks": F.row_number().over(s), "gains": F.sum("gain").over(before(k - 1)), "losses": F.sum("loss").over(before(k - 1)), "trs": F.sum("tr").over(before(k - 1)), "far": F.round(F.sum("wc").over(before(middle + cfg.week_slope - 1, cfg.week_slope)) / middle, 4)}
    past |= {"top": F.max("wh").over(before(cfg.week_range - 1)), "floor": F.min("wl").over(before(cfg.week_range - 1))}
    weeks = weeks.withColumns(past).select("symbol", "week", *past)
    so_far = Window.partitionBy("symbol", "week").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumn("week", F.date_trunc("week", "ts").cast("date")).withColumns({"wh": F.max("high").over(so_far), "wl": F.min("low").over(so_far)}).join(weeks, ["symbol", "week"])
    c, n = F.col("close"), F.col("weeks")
    out = out.withColumns({f"week_sma{m}": F.when(n >= m, F.round((F.col(f"s{m}") + c) / m, 4)) for m in cfg.weekly})
    up, down = (F.col("gains") + F.greatest(c - F.col("c1"), F.lit(0.0))) / k, (F.col("losses") + F.greatest(F.col("c1") - c, F.lit(0.0))) / k
    return out.withColumns({
        "week_return_4": _change(c, F.col("c4")), "week_return_12": _change(c, F.col("c12")), "week_slope": F.when(n >= middle + cfg.week_slope, F.round(F.col(f"week_sma{middle}") - F.col("far"), 4)),
        "week_rsi": F.when(n > k, _rsi(up, down)), "week_atr": F.when(n >= k, F.round((F.col("trs") + _true_range(F.col("wh"), F.col("wl"), F.col("c1"))) / k, 4)),
        "week_position": _position(c, F.greatest("top", "wh"), F.least("floor", "wl")), "week_trend": _trend(c, *[F.col(f"week_sma{m}") for m in cfg.weekly]),
    }).drop("week", "wh", "wl", *[x for x in past if x != "weeks"])


def outlook(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Both timeframes with stance, headline (a code), and the set-up a long entry would wait for: status, trigger, stop, target, risk_reward."""
    out = weekly(daily(bars, cfg), cfg)
    c, up, falling = F.col("close"), F.col("direction") == "up", F.col("week_trend") == "downtrend"
    view = first_match([
        (up & (F.col("breakout") == "confirmed"), F.lit("bullish/volume_breakout")), (falling & F.col("trend").isin("downtrend", "weakening"), F.lit("bearish/both_timeframes_weak")),
        (F.col("rsi") >= cfg.hot, F.lit("neutral/overheated")),
    ], "neutral/unfinished")
    atr = F.when(F.col("atr") != 0, F.col("atr")).otherwise(F.greatest(0.03 * c, F.lit(0.01)))
    out = out.withColumns({"stance": F.split(view, "/")[0], "headline": F.split(view, "/")[1], "unit": atr, "trigger": F.when(up, c).otherwise(F.when(F.col("resistance_upper") <= c, c + atr).otherwise(F.col("resistance_upper")))})
    t, u = F.col("trigger"), F.col("unit")
    stop = F.greatest(F.lit(0.01), c - cfg.risk * u)
    stop = F.when(F.col("support_lower") < t, F.greatest(stop, F.least(F.col("support_lower"), t - 0.01))).otherwise(stop)
    out = out.withColumn("stop", F.when(stop >= t, F.greatest(F.lit(0.01), t - F.greatest(u, 0.03 * t))).otherwise(stop))
    out = out.withColumn("risk", F.greatest(t - F.col("stop"), F.lit(0.01)))
    out = out.withColumn("target", t + cfg.reward * F.col("risk"))
    setup = first_match([(up, "breakout_wait_for_retest"), (falling | (F.col("trend") == "downtrend"), "long_setup_suspended")], "wait_for_volume_breakout")
    return out.withColumns({"setup": setup, "risk_reward": F.round((F.col("target") - t) / F.col("risk"), 2)}).withColumns({x: F.round(x, 4) for x in ("trigger", "stop", "target")}).drop("unit", "risk")


def patterns(out: DataFrame) -> DataFrame:
    """Three rows for each bar: symbol, ts, pattern (trend, structure, momentum), status, volume_confirmation, confidence."""
    aligned = (F.col("trend") == F.col("week_trend")) & F.col("trend").isin("uptrend", "downtrend")
    broke, sure = F.col("direction") != "none", F.col("breakout") == "confirmed"
    heat = first_match([(F.col("rsi").isNull(), "insufficient_data"), (F.col("rsi") >= 70, "overbought"), (F.col("rsi") <= 30, "oversold")], "neutral")

    def row(pattern: str | Column, status: Column, volume: str | Column, confidence: Column) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(pattern).alias("pattern"), status.alias("status"), lit(volume).alias("volume_confirmation"), confidence.alias("confidence"))

    three = F.array(
        row("trend", F.when(aligned, "aligned").otherwise("mixed"), "not_applicable", F.when(aligned, "medium").otherwise("low")),
        row(F.concat(F.lit("structure_"), "direction"), F.when(~broke, "range_or_transition").when(sure, "confirmed").otherwise("needs_confirmation"), F.when(~broke, "not_triggered").when(sure, "confirmed").otherwise("weak_or_missing"), F.when(broke & sure, "medium").otherwise("low")),
        row("momentum", heat, "not_applicable", F.when(heat.isin("overbought", "oversold"), "low").otherwise("medium")),
    )
    return out.select("symbol", "ts", F.explode(three).alias("x")).select("symbol", "ts", "x.*")


def review(records: DataFrame, bars: DataFrame) -> DataFrame:
    """What became of each record's predecessor on the bars after it, up to and with the record's own.

    records: symbol, as_of, trigger, stop, target. Stop and target are looked at before the trigger: daily bars don't say what came first. A bar finds the record that
    reviews it by one window over bars and records; no pairs are joined.
    """
    s = w.by("symbol", order=("as_of",))
    mine = records.select("symbol", "as_of", *[F.lag(c).over(s).alias(f"prev_{c}") for c in ("as_of", "trigger", "stop", "target")])
    marks = records.select("symbol", F.col("as_of").alias("ts"), F.col("as_of"), *[F.lit(None).cast("double").alias(c) for c in ("high", "low", "close")])
    both = bars.select("symbol", "ts", F.lit(None).cast("date").alias("as_of"), "high", "low", "close").unionByName(marks)
    ahead = Window.partitionBy("symbol").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("as_of", F.min("as_of").over(ahead)).where("close IS NOT NULL AND as_of IS NOT NULL")
    seen = found.groupBy("symbol", "as_of").agg(F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"))
    out = mine.join(seen, ["symbol", "as_of"], "left")
    stopped, reached, triggered = true(F.col("low") <= F.col("prev_stop")), true(F.col("high") >= F.col("prev_target")), true(F.col("high") >= F.col("prev_trigger"))
    outcome = first_match([
        (F.col("prev_as_of").isNull(), "not_applicable"), (F.col("n_bars").isNull(), "no_new_bars"), (stopped & reached, "both_levels_touched_order_unknown"), (stopped, "stop_loss_touched"),
        (reached, "target_touched"), (triggered, "trigger_touched_pending"),
    ], "not_triggered")
    thesis = first_match([(F.col("outcome") == "not_applicable", "not_available"), (F.col("outcome") == "both_levels_touched_order_unknown", "ambiguous"), (F.col("outcome") == "stop_loss_touched", "invalidated"), (F.col("outcome") == "target_touched", "confirmed")], "pending")
    known = F.col("prev_as_of").isNotNull()
    return out.withColumn("outcome", outcome).select("symbol", "as_of", "prev_as_of", F.when(known, F.coalesce("n_bars", F.lit(0))).alias("n_bars"), F.when(known, F.col("start")).alias("period_start"), F.when(known, F.col("end")).alias("period_end"), F.when(known, _change(F.col("last"), F.col("first"))).alias("pct_change"), "outcome", thesis.alias("thesis"))


def as_of_previous(records: DataFrame, at: DataFrame) -> DataFrame:
    """For each (symbol, ts) of `at` the newest record strictly before it: one window over both, no join of pairs."""
    both = records.select("symbol", F.col("as_of").alias("ts"), F.struct("as_of", "trigger").alias("rec"), F.lit(1).alias("side")).unionByName(at.select("symbol", "ts", F.lit(None).cast("struct<as_of:date,trigger:double>").alias("rec"), F.lit(0).alias("side")))
    s = w.by("symbol", order=("ts", "side"))
    # questions sort before records of the same day, so that only earlier ones are seen
    seen = F.last("rec", ignorenulls=True).over(s.rowsBetween(w.Window.unboundedPreceding, -1))
    return both.withColumn("found", seen).where("side = 0").select("symbol", "ts", F.col("found.as_of").alias("prev_as_of"), F.col("found.trigger").alias("prev_trigger"))
