"""Intraday order flow: bars with flow, same-clock baselines, signals, blended score, participation.

Bars are keyed by symbol, date_key (YYYYMMDD) and minute (of the day).  `day` windows run over one symbol's bars of a date, `segment` windows over an
unbroken run of them, `slot` windows over the bars of one symbol and minute on the dates before.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.functions.expr import clip, first_match, mean_of, ratio, session_part, sign, true
from quantloom.operators import resample

TIME = ("date_key", "minute")


@dataclass(frozen=True)
class Config:
    minutes: int = 30
    large: float = 300
    baseline: int = 10
    entry_delta: float = 0.2
    entry_volume: float = 1.2
    entry_location: float = 0.6
    exit_delta: float = -0.2
    exit_location: float = 0.4
    absorption_volume: float = 1.5
    absorption_return: float = 0.002
    divergence: float = 0.001
    persistence: int = 1
    spans: tuple[int, int, int] = (3, 12, 48)
    flow_window: int = 4
    rank_window: int = 8
    rank_least: int = 2
    regime_window: int = 4
    least_components: int = 3
    strong: float = 75.0
    direction: float = 30.0
    strong_score: float = 60.0
    confirm: int = 2
    whole_days: bool = False  # blended windows run through breaks, gaps and invalid bars of a date


def slot():
    return w.by("symbol", "minute", order=("date_key",))


def day():
    return w.by("symbol", "date_key", order=("minute",))


def segment():
    return w.by("symbol", "date_key", "segment", order=("minute",))


def segments(feat: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds segment, the number of the unbroken run of bars in a date.

    A run ends with its half session, at a missing bar, and where validity changes; a bar that is invalid or out of session is alone.
    """
    d, part, ok = day(), session_part(F.col("minute")), F.col("valid")
    follows = (part == F.lag(part).over(d)) & (part != "out") & (F.col("minute") - F.lag("minute").over(d) <= cfg.minutes) & ok & F.lag(ok).over(d)
    return feat.withColumn("_starts", ~true(follows)).withColumn("segment", w.islands(F.col("_starts"), d)).drop("_starts")


def session_last(cfg: Config = Config()):
    """Whether a bar is in a session and no further one of its date can be."""
    return (session_part(F.col("minute")) != "out") & (F.col("minute") + cfg.minutes >= 900)


def _blended_window(cfg: Config):
    return day() if cfg.whole_days else segment()


def flow_bars(prints: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Bars of prints (symbol, date_key, second, price, volume, direction, trade_count, event_id) with their flow."""
    p = prints.withColumn("minute", resample.bar_minute("second", cfg.minutes))
    keys = ["symbol", *TIME]
    order = F.struct("second", "event_id")
    bars = p.groupBy(*keys).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return resample.join_flow(bars, resample.flow(p, keys, cfg.large), keys)


def baseline_features(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Shares, same-slot baselines of earlier dates, impact, running delta, divergence and absorption."""
    n, s = cfg.baseline, slot()
    c, o, h, lo = (F.col(x) for x in ("close", "open", "high", "low"))
    valid = F.col("observed") & (F.col("print_volume") > 0) & (h >= lo) & (lo > 0)
    out = bars.withColumns({
        "valid": true(valid), "close_location": ratio(c - lo, h - lo), "clv": ratio(2 * c - h - lo, h - lo), "bar_return": ratio(c - o, o), "vwap_distance": ratio(c - F.col("vwap"), "vwap"),
        "volume_base": w.prior("median", "volume", s, n), "print_base": w.prior("median", "print_volume", s, n), "delta_base": w.prior("median", "delta_ratio", s, n), "delta_std": w.prior("std0", "delta_ratio", s, n),
        "observations": w.prior_rows(s),
    })
    out = out.withColumns({
        "relative_volume": ratio("volume", "volume_base"), "relative_prints": ratio("print_volume", "print_base"), "delta_z": ratio(F.col("delta_ratio") - F.col("delta_base"), "delta_std"),
        "ready": (F.col("observations") >= n) & true(F.col("volume_base") > 0),
        "impact": ratio("bar_return", ratio("volume", "volume_base")), "efficiency": F.abs("bar_return") / F.greatest(F.abs("delta_ratio"), F.lit(1e-9)),
        "cvd": w.running_sum("delta", w.by("symbol", order=TIME)), "session_cvd": w.running_sum("delta", day()),
    })
    d, r, loc = F.col("delta_ratio"), F.col("bar_return"), F.col("close_location")
    effort = F.col("valid") & true(F.col("relative_volume") >= cfg.absorption_volume) & true(F.abs(r) <= cfg.absorption_return)
    return out.withColumns({
        "divergence": first_match([((d >= cfg.entry_delta) & (r <= -cfg.divergence), 1), ((d <= cfg.exit_delta) & (r >= cfg.divergence), -1)], 0),
        "bullish_absorption": effort & true(d <= cfg.exit_delta) & true(loc >= cfg.entry_location), "bearish_absorption": effort & true(d >= cfg.entry_delta) & true(loc <= cfg.exit_location),
    })


def baseline_signals(feat: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds entry_signal and exit_signal, and signal: 1 on entry, -1 on exit, entries first; each must hold on `persistence` bars of one date."""
    d, rv, loc, r = (F.col(x) for x in ("delta_ratio", "relative_volume", "close_location", "bar_return"))
    able = F.col("valid") & F.col("ready")
    entry = able & true(d >= cfg.entry_delta) & true(rv >= cfg.entry_volume) & true(loc >= cfg.entry_location) & true(r >= 0) & true(F.col("vwap_distance") >= 0)
    exit_ = able & (true(d <= cfg.exit_delta) & true(rv >= cfg.entry_volume) & true(loc <= cfg.exit_location) | F.col("bearish_absorption") | (F.col("divergence") == 1))
    out = feat.withColumns({"entry_candidate": entry, "exit_candidate": exit_})
    hold = {k: w.persistent(f"{k}_candidate", day(), cfg.persistence) for k in ("entry", "exit")}
    return out.withColumns({"entry_signal": hold["entry"], "exit_signal": hold["exit"], "session_last": session_last(cfg)}).withColumn("signal", F.when(F.col("entry_signal"), 1).when(F.col("exit_signal"), -1).otherwise(0))


def baseline_summary(sig: DataFrame) -> DataFrame:
    """For each symbol the numbers of bars, valid, ready, entries and exits, and the median coverage."""
    return sig.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if("valid").alias("n_valid"), F.count_if("ready").alias("n_ready"), F.count_if(F.col("signal") == 1).alias("n_entry"), F.count_if(F.col("signal") == -1).alias("n_exit"), F.percentile("coverage", 0.5).alias("median_coverage"))


STRENGTH = ("activity_rank", "large_rank", "pressure_rank", "toxicity_rank", "concentration_rank")
SCORE = ("pressure", "execution_quality", "absorption", "alignment", "divergence_score", "large_flow")


def blended_features(feat: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Pressure from three exponential means, consistency, entropy, toxicity, ranks of strength, response, absorption, exhaustion, divergence, regime and the blended score.

    All windows restart with each segment (with each date if cfg.whole_days). feat: from baseline_features.
    """
    s, f, r = _blended_window(cfg), cfg.flow_window, cfg.regime_window
    ok = F.col("valid")
    when_ok = lambda c: F.when(ok, c)
    total = lambda c, n=f: w.trailing("sum", c, s, n, 1)
    c, o, h, lo = (F.col(x) for x in ("close", "open", "high", "low"))
    out = segments(feat, cfg).withColumn("flow", when_ok(clip(ratio("delta", "print_volume"), -1.0, 1.0))).withColumn("volume_ok", when_ok(F.col("print_volume"))).withColumn("delta_ok", when_ok(F.col("delta")))
    names = ("ema_fast", "ema_medium", "ema_slow")
    out = w.ewm(out, {n: ("flow", span) for n, span in zip(names, cfg.spans)}, ["symbol", "date_key"] if cfg.whole_days else ["symbol", "date_key", "segment"], ["minute"])
    out = out.withColumns({n: clip(n, -1.0, 1.0) for n in names})
    out = out.withColumns({
        "pressure": clip(mean_of(["ema_fast", "ema_medium", "ema_slow"], 2), -1.0, 1.0), "flow_trend": clip(F.col("ema_fast") - F.col("ema_slow"), -1.0, 1.0), "acceleration": clip(w.change("ema_fast", s), -1.0, 1.0),
        "persistence": w.trailing("mean", sign("flow"), s, f, 2), "consistency": clip(ratio(F.abs(total("delta_ok")), total(F.abs("delta_ok"))), 0.0, 1.0),
        "buy_sum": total(when_ok(F.col("buy_volume"))), "sell_sum": total(when_ok(F.col("sell_volume"))), "neutral_sum": total(when_ok(F.col("neutral_volume"))), "delta_sum": total(F.abs("delta_ok")),
    })
    out = out.withColumn("flow_sum", F.col("buy_sum") + F.col("sell_sum") + F.col("neutral_sum"))
    share = lambda x: F.greatest(ratio(x, "flow_sum"), F.lit(1e-12))
    entropy = sum((-(share(x) * F.ln(share(x))) for x in ("buy_sum", "sell_sum", "neutral_sum")), F.lit(0.0)) / log(3)
    rank = lambda x: w.trailing_percentile(x, s, cfg.rank_window, cfg.rank_least)
    activity = F.coalesce(F.when(F.col("relative_prints") > 0, F.col("relative_prints")), F.col("volume_ok"))
    out = out.withColumns({"entropy": F.when(F.col("flow_sum") > 0, entropy), "toxicity": clip(ratio("delta_sum", "flow_sum"), 0.0, 1.0), "activity": when_ok(activity), "flow_size": F.abs("flow"), "large_ok": when_ok(F.col("large_share")), "concentration_ok": when_ok(F.col("concentration"))})
    out = out.withColumns({"activity_rank": rank("activity"), "large_rank": rank("large_ok"), "pressure_rank": rank("flow_size"), "toxicity_rank": rank("toxicity"), "concentration_rank": rank("concentration_ok")})
    there = lambda cols: sum((F.col(x).isNotNull().cast("int") for x in cols), F.lit(0))
    out = out.withColumns({"strength": 100 * mean_of(list(STRENGTH), min(cfg.least_components, len(STRENGTH))), "confidence": there(STRENGTH) / float(len(STRENGTH)), "direction_score": clip(100 * F.col("pressure"), -100.0, 100.0)})
    p = F.col("pressure")
    out = out.withColumn("range_pct", when_ok(ratio(h - lo, "close"))).withColumn("atr_pct", w.trailing("median", "range_pct", s, r, 2))
    out = out.withColumn("response", when_ok(F.tanh(ratio("bar_return", F.when(F.col("atr_pct") > 1e-8, F.col("atr_pct")))) * sign(p)))
    out = out.withColumn("lambda", when_ok(ratio(F.abs("bar_return"), F.sqrt(ratio("print_volume", w.trailing("median", "volume_ok", s, f, 1))))))
    z = ratio(F.col("lambda") - w.trailing("median", "lambda", s, f, min(3, f)), w.trailing("std1", "lambda", s, f, min(3, f)))
    force = clip(mean_of(["activity_rank", "large_rank", "toxicity_rank"]), 0.0, 1.0)
    out = out.withColumns({
        "execution_quality": clip(F.col("response") * (0.5 + 0.5 * F.col("consistency")), -1.0, 1.0), "impact_score": F.tanh(clip(z, -4.0, 4.0) / 2) * sign(p),
        "force": force, "calm": 1 - clip(F.abs("response"), 0.0, 1.0), "location": clip((F.col("clv") + 1) / 2, 0.0, 1.0),
    })
    bull = clip(F.greatest(-p, F.lit(0.0)) * F.col("force") * F.col("calm") * (0.5 + 0.5 * F.col("location")), 0.0, 1.0)
    bear = clip(F.greatest(p, F.lit(0.0)) * F.col("force") * F.col("calm") * (1 - 0.5 * F.col("location")), 0.0, 1.0)
    out = out.withColumns({"absorbed_up": when_ok(bull), "absorbed_down": when_ok(bear)}).withColumn("absorption", clip(F.col("absorbed_up") - F.col("absorbed_down"), -1.0, 1.0))
    out = out.withColumn("exhaustion", when_ok(clip(-sign(p) * F.abs(p) * F.col("force") * clip(-F.col("acceleration") * sign(p), 0.0, 1.0), -1.0, 1.0)))
    past = F.lag("close", f).over(s)
    price_norm, flow_norm = F.tanh(ratio(ratio(c - past, past), F.col("atr_pct") * sqrt(f))), F.tanh(total("flow"))
    out = out.withColumns({"price_norm": price_norm, "flow_norm": flow_norm})
    against = true(F.col("price_norm") * F.col("flow_norm") < 0)
    out = out.withColumn("divergence_score", when_ok(F.when(against, -F.col("flow_norm") * F.least(F.abs("flow_norm"), F.abs("price_norm"))).otherwise(0.0)))
    step = c - F.lag("close", r).over(s)
    out = out.withColumn("move", F.abs(w.change("close", s))).withColumn("path_efficiency", clip(ratio(F.abs(step), w.trailing("sum", "move", s, r, 1)), 0.0, 1.0))
    out = out.withColumn("regime_score", when_ok(sign(step) * F.col("path_efficiency"))).withColumn("volatility", w.trailing("std1", when_ok(F.col("bar_return")), s, r, min(3, r)))
    # equal spreads must tie, whatever the order of their sums
    out = out.withColumn("_spread", F.round("volatility", 12)).withColumn("volatility_rank", rank("_spread")).drop("_spread")
    out = out.withColumns({
        "regime": first_match([(~ok, "insufficient"), (F.col("volatility_rank") >= 0.8, "high_volatility"), (F.col("regime_score") >= 0.35, "trend_up"), (F.col("regime_score") <= -0.35, "trend_down")], "range"),
        "alignment": when_ok(clip(p * F.col("regime_score"), -1.0, 1.0)), "large_flow": when_ok(clip(F.col("large_delta_ratio"), -1.0, 1.0) * clip(F.col("large_share"), 0.0, 1.0)),
    })
    ready = ok & (there(STRENGTH) >= min(cfg.least_components, len(STRENGTH))) & (there(SCORE) >= cfg.least_components)
    return out.withColumn("score", F.when(ready, clip(mean_of(list(SCORE), cfg.least_components), -1.0, 1.0)))


def blended_proxies(out: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds the rolling VWAP and the distance from it, the slope of cumulative delta, price against flow, shares by direction, trade intensity against the slot, and whether the bar is its day's last.

    The bar's amount is the prints' own, else their VWAP or the close times their volume. out: from blended_features.
    """
    s, f, ok = _blended_window(cfg), cfg.flow_window, F.col("valid")
    total = lambda c: w.trailing("sum", c, s, f, 1)
    v = F.col("print_volume")
    amount = F.coalesce(*[F.when(x > 0, x) for x in (F.col("amount"), F.col("vwap") * v, F.col("close") * v)])
    out = out.withColumns({"amount_ok": F.when(ok, amount), "flow_move": total("flow"), "flow_path": total(F.abs("flow"))})
    out = out.withColumns({"rolling_vwap": ratio(total("amount_ok"), total("volume_ok")), "cvd_slope": ratio("flow_move", "flow_path"), "price_flow_divergence": -F.col("divergence_score")})
    out = out.withColumns({"rolling_vwap_distance": ratio(F.col("close") - F.col("rolling_vwap"), "rolling_vwap"), "trade_base": w.prior("median", "trade_count", slot(), cfg.baseline, 2)})
    out = out.withColumns({f"{k}_share": ratio(f"{k}_volume", "print_volume") for k in ("buy", "sell", "neutral")})
    return out.withColumns({"trade_intensity": ratio("trade_count", "trade_base"), "session_last": session_last(cfg)}).drop("amount_ok", "flow_move", "flow_path", "trade_base")


def quote_proxies(quotes: DataFrame, levels: int = 5) -> DataFrame:
    """Adds imbalance and microprice_edge of a quote, and whether it is `observed`: else both are NULL. Columns: bid1, ask1, bid_vol1.., ask_vol1..; missing levels count as none, all missing as NULL."""
    side = lambda k: mean_of([f"{k}_vol{i}" for i in range(1, levels + 1)]) * sum((F.col(f"{k}_vol{i}").isNotNull().cast("int") for i in range(1, levels + 1)), F.lit(0))
    out = quotes.withColumns({"bids": side("bid"), "asks": side("ask")})
    b, a, depth = F.col("bid1"), F.col("ask1"), F.col("bids") + F.col("asks")
    middle = (b + a) / 2
    imbalance, edge = ratio(F.col("bids") - F.col("asks"), depth), ratio(ratio(a * F.col("bids") + b * F.col("asks"), depth) - middle, middle)
    seen = true(imbalance.isNotNull() & edge.isNotNull() & (b > 0) & (a >= b) & (F.col("bids") >= 0) & (F.col("asks") >= 0))
    return out.withColumns({"observed": seen, "imbalance": F.when(seen, imbalance), "microprice_edge": F.when(seen, edge)}).drop("bids", "asks")


def blended_signals(feat: DataFrame, cfg: Config = Config()) -> DataFrame:
    """1 or -1 where an entry or exit has held for `confirm` bars of a segment (of a date if cfg.whole_days)."""
    s = _blended_window(cfg)
    sure = F.col("score").isNotNull() & (F.col("confidence") >= 0.6)
    buy, sell = (true(F.col("strength") >= cfg.strong) & true(t) for t in (F.col("direction_score") >= cfg.direction, F.col("direction_score") <= -cfg.direction))
    contrary = true(F.col("absorption") >= 0.2) & true(F.col("direction_score") <= 0)
    entry = sure & (true(F.col("score") >= 0.2) | contrary) & (buy | contrary)
    exit_ = sure & (true(F.col("score") <= -0.2) | sell | true(F.col("absorption") <= -0.2) & true(F.col("direction_score") >= 0) | true(F.col("exhaustion") <= -0.1))
    out = feat.withColumns({"entry_candidate": entry, "exit_candidate": exit_})
    out = out.withColumns({"entry_signal": w.persistent("entry_candidate", s, cfg.confirm), "exit_signal": w.persistent("exit_candidate", s, cfg.confirm), "session_last": session_last(cfg)})
    return out.withColumn("signal", F.when(F.col("entry_signal"), 1).when(F.col("exit_signal"), -1).otherwise(0))


RANKS = {"volume_rank": "print_volume", "count_rank": "trade_count", "amount_rank": "average_amount", "share_rank": "large_share", "delta_rank": "delta_size", "large_delta_rank": "large_delta_size", "return_rank": "return_size", "vwap_rank": "vwap_size"}
PARTS = ("activity", "size", "imbalance", "control")
#: States that a strong bar can be in.
STATES = ("active_buy", "active_sell", "conflicting_evidence", "passive_buy_absorption", "passive_sell_distribution")


def participation(feat: DataFrame, cfg: Config = Config()) -> DataFrame:
    """How hard the market took part in each bar (0 to 100), in which direction, in what state, and whether that is confirmed.

    Evidence is ranked among the same slot's values of earlier dates. feat: from baseline_features.
    """
    s, d, n = slot(), day(), cfg.baseline
    ok = F.col("valid")
    out = feat.withColumn("large_delta", F.when((F.col("large_volume") == 0) & (F.col("print_volume") > 0), 0.0).otherwise(F.col("large_delta_ratio")))
    out = out.withColumns({"delta_size": F.abs("delta_ratio"), "large_delta_size": F.abs("large_delta"), "return_size": F.abs("bar_return"), "vwap_size": F.abs("vwap_distance")})
    # a broken run of bars starts anew: the step must be one bar exactly
    gap = ~F.col("minute").eqNullSafe(F.lag("minute").over(d) + cfg.minutes)
    out = out.withColumn("run", w.islands(gap, d))
    run = w.by("symbol", "date_key", "run", order=("minute",))
    held = ratio(w.trailing("sum", F.when(ok, F.col("delta")), run, 3, 1), w.trailing("sum", F.when(ok, F.col("print_volume")), run, 3, 1))
    out = out.withColumn("held_delta", held)
    out = out.withColumns({k: w.prior_percentile(F.when(ok, F.col(c)), s, n, n) for k, c in RANKS.items()})
    flow = clip(mean_of(["delta_ratio", "large_delta", "held_delta"]), -1.0, 1.0)
    price = clip(mean_of([sign("bar_return") * F.col("return_rank"), sign("vwap_distance") * F.col("vwap_rank"), clip("clv", -1.0, 1.0)]), -1.0, 1.0)
    raw = mean_of([sign("bar_return"), sign("vwap_distance"), clip("clv", -1.0, 1.0)])
    absorbed = F.col("bullish_absorption") | F.col("bearish_absorption")
    out = out.withColumns({"activity": (F.col("volume_rank") + F.col("count_rank")) / 2, "size": (F.col("amount_rank") + F.col("share_rank")) / 2, "imbalance": (F.col("delta_rank") + F.col("large_delta_rank")) / 2, "flow_direction": flow, "price_direction": price})
    out = out.withColumn("control_raw", F.greatest(F.abs(F.col("flow_direction") * raw), F.when(absorbed, F.abs("flow_direction")).otherwise(0.0)))
    out = out.withColumn("control", w.prior_percentile(F.when(ok, F.col("control_raw")), s, n, n))
    whole = sum((F.col(c).isNotNull().cast("int") for c in PARTS), F.lit(0))
    out = out.withColumn("eligible", ok & F.col("ready") & (whole == len(PARTS)))
    out = out.withColumn("participation_score", F.when(F.col("eligible"), clip(25 * (F.col("activity") + F.col("size") + F.col("imbalance") + F.col("control")), 0.0, 100.0)))
    out = out.withColumn("strong", F.col("eligible") & true(F.col("participation_score") >= cfg.strong_score))
    aggressor = 100 * F.col("flow_direction")
    lean = F.when(F.col("bearish_absorption"), -F.abs(aggressor)).when(F.col("bullish_absorption"), F.abs(aggressor)).otherwise(aggressor)
    out = out.withColumn("direction_score", F.when(F.col("eligible"), lean))
    t = cfg.direction
    state = first_match([
        (~F.col("eligible"), "unavailable"), (~F.col("strong"), "no_clear_evidence"), (F.col("bullish_absorption"), "passive_buy_absorption"), (F.col("bearish_absorption"), "passive_sell_distribution"),
        ((aggressor >= t) & (F.col("price_direction") >= 0), "active_buy"), ((aggressor <= -t) & (F.col("price_direction") <= 0), "active_sell"),
    ], "conflicting_evidence")
    out = out.withColumns({"state": state, "side": first_match([(F.col("direction_score") >= t, 1), (F.col("direction_score") <= -t, -1)], 0)})
    directed = F.col("strong") & F.col("state").isin("active_buy", "active_sell", "passive_buy_absorption", "passive_sell_distribution")
    out = out.withColumn("confirmed", w.persistent(directed & (F.col("side") == 1), run, cfg.confirm) | w.persistent(directed & (F.col("side") == -1), run, cfg.confirm))
    stable = F.coalesce(clip(1 - F.abs(F.col("participation_score") - F.lag("participation_score").over(run)) / 100, 0.0, 1.0), F.lit(0.5))
    quality = (clip(1 - F.abs(F.col("coverage") - 1), 0.0, 1.0) + clip(F.col("observations") / float(n), 0.0, 1.0) + whole / float(len(PARTS)) + stable) / 4
    return out.withColumns({"score_stability": stable, "participation_confidence": F.when(ok, clip(100 * quality, 0.0, 100.0))})


def session_summary(part: DataFrame) -> DataFrame:
    """For each symbol and date: P90 (interpolated), mean and largest score, direction weighted by score, shares of strong and confirmed bars, the state with the largest sum of scores over
    strong bars (ties: first name), and the last bar's score."""
    sc = F.col("participation_score")
    base = part.groupBy("symbol", "date_key").agg(
        F.count(F.lit(1)).alias("n_bars"), F.percentile(sc, 0.9).alias("p90"), F.avg(sc).alias("mean_score"), F.max(sc).alias("max_score"), ratio(F.sum(sc * F.col("direction_score")), F.sum(sc)).alias("direction"),
        ratio(F.count_if("strong"), F.count_if("eligible")).alias("strong_share"), F.count_if("confirmed").alias("n_confirmed"), F.max_by("participation_score", "minute").alias("last_score"),
        F.array(*[F.struct(F.lit(x).alias("state"), F.sum(F.when(F.col("strong") & (F.col("state") == x), sc)).alias("weight")) for x in STATES]).alias("states"),
    ).withColumn("states", F.filter("states", lambda x: x.weight.isNotNull()))
    return base.withColumn("dominant", _dominant()).drop("states")


def session_report(part: DataFrame) -> DataFrame:
    """For each symbol and date: bars and scored bars, the P90, mean and peak score, the newest scored bar's score, direction, state, confirmation and confidence, the direction weighted by score (the plain mean where scores
    add up to nothing), the dominant state, shares of strong and of confirmed bars (also by side) among the scored, the side or sides that were confirmed (buy, sell, mixed, none), and the median confidence. Without a
    scored bar: `unavailable`, `none`, false, and NULLs. part: from participation()."""
    sc, d = F.col("participation_score"), F.col("direction_score")
    scored = part.where(sc.isNotNull())
    c = F.coalesce("confirmed", F.lit(False))
    newest = F.max_by(F.struct(sc.alias("score"), d.alias("direction"), "state", c.alias("confirmed"), F.col("participation_confidence").alias("confidence")), "minute")
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    weight = F.sum(F.when(d.isNotNull(), sc))
    found = scored.groupBy("symbol", "date_key").agg(
        F.count(F.lit(1)).alias("valid_bars"), F.percentile(sc, 0.9).alias("p90"), F.avg(sc).alias("mean_score"), F.max(sc).alias("peak_score"), newest.alias("newest"), F.when(weight > 0, F.sum(sc * d) / weight).otherwise(F.avg(d)).alias("direction"),
        share(F.col("strong")).alias("strong_share"), share(c).alias("confirmed_share"), share(c & (F.col("side") == 1)).alias("confirmed_buy_share"), share(c & (F.col("side") == -1)).alias("confirmed_sell_share"), F.percentile("participation_confidence", 0.5).alias("confidence"),
        F.array(*[F.struct(F.lit(x).alias("state"), F.sum(F.when(F.col("strong") & (F.col("state") == x), sc)).alias("weight")) for x in STATES]).alias("states"),
    ).withColumn("states", F.filter("states", lambda x: x.weight.isNotNull()))
    buy, sell = F.col("confirmed_buy_share") > 0, F.col("confirmed_sell_share") > 0
    found = found.withColumns({"dominant": F.coalesce(_dominant(), F.lit("no_clear_evidence")), "confirmed_direction": F.when(buy & sell, "mixed").when(buy, "buy").when(sell, "sell").otherwise("none")})
    out = part.groupBy("symbol", "date_key").agg(F.count(F.lit(1)).alias("total_bars"), F.max("minute").alias("last_minute")).join(found, ["symbol", "date_key"], "left")
    none = {"valid_bars": F.lit(0), "dominant": F.lit("unavailable"), "confirmed_direction": F.lit("none")}
    latest = {f"latest_{k}": F.col(f"newest.{k}") for k in ("score", "direction", "state", "confirmed", "confidence")}
    out = out.withColumns({k: F.coalesce(k, v) for k, v in none.items()} | latest)
    return out.withColumns({"latest_state": F.coalesce("latest_state", F.lit("unavailable")), "latest_confirmed": F.coalesce("latest_confirmed", F.lit(False))}).drop("newest", "states")


def _dominant():
    """The state with the largest sum of scores (to six places), the first name of equals; NULL without strong bars."""
    best = F.array_sort(F.transform("states", lambda x: F.struct((-F.round(x.weight, 6)).alias("w"), x.state.alias("state"))))
    return F.when(F.size(best) > 0, best[0]["state"])


def daily_factors(part: DataFrame) -> DataFrame:
    """For each symbol and date: delta over volume of the valid bars (not the mean of their ratios) and the P90 of participation, in one aggregate."""
    ok = F.col("valid")
    delta = ratio(F.sum(F.when(ok, F.col("buy_volume") - F.col("sell_volume"))), F.sum(F.when(ok, F.col("print_volume"))))
    return part.groupBy("symbol", "date_key").agg(delta.alias("delta_factor"), F.percentile("participation_score", 0.9).alias("participation_factor"))


def daily_score_factor(blended: DataFrame) -> DataFrame:
    """For each symbol and date the mean blended score of its valid bars."""
    return blended.groupBy("symbol", "date_key").agg(F.avg(F.when(F.col("valid"), F.col("score"))).alias("score_factor"), F.count(F.when(F.col("valid"), F.col("score"))).alias("n_scored"))


def forward_labels(bars: DataFrame, minutes: int, horizon: int, cost: float) -> DataFrame:
    """Return from the next bar's open to the open `horizon` bars later, inside one date and on the exact grid of bars; why a row has none otherwise."""
    d = day()
    entry, exit_ = F.lead("open", 1).over(d), F.lead("open", 1 + horizon).over(d)
    at = lambda n: F.lead("minute", n).over(d)
    reason = first_match([
        (at(1).isNull(), "no_entry_bar"), (at(1) != F.col("minute") + minutes, "entry_gap"), (at(1 + horizon).isNull(), "no_exit_bar"),
        (at(1 + horizon) != F.col("minute") + minutes * (1 + horizon), "exit_gap"), (~(entry > 0), "entry_price"),
    ])
    out = bars.withColumns({"reason": reason, "entry_open": entry, "exit_open": exit_})
    return out.withColumn("future_return", F.when(F.col("reason").isNull(), ratio(F.col("exit_open") - F.col("entry_open"), "entry_open"))).withColumn("net_return", F.col("future_return") - cost)


REASONS = ("out_of_session", "invalid_order_flow_data", "history_not_ready", "factor_missing", "factor_non_finite", "current_open_invalid", "future_window_missing", "bar_interval_or_gap", "future_price_invalid", "future_return_invalid")


def prediction_frame(bars: DataFrame, factor: str, minutes: int, horizon: int = 3, require_ready: bool = True, lags: tuple[int, ...] = ()) -> DataFrame:
    """Bars with what a prediction from `factor` at their close may use and aims at, all rows kept.

    Entry is the open of the next bar, exit the open `horizon` bars after it, both in the same half session of the date. Adds part, entry_open, exit_open, entry_minute, exit_minute, future_return, feature_eligible,
    time_aligned, target_available, eligible, invalid_reason (the first of REASONS that holds, else ''), and factor_lag_n for each of `lags`. bars: symbol, date_key, minute, open, the factor, and if they are there valid (else: the factor is there) and ready (else true).
    """
    d = w.by("symbol", "date_key", "part", order=("minute",))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    f, o = F.col(factor), F.col("open")
    missing = f.isNull() | F.isnan(f)
    ok = true("valid") if "valid" in bars.columns else ~missing
    ready = true("ready") if "ready" in bars.columns else F.lit(True)
    out = bars.withColumn("part", session_part(F.col("minute")))
    out = out.withColumns({"entry_open": F.lead("open", 1).over(d), "exit_open": F.lead("open", 1 + horizon).over(d), "entry_minute": F.lead("minute", 1).over(d), "exit_minute": F.lead("minute", 1 + horizon).over(d)} | {f"factor_lag_{n}": F.lag(factor, n).over(d) for n in lags})
    inside, aligned = F.col("part") != "out", true((F.col("entry_minute") == F.col("minute") + minutes) & (F.col("exit_minute") == F.col("minute") + minutes * (1 + horizon)))
    price = finite(F.col("entry_open")) & finite(F.col("exit_open")) & (F.col("entry_open") > 0) & (F.col("exit_open") > 0)
    out = out.withColumn("future_return", F.when(F.col("entry_open") != 0, F.col("exit_open") / F.col("entry_open") - 1))
    target = price & finite(F.col("future_return")) & aligned
    wanting = ~ready if require_ready else F.lit(False)
    feature = ok & finite(f) & finite(o) & (o > 0) & inside & ~wanting
    tests = (~inside, ~ok, wanting, missing, ~finite(f), ~(finite(o) & (o > 0)), F.col("entry_minute").isNull() | F.col("exit_minute").isNull(), ~aligned, ~price, ~target)
    return out.withColumns({"feature_eligible": true(feature), "time_aligned": aligned, "target_available": true(target), "eligible": true(feature & target), "invalid_reason": first_match([(t, reason) for t, reason in zip(tests, REASONS)], "")})


def last_sessions(bars: DataFrame, n: int) -> DataFrame:
    """Bars of each symbol's newest n dates: the dates are ranked, not the bars."""
    days = bars.select("symbol", "date_key").distinct().withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date_key").desc()))).where(F.col("age") <= n)
    return bars.join(days, ["symbol", "date_key"])
