"""Volume-spread analysis: features, candidates, next-bar confirmation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.functions.expr import first_match, ratio, true
from quantloom.operators.quality import bar_reason


@dataclass(frozen=True)
class Config:
    window: int = 20
    low_volume: float = 0.8
    high_volume: float = 1.5
    narrow: float = 0.8
    wide: float = 1.5
    close_high: float = 0.7
    close_low: float = 0.3
    near_high: float = 0.75
    near_low: float = 0.25
    confirm_move: float = 0.0
    stop_buffer: float = 0.003
    reward: float = 2.0


#: Candidates in order of priority, with their codes (fixed values).
CODES = {"test": 3, "stopping_volume": 2, "upthrust": -2, "no_demand": -1, "no_supply": 1}


def features(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds spread, wick, location, baseline and trend columns to bars (symbol, ts, open, high, low, close, volume); baselines look at the bars before only."""
    s, n = w.by("symbol"), cfg.window
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    reason = bar_reason()
    out = bars.withColumn("reason", F.when(reason != "", reason)).withColumn("valid", F.col("reason").isNull())
    out = out.withColumns({"spread": h - lo, "body": F.abs(c - o), "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - lo})
    out = out.withColumns({f"{k}_ratio": ratio(k, "spread") for k in ("body", "upper_wick", "lower_wick")})
    out = out.withColumns({
        "close_location": ratio(c - lo, "spread"), "clv": ratio(2 * c - h - lo, "spread"),
        "volume_base": w.prior("median", "volume", s, n), "spread_base": w.prior("median", "spread", s, n),
        "prior_high": w.prior("max", "high", s, n), "prior_low": w.prior("min", "low", s, n), "close_base": w.prior("mean", "close", s, n),
        "prior_close": F.lag("close").over(s),
    })
    return out.withColumns({
        "volume_ratio": ratio("volume", "volume_base"), "spread_ratio": ratio("spread", "spread_base"),
        "range_position": ratio(c - F.col("prior_low"), F.col("prior_high") - F.col("prior_low")),
        "trend_return": ratio(F.col("prior_close") - F.col("close_base"), "close_base"),
        "bar_return": ratio(c - F.col("prior_close"), "prior_close"), "gap_return": ratio(o - F.col("prior_close"), "prior_close"),
        "ready": F.col("volume_base").isNotNull() & F.col("spread_base").isNotNull() & F.col("prior_high").isNotNull() & F.col("prior_low").isNotNull() & F.col("close_base").isNotNull(),
    }).withColumn("trend", F.signum("trend_return"))


def signals(feat: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds candidate, its status on the next bar, and the signal with stop, risk and target on the confirming bar.

    status: confirmed, invalidated (close beyond the candidate's far end), invalidated_data (next bar not valid), expired, or pending on a last bar.
    """
    s = w.by("symbol")
    o, h, lo, c, loc = (F.col(x) for x in ("open", "high", "low", "close", "close_location"))
    ok = F.col("valid") & F.col("ready")
    up, down = c > o, c < o
    close_high, close_low = true(loc >= cfg.close_high), true(loc <= cfg.close_low)
    low_v, high_v = true(F.col("volume_ratio") <= cfg.low_volume), true(F.col("volume_ratio") >= cfg.high_volume)
    narrow, wide = true(F.col("spread_ratio") <= cfg.narrow), true(F.col("spread_ratio") >= cfg.wide)
    near_low = true(F.col("range_position") <= cfg.near_low) | true(lo <= F.col("prior_low"))
    near_high = true(F.col("range_position") >= cfg.near_high) | true(h >= F.col("prior_high"))
    candidate = first_match([
        (ok & down & narrow & low_v & close_high & near_low, "test"),
        (ok & down & wide & high_v & ~close_low & near_low, "stopping_volume"),
        (ok & up & wide & high_v & close_low & near_high, "upthrust"),
        (ok & up & narrow & low_v & ~close_low & (F.col("trend") >= 0), "no_demand"),
        (ok & down & narrow & low_v & ~close_low & (F.col("trend") <= 0), "no_supply"),
    ])
    out = feat.withColumn("candidate", candidate)
    out = out.withColumn("candidate_code", F.coalesce(first_match([(F.col("candidate") == k, v) for k, v in CODES.items()]), F.lit(0)))
    nxt = lambda x: F.lead(x).over(s)
    long = F.col("candidate_code") > 0
    body_up, body_down = true(nxt("close") > nxt("open")), true(nxt("close") < nxt("open"))
    confirmed = F.when(long, true(nxt("close") > c * (1 + cfg.confirm_move)) & body_up & true(nxt("clv") >= 0)).otherwise(true(nxt("close") < c * (1 - cfg.confirm_move)) & body_down & true(nxt("clv") <= 0))
    beyond = F.when(long, nxt("close") < lo).otherwise(nxt("close") > h)
    status = first_match([(F.col("candidate_code") == 0, None), (nxt("close").isNull() & nxt("ts").isNull(), "pending"), (~true(nxt("valid")), "invalidated_data"), (confirmed, "confirmed"), (beyond, "invalidated")], "expired")
    out = out.withColumn("status", F.when(F.col("candidate_code") != 0, status))
    hit = F.lag("status").over(s) == "confirmed"
    out = out.withColumns({
        "signal": F.when(true(hit), F.when(F.lag("candidate_code").over(s) > 0, 1).otherwise(-1)).otherwise(0),
        "reference_ts": F.when(true(hit), F.lag("ts").over(s)), "stop": F.when(true(hit) & (F.lag("candidate_code").over(s) > 0), F.lag("low").over(s) * (1 - cfg.stop_buffer)),
    })
    risk = c - F.col("stop")
    return out.withColumn("risk", risk).withColumn("target", F.when(F.col("risk") > 0, c + cfg.reward * F.col("risk")))


#: What can become of a candidate.
STATUSES = ("confirmed", "invalidated", "invalidated_data", "expired", "pending")


def event_counts(sig: DataFrame) -> DataFrame:
    """Candidates by name and status; what there is none of counts zero, so that the counts add up to the candidates."""
    row = sig.agg(*[F.count_if((F.col("candidate") == k) & (F.col("status") == s)).alias(f"{k}__{s}") for k in CODES for s in STATUSES])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("candidate"), F.lit(s).alias("status"), F.col(f"{k}__{s}").alias("n")) for k in CODES for s in STATUSES])))
