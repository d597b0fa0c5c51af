"""Prints to bars, bars to longer bars, price adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.functions.expr import ratio, week_ending_friday


def bar_minute(second: str | Column, minutes: int, ends: bool = False) -> Column:
    """The bar of a print's second of day, labelled by its start, or by its end: a print just on a boundary belongs to the bar that starts there."""
    c = F.col(second) if isinstance(second, str) else second
    return (F.floor(c / (60 * minutes)) * minutes + (minutes if ends else 0)).cast("int")


def flow(prints: DataFrame, keys: list[str], large: float) -> DataFrame:
    """Twenty totals of the prints of each bar: volumes, amounts, trades and rows by direction and size, squared and largest volume.

    prints: keys, price, volume, direction, trade_count, and amount if they have one (else price times volume). A print may stand for several trades.
    """
    v, d, big, trades = F.col("volume"), F.col("direction"), F.col("volume") >= large, F.col("trade_count")
    amount = F.col("amount") if "amount" in prints.columns else F.col("price") * v
    part = lambda test, of=v: F.sum(F.when(test, of).otherwise(F.lit(0)))
    sides = {"buy": 1, "sell": -1, "neutral": 0}
    return prints.groupBy(*keys).agg(
        *[part(d == k).alias(f"{side}_volume") for side, k in sides.items()], *[part(d == k, amount).alias(f"{side}_amount") for side, k in sides.items()], *[part(d == k, trades).alias(f"{side}_trades") for side, k in sides.items()],
        F.sum(v).alias("print_volume"), F.sum(amount).alias("amount"), F.sum(trades).alias("trade_count"), F.count(F.lit(1)).alias("transaction_rows"), F.sum(v * v).alias("volume_squared"), F.max("volume").alias("max_trade"),
        part(big).alias("large_volume"), *[part(big & (d == k)).alias(f"large_{side}") for side, k in sides.items()], F.count_if(big).alias("large_rows"),
    )


def join_flow(bars: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Bars with their print totals; a bar without prints has NULLs, not zeros. Adds what follows from the totals."""
    delta, large, trades = F.col("buy_volume") - F.col("sell_volume"), F.col("large_buy") - F.col("large_sell"), F.col("trade_count")
    return bars.join(totals, keys, "left").withColumns({
        "observed": F.col("print_volume").isNotNull(), "delta": delta, "delta_ratio": ratio(delta, "print_volume"), "vwap": ratio("amount", "print_volume"), "volume_gap": F.col("volume") - F.col("print_volume"),
        "coverage": ratio("print_volume", "volume"), "large_delta": large, "large_delta_ratio": ratio(large, "large_volume"), "large_share": ratio("large_volume", "print_volume"),
        "average_size": ratio("print_volume", trades), "average_amount": ratio("amount", trades), "buy_trade_share": ratio("buy_trades", trades), "sell_trade_share": ratio("sell_trades", trades),
        "concentration": ratio("volume_squared", F.col("print_volume") * F.col("print_volume")), "max_share": ratio("max_trade", "print_volume"),
    })


def roll_up(bars: DataFrame, period: str, complete_sums: bool = False) -> DataFrame:
    """Longer bars: `friday` (weeks from Saturday to Friday), `iso` (weeks from Monday) or `month`.

    ts is the period's last day with a bar. change and pct_change are against the close of the period before, for `iso` weeks against the week's own open; amplitude is in percent of the
    close before. With `complete_sums` volume
    and amount are NULL unless every bar has them; else missing ones are left out.
    """
    key = {"friday": week_ending_friday("ts"), "iso": F.date_trunc("week", "ts").cast("date"), "month": F.trunc("ts", "month")}[period]
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)) if complete_sums else F.sum(c)
    out = bars.groupBy("symbol", key.alias("period")).agg(F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), total("volume").alias("volume"), total("amount").alias("amount"))
    before = F.lag("close").over(w.by("symbol", order=("period",)))
    base = F.col("open") if period == "iso" else F.col("prev_close")
    return out.withColumn("prev_close", before).withColumns({"change": F.col("close") - base, "pct_change": 100 * ratio(F.col("close") - base, base), "amplitude": 100 * ratio(F.col("high") - F.col("low"), "prev_close")})


def adjusted(bars: DataFrame, kind: str) -> DataFrame:
    """Prices times `factor` (`hfq`), or times factor over the symbol's newest factor (`qfq`, which looks ahead by nature); change against the adjusted close before.

    A bar without factor has NULL prices.
    """
    scale = F.col("factor")
    if kind == "qfq":
        latest = bars.where("factor IS NOT NULL").groupBy("symbol").agg(F.max_by("factor", "ts").alias("latest"))
        bars = bars.join(latest, "symbol", "left")
        scale = scale / F.col("latest")
    out = bars.withColumns({c: F.col(c) * scale for c in ("open", "high", "low", "close")}).drop("latest")
    return out.withColumn("prev_close", F.lag("close").over(w.by("symbol"))).withColumn("pct_change", 100 * ratio(F.col("close") - F.col("prev_close"), "prev_close"))


def period_summary(bars: DataFrame) -> DataFrame:
    """For each symbol the number of bars, first and last day, least low, highest high, change from first to last close in percent."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("low").alias("low"), F.max("high").alias("high"),
        (100 * ratio(F.max_by("close", "ts") - F.min_by("close", "ts"), F.min_by("close", "ts"))).alias("pct_change"),
    )


def label_convention(bars: DataFrame, minutes: int) -> DataFrame:
    """For each symbol whether its bars are labelled by start (`floor`) or end (`ceil`). bars: symbol, day, minute.

    Labels inside the sessions (their ends included) count. First labels of half sessions vote: on the start for floor, a bar later for ceil. Only if they tie, a label anywhere on
    a start or a bar after one, and then the last labels (a bar before the end, or on it), decide; else it is floor.
    """
    m = F.col("minute")
    half = F.when(m.between(570, 690), "am").when(m.between(780, 900), "pm")
    ends = bars.withColumn("half", half).groupBy("symbol", "day", "half").agg(F.min("minute").alias("first"), F.max("minute").alias("last"), F.max(m.isin(570, 780)).alias("starts"), F.max(m.isin(570 + minutes, 780 + minutes)).alias("steps"))
    start, stop = F.when(F.col("half") == "am", 570).otherwise(780), F.when(F.col("half") == "am", 690).otherwise(900)
    inside = F.col("half").isNotNull()
    votes = ends.groupBy("symbol").agg(
        F.count_if(inside & (F.col("first") == start)).alias("floor_votes"), F.count_if(inside & (F.col("first") == start + minutes)).alias("ceil_votes"),
        F.count_if(inside & (F.col("last") == stop - minutes)).alias("floor_last"), F.count_if(inside & (F.col("last") == stop)).alias("ceil_last"), F.max("starts").alias("starts"), F.max("steps").alias("steps"),
    )
    ceil = (F.col("ceil_votes") > F.col("floor_votes")) | (F.col("ceil_votes") == F.col("floor_votes")) & (F.col("steps") & ~F.col("starts") | (F.col("ceil_last") > F.col("floor_last")))
    return votes.withColumn("convention", F.when(ceil, "ceil").otherwise("floor")).drop("starts", "steps")
