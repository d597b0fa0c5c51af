"""Historical bars of many symbols at once: scan, adjust, roll up, trim, in a fixed shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import windows as w
from quantloom.functions.expr import first_match, week_ending_friday

#: Columns of the result, in order.
SHAPE = ("day", "code", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "change", "turnover")


def security_master(assets: DataFrame) -> DataFrame:
    """code (six digits, zero-padded) and name of every security with a symbol, by code."""
    return assets.where("symbol IS NOT NULL").select(F.lpad(F.trim(F.col("symbol").cast("string")), 6, "0").alias("code"), "name").orderBy("code")


def qualified(codes: DataFrame, listing: DataFrame) -> DataFrame:
    """code, ts_code: the listing's own where it has just one for a code, else by the exchange that the first digits tell; ambiguous codes are `ambiguous`.

    listing: code, ts_code. A code's entries are counted up to two.
    """
    seen = listing.groupBy("code").agg(F.countDistinct("ts_code").alias("n"), F.min("ts_code").alias("ts_code"))
    rule = first_match([(F.col("code").startswith("6"), F.concat("code", F.lit(".SH"))), (F.substring("code", 1, 1).isin("0", "3"), F.concat("code", F.lit(".SZ"))), (F.substring("code", 1, 1).isin("4", "8", "9"), F.concat("code", F.lit(".BJ")))])
    return codes.join(seen, "code", "left").select("code", F.when(F.col("n") > 1, "ambiguous").otherwise(F.coalesce("ts_code", rule)).alias("ts_code"))


def panel(bars: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bars of the wanted symbols, and the symbols that have none. symbols: symbol."""
    wanted = symbols.select("symbol").distinct()
    return bars.join(wanted, "symbol", "left_semi"), wanted.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def _scan(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows of the range, and of each symbol the one row before it."""
    before = F.max(F.when(F.col("ts") < start, F.col("ts"))).over(Window.partitionBy("symbol"))
    return bars.where(F.col("ts") <= end).withColumn("_before", before).where((F.col("ts") >= start) | (F.col("ts") == F.col("_before"))).drop("_before")


def _priced(bars: DataFrame, adjust: str) -> DataFrame:
    s = w.by("symbol")
    if not adjust:
        gap = F.col("prev_close").isNotNull()
        bars = bars.withColumn("change", F.when(F.col("change").isNull() & gap, F.col("close") - F.col("prev_close")).otherwise(F.col("change")))
        return bars.withColumn("pct_change", F.when(F.col("pct_change").isNull() & gap, (F.col("close") / F.col("prev_close") - 1) * 100).otherwise(F.col("pct_change")))
    scale = F.col("factor") / F.col("latest") if adjust == "qfq" else F.col("factor")
    checked = F.when(F.col("factor").isNull(), F.raise_error(F.concat(F.lit("no factor: "), F.col("symbol").cast("string"))).cast("double")).otherwise(scale)
    bars = bars.withColumn("scale", checked).withColumns({c: F.col(c) * F.col("scale") for c in ("open", "high", "low", "close")}).drop("scale")
    bars = bars.withColumn("prev_close", F.lag("close").over(s))
    return bars.withColumns({"change": F.col("close") - F.col("prev_close"), "pct_change": F.when(F.col("prev_close") != 0, (F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100)})


def historical_bars(bars: DataFrame, start: str, end: str, period: str = "daily", adjust: str = "") -> DataFrame:
    """Bars of every symbol in `bars` from start to end, in the columns of SHAPE; none in the range: no rows, the same columns.

    bars: symbol, ts, open, high, low, close, prev_close, change, pct_change, volume, amount, turnover, factor. period: daily, weekly (Saturday to Friday), monthly. adjust:
    '' (change and pct_change are filled where missing and the close before is known), hfq, qfq (over each symbol's newest factor anywhere); a bar without factor is then an error.
    A longer bar's change is against the last close before its first day, or that day's own prev_close if there is none; sums leave out missing values, all missing is NULL.
    """
    if period not in ("daily", "weekly", "monthly") or adjust not in ("", "hfq", "qfq"):
        raise ValueError("period must be daily, weekly or monthly; adjust '', hfq or qfq")
    if start > end:
        raise ValueError("start is after end")
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    if adjust == "qfq":
        newest = F.max_by("factor", F.when(F.col("factor").isNotNull(), F.col("ts"))).over(Window.partitionBy("symbol"))
        bars = bars.withColumn("latest", newest)
    frame = _priced(_scan(bars, a, b), adjust)
    if period == "daily":
        amplitude = F.when(F.col("prev_close") != 0, (F.col("high") - F.col("low")) / F.col("prev_close") * 100)
        out = frame.where(F.col("ts") >= a).withColumn("amplitude", amplitude)
        return out.select(F.col("ts").alias("day"), F.col("symbol").cast("string").alias("code"), *SHAPE[2:])
    key = week_ending_friday("ts") if period == "weekly" else F.trunc("ts", "month")
    frame = frame.withColumn("last_close", F.lag("close").over(w.by("symbol"))).where(F.col("ts") >= a)
    first = lambda c: F.min_by(c, "ts")
    long = frame.groupBy("symbol", key.alias("period")).agg(
        F.max("ts").alias("day"), first("open").alias("open"), F.max_by("close", "ts").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"), F.sum("turnover").alias("turnover"), first(F.struct(F.coalesce("last_close", "prev_close").alias("v")))["v"].alias("before"),
    )
    share = lambda x: F.when(F.col("before") != 0, x / F.col("before") * 100)
    return long.withColumns({"change": F.col("close") - F.col("before"), "pct_change": share(F.col("close") - F.col("before")), "amplitude": share(F.col("high") - F.col("low"))}).select("day", F.col("symbol").cast("string").alias("code"), *SHAPE[2:])


def cross_check(fine: DataFrame, coarse: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Volumes of fine and coarse bars side by side for the symbols and days of both; `mismatch` where they differ by more than the tolerance."""
    a, b = fine.groupBy("symbol", "day").agg(F.sum("volume").alias("fine")), coarse.groupBy("symbol", "day").agg(F.sum("volume").alias("coarse"))
    out = a.join(b, ["symbol", "day"]).withColumn("share", F.when(F.col("coarse") > 0, F.col("fine") / F.col("coarse")))
    return out.withColumn("mismatch", F.coalesce(F.abs(F.col("share") - 1) > tolerance, F.lit(True)))
