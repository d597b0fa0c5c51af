"""Input checks: reasons instead of silent repair, policies for what isn't known, keys that must be unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import ratio, col, first_match, parse_clock, session_class, true

#: Flags of a print and their direction; any other flag is unknown.
DIRECTIONS = {0: 1, 1: -1, 2: 0, 5: 0}
LABELS = {0: "buy", 1: "sell", 2: "neutral", 5: "after_hours"}
#: What providers write for a missing number.
MARKERS = ("", "-", "--", "nan", "none", "null", "n/a")


def resolve(frame: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Renames columns to the fields they are aliases of: an exact name first, then one in any case. A field without a column, or with two, is an error."""
    out = {}
    for field, names in aliases.items():
        found = [c for c in frame.columns if c in (field, *names)] or [c for c in frame.columns if c.casefold() in {n.casefold() for n in (field, *names)}]
        if len(found) != 1:
            raise ValueError(f"{field}: {'no column' if not found else f'columns {found}'}")
        out[field] = found[0]
    return frame.select(*[F.col(f"`{c}`").alias(f) for f, c in out.items()])


def number(raw: str | Column) -> Column:
    """A number from text; markers of missing values, and what is no number, are NULL."""
    c = F.trim(col(raw).cast("string"))
    return F.when(~F.lower(c).isin(*MARKERS), c.try_cast("double"))


def finite(c: str | Column) -> Column:
    return col(c).isNotNull() & ~F.isnan(col(c)) & (F.abs(col(c)) != float("inf"))


def bar_reason(volume: str = "volume") -> Column:
    """Why a bar is not valid, '' if it is: missing_required, non_finite_required, invalid_ohlc_order, negative_volume; the first that holds."""
    cols = ("open", "high", "low", "close", volume)
    absent = F.lit(False)
    strange = F.lit(False)
    for c in cols:
        absent, strange = absent | F.col(c).isNull() | true(F.isnan(c)), strange | true(~finite(c))
    order = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low"))
    return first_match([(absent, "missing_required"), (strange, "non_finite_required"), (~order, "invalid_ohlc_order"), (F.col(volume) < 0, "negative_volume")], "")


def flow_reason() -> Column:
    """Why a bar with print totals is not valid, '' if it is: invalid_ohlcv, invalid_ohlc_order_or_volume, transaction_missing, transaction_zero."""
    ohlcv = F.lit(True)
    for c in ("open", "high", "low", "close", "volume"):
        ohlcv = ohlcv & finite(c)
    order = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low")) & (F.col("volume") >= 0)
    return first_match([(~ohlcv, "invalid_ohlcv"), (~order, "invalid_ohlc_order_or_volume"), (~true("observed"), "transaction_missing"), (~true(F.col("print_volume") > 0), "transaction_zero")], "")


def gate(coverage: tuple[float, float | None] = (0.0, None), large_share: tuple[float, float | None] = (0.0, None)) -> Column:
    """Whether a bar passes the coverage and large-print gates; a gate without a bound is open, one with a bound shuts out NULL."""
    out = F.lit(True)
    for c, (low, high) in (("coverage", coverage), ("large_share", large_share)):
        if low > 0:
            out = out & true(F.col(c) >= low)
        if high is not None:
            out = out & true(F.col(c) <= high)
    return out


def repeated(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, with their number."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require(frame: DataFrame, keys: list[str], reason: Column) -> DataFrame:
    """frame, if no key is repeated and no row has a reason; else an error that names how many there are of each."""
    faults = frame.groupBy(reason.alias("reason")).count().where("reason <> ''").collect()
    if faults:
        raise ValueError("faulty rows: " + ", ".join(f"{r['reason']} {r['count']}" for r in sorted(faults)))
    if not repeated(frame, keys).isEmpty():
        raise ValueError(f"rows repeat {keys}")
    return frame


def print_reason() -> Column:
    """Why a raw print can't be used: invalid_time, missing_field, non_integer_flag, price_or_count; '' if it can. Columns: second, price, raw_volume, trade_count, flag."""
    fields = F.lit(True)
    for c in ("price", "raw_volume", "trade_count", "flag"):
        fields = fields & finite(c)
    return first_match([(F.col("second").isNull(), "invalid_time"), (~fields, "missing_field"), (F.col("flag") % 1 != 0, "non_integer_flag"), ((F.col("price") <= 0) | (F.col("raw_volume") < 0) | (F.col("trade_count") < 0), "price_or_count")], "")


def normalize_prints(raw: DataFrame, lot: int = 100, include: tuple[str, ...] = ("continuous",), unknown: str = "neutral", order: tuple[str, ...] = ("second",)) -> DataFrame:
    """Raw prints (symbol, day, time, price, raw_volume, trade_count, flag, all but the keys as text) with direction, session, whether they count, shares and amount.

    Rows that can't be used come out with their reason and NULLs. A flag that isn't known is neutral, dropped (`drop`) or an error (`error`, raised where the row is met). Flag 5
    is after hours whatever its time says. print_id numbers a symbol's day in order, from 0; `order` should tell all rows apart.
    """
    if unknown not in ("neutral", "drop", "error"):
        raise ValueError("unknown must be neutral, drop or error")
    out = raw.withColumns({"second": parse_clock("time")} | {c: number(c) for c in ("price", "raw_volume", "trade_count", "flag")})
    out = out.withColumn("reason", print_reason())
    ok, flag = F.col("reason") == "", F.col("flag").cast("int")
    known = flag.isin(*DIRECTIONS)
    if unknown == "drop":
        out = out.where(~ok | known)
    direction, label = F.lit(0), F.lit("unknown")
    for k, d in DIRECTIONS.items():
        direction, label = F.when(flag == k, d).otherwise(direction), F.when(flag == k, LABELS[k]).otherwise(label)
    if unknown == "error":
        direction = F.when(ok & ~known, F.raise_error(F.concat(F.lit("unknown flag "), flag.cast("string"))).cast("int")).otherwise(direction)
    session = session_class("second")
    counts = session.isin(*include)
    if "after_hours" not in include:
        counts = counts & (flag != 5)
    shares = F.col("raw_volume") * float(lot)
    out = out.withColumns({k: F.when(ok, c) for k, c in {"direction": direction, "label": label, "session": session, "included": counts, "volume": shares, "amount": F.col("price") * shares}.items()})
    w = Window.partitionBy("symbol", "day").orderBy(*order)
    return out.withColumn("print_id", (F.row_number().over(w) - 1).cast("bigint"))


def split_by_date(frame: DataFrame, train_end: object, valid_end: object, column: str = "ts") -> DataFrame:
    """Adds split: train up to and with train_end, valid up to and with valid_end, then test."""
    c = F.col(column)
    return frame.withColumn("split", F.when(c <= train_end, "train").when(c <= valid_end, "valid").when(c.isNotNull(), "test"))


def minute_key(day: str | Column, minute: str | Column) -> Column:
    """YYYYMMDDHHMM as a number, of a YYYYMMDD key and a minute of the day."""
    m = col(minute)
    return col(day).cast("bigint") * 10000 + (F.floor(m / 60) * 100 + m % 60).cast("bigint")


def complete(columns: list[str]) -> Column:
    """Whether every one of the columns has a finite value: others are not scored."""
    out = F.lit(True)
    for c in columns:
        out = out & true(finite(F.col(c).cast("double")))
    return out


#: Columns that say what came later.
FUTURE = ("entry_open", "exit_open", "entry_minute", "exit_minute", "future_return", "net_return", "label_end", "feature_eligible", "time_aligned", "target_available", "eligible", "reason", "invalid_reason")


def without_labels(frame: DataFrame, labels: tuple[str, ...] = FUTURE) -> DataFrame:
    """frame without the columns that say what came later: nothing that simulates may see them."""
    return frame.drop(*labels)


def month_window(day: str | Column, months: int) -> Column:
    """The first day of a window of calendar months that ends at a day: the same day of an earlier month, or that month's last."""
    return F.add_months(col(day), -months)


def next_business_days(day: str | Column, n: int) -> Column:
    """The n weekdays after a day, in order."""
    ahead = F.transform(F.sequence(F.lit(1), F.lit(n + 2 * (n // 5 + 2))), lambda k: F.date_add(col(day), k))
    return F.slice(F.filter(ahead, lambda d: F.weekday(d) < 5), 1, n)


def finite_json(frame: DataFrame) -> DataFrame:
    """One column, json: each row as an object; NaN and infinities are null, dates are ISO, no key is left out."""
    cells = [F.when(finite(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes]
    return frame.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def print_quality(prints: DataFrame, target: DataFrame, daily: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """For each symbol and day with prints: rows, shares of all sessions and of the continuous one, what lies outside it, shares of the target bars (0 without any) and of the daily bar (NULL without one), the three ratios, and `warnings`: which of them are off by more than the tolerance.

    Each side is summed up before the three meet. prints: symbol, day, session, shares; target, daily: symbol, day, volume.
    """
    sums = prints.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("transaction_rows"), F.coalesce(F.sum("shares"), F.lit(0.0)).alias("shares_all"), F.coalesce(F.sum(F.when(F.col("session") == "continuous", F.col("shares"))), F.lit(0.0)).alias("shares_continuous"))
    bars, day = target.groupBy("symbol", "day").agg(F.sum("volume").alias("target_shares")), daily.groupBy("symbol", "day").agg(F.sum("volume").alias("daily_shares"))
    out = sums.join(bars, ["symbol", "day"], "left").join(day, ["symbol", "day"], "left").withColumn("target_shares", F.coalesce("target_shares", F.lit(0.0)))
    out = out.withColumns({"all_to_daily": ratio("shares_all", "daily_shares"), "continuous_to_daily": ratio("shares_continuous", "daily_shares"), "continuous_to_target": ratio("shares_continuous", "target_shares"), "excluded_shares": F.col("shares_all") - F.col("shares_continuous")})
    off = lambda c, name: F.when(F.abs(F.col(c) - 1) > tolerance, F.lit(name))
    return out.withColumn("warnings", F.array_compact(F.array(off("all_to_daily", "all_differ_from_daily_bar"), off("continuous_to_target", "continuous_differ_from_target_bars"))))


def flag_histogram(prints: DataFrame, known: tuple[int, ...]) -> DataFrame:
    """flag, n, known: how often each flag occurs (NULL too), and whether it is one of the known."""
    return prints.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.coalesce(F.col("flag").isin(*known), F.lit(False)))
