"""Window kernels.  All frames are ROWS; `prior` frames leave the current row out, so nothing looks ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantloom.functions.expr import col


def by(*keys: str, order: tuple[str, ...] = ("ts",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _stat(kind: str, c: Column) -> Column:
    # median() takes no frame; percentile() does
    return {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std0": F.stddev_pop, "std1": F.stddev_samp, "median": lambda x: F.percentile(x, 0.5)}[kind](c)


def prior(kind: str, c: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Statistic of the n rows before this one, if at least `least` (default n) of them have a value."""
    f = w.rowsBetween(-n, -1)
    return F.when(F.count(col(c)).over(f) >= (n if least is None else least), _stat(kind, col(c)).over(f))


def trailing(kind: str, c: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """The same with this row, over n rows in all."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(f) >= (n if least is None else least), _stat(kind, col(c)).over(f))


def prior_rows(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def change(c: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return col(c) - F.lag(col(c), n).over(w)


def midrank(c: Column, values: Column) -> Column:
    """(number below + half of the number equal) / number, of an array without NULLs."""
    below = F.size(F.filter(values, lambda x: x < c))
    equal = F.size(F.filter(values, lambda x: x == c))
    return (below + 0.5 * equal) / F.size(values).cast("double")


def trailing_percentile(c: str | Column, w: WindowSpec, n: int, least: int) -> Column:
    """Mid-rank percentile of a value among itself and the n - 1 rows before."""
    values = F.collect_list(col(c)).over(w.rowsBetween(-(n - 1), 0))
    return F.when(col(c).isNotNull() & (F.size(values) >= least), midrank(col(c), values))


def prior_percentile(c: str | Column, w: WindowSpec, n: int, least: int) -> Column:
    """Mid-rank percentile of a value among the n rows before it; 0 for a 0 over a history without negative values."""
    values = F.collect_list(col(c)).over(w.rowsBetween(-n, -1))
    rank = F.when((col(c) == 0) & F.forall(values, lambda x: x >= 0), 0.0).otherwise(midrank(col(c), values))
    return F.when(col(c).isNotNull() & (F.size(values) >= least), rank)


#: Rows of a block, blocks of a larger block, of ewm().
BLOCK = 128


def ewm(df: DataFrame, means: dict[str, tuple[str, int]], keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """df with exponentially weighted means (not adjusted), name -> (column, span), over the rows of equal keys; missing values let the old weight decay and repeat the mean.

    A value x after g missing ones turns the mean m into (d m + a x) / (d + a) with a = 2 / (span + 1) and d = (1 - a)^(g + 1): a map m -> A m + B, and maps compose. The map of all rows so far is put
    together from those of the full large blocks before, of the full blocks before in this large block, and of the rows of this block: at most `block` of each are folded for a row
    (large blocks: one for each block^2 rows), so the work is in proportion to the rows.
    """
    s = by(*keys, order=tuple(order))
    row, last = "_ewm_row", Window.unboundedPreceding
    names = {n: f"_ewm_{i}" for i, n in enumerate(means)}
    out = df.withColumn(row, F.row_number().over(s) - 1)
    seen = {n: F.max(F.when(F.col(c).isNotNull(), F.col(row))).over(s.rowsBetween(last, -1)) for n, (c, _) in means.items()}
    steps = {}
    for n, (c, span) in means.items():
        a = 2.0 / (span + 1)
        d = F.pow(F.lit(1 - a), F.col(row) - seen[n])
        step = F.when(F.col(c).isNull(), _map(1.0, 0.0)).when(seen[n].isNull(), _map(0.0, F.col(c))).otherwise(_map(d / (d + a), a * F.col(c) / (d + a)))
        steps[names[n]] = step
        steps[f"{names[n]}_any"] = seen[n].isNotNull() | F.col(c).isNotNull()
    out = out.withColumns(steps)
    k = [*keys, "_ewm_block"]
    out = out.withColumns({"_ewm_block": F.floor(F.col(row) / block), "_ewm_large": F.floor(F.col(row) / block**2)})
    inside, around = by(*k, order=tuple(order)).rowsBetween(last, 0), by(*keys, "_ewm_large", order=tuple(order)).rowsBetween(last, -1)
    out = out.withColumns({m: _composed(F.collect_list(m).over(inside)) for m in names.values()})
    full = (F.col(row) + 1) % block == 0
    out = out.withColumns({f"{m}_b": _composed(F.collect_list(F.when(full, F.col(m))).over(around)) for m in names.values()})
    whole = (F.col(row) + 1) % block**2 == 0
    large = lambda m: F.when(whole, _after(F.col(f"{m}_b"), F.col(m)))
    out = out.withColumns({f"{m}_l": _composed(F.collect_list(large(m)).over(s.rowsBetween(last, -1))) for m in names.values()})
    mean = {n: F.when(F.col(f"{m}_any"), _after(_after(F.col(f"{m}_l"), F.col(f"{m}_b")), F.col(m))["b"]) for n, m in names.items()}
    return out.withColumns(mean).drop(row, "_ewm_block", "_ewm_large", *[f"{m}{x}" for m in names.values() for x in ("", "_any", "_b", "_l")])


def _map(a: float | Column, b: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(a).cast("double").alias("a"), lit(b).cast("double").alias("b"))


def _after(first: Column, then: Column) -> Column:
    """The map `first`, then the map `then`."""
    return F.struct((then["a"] * first["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b"))


def _composed(maps: Column) -> Column:
    return F.aggregate(maps, _map(1.0, 0.0), _after)


def islands(boundary: Column, w: WindowSpec) -> Column:
    """Number of each run of rows; a run starts where boundary holds."""
    return F.sum(boundary.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def persistent(flag: str | Column, w: WindowSpec, n: int) -> Column:
    """Whether flag holds here and on the n - 1 rows before; NULL is false. w: one unbroken run of rows."""
    return F.sum(F.coalesce(col(flag), F.lit(False)).cast("int")).over(w.rowsBetween(-(n - 1), 0)) == n


def running_sum(c: str | Column, w: WindowSpec) -> Column:
    """Sum up to here, NULL where the value is missing; missing values leave the sum as it is."""
    return F.when(col(c).isNotNull(), F.sum(F.coalesce(col(c), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def average_rank(order: WindowSpec, ties: WindowSpec) -> Column:
    """Rank with the mean of the places that equal values share."""
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def drawdown(c: str | Column, w: WindowSpec) -> Column:
    """How far below the running maximum, as a share of it."""
    peak = F.max(col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(peak > 0, 1 - col(c) / peak)
