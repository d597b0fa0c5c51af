"""Bars that come out while they are still open.

One query gives each bar anew whenever prints have reached it (update mode), another gives it once the watermark has closed it (append mode); both drop what comes for a bar that
was closed by the batches before the last one (Spark tests late rows against the watermark of the batch before).  A bar
without a closed one is provisional, and its revisions are the batches that changed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.streaming import bars

_KEYS = ("symbol", "start")


def run_provisional(make_stream, path: str, width: str = "30 minutes", late: str = "10 minutes") -> None:
    """Runs both queries over the prints of make_stream() (called once for each) that are there now; started again, they go on."""
    bars.run_updates_to_end(bars.window_bars(make_stream(), width, late=late), f"{path}/updates", f"{path}/checkpoint-updates")
    bars.run_to_end(bars.window_bars(make_stream(), width, late=late), f"{path}/closed", f"{path}/checkpoint-closed")


def provisional_bars(updates: DataFrame, closed: DataFrame) -> DataFrame:
    """Each bar as it is known: symbol, start, n, volume, high, low, revisions, provisional. updates: bars with their batch; closed: bars."""
    values = [c for c in closed.columns if c not in _KEYS]
    newest = updates.groupBy(*_KEYS).agg(F.max_by(F.struct(*values), "batch").alias("x"), (F.count(F.lit(1)) - 1).alias("revisions"))
    final = closed.select(*_KEYS, F.lit(True).alias("_closed"))
    return newest.join(final, list(_KEYS), "left").select(*_KEYS, *[f"x.{c}" for c in values], "revisions", F.col("_closed").isNull().alias("provisional"))


def session_counts(found: DataFrame, n_prints: DataFrame) -> DataFrame:
    """One row: bars, provisional ones, revised ones, prints in bars, and prints that came too late for theirs. n_prints: one row, n."""
    sums = found.agg(F.count(F.lit(1)).alias("n_bars"), F.count_if("provisional").alias("n_provisional"), F.count_if(F.col("revisions") > 0).alias("n_revised"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_prints"))
    return sums.join(n_prints.select(F.col("n").alias("_all"))).select("n_bars", "n_provisional", "n_revised", "n_prints", (F.col("_all") - F.col("n_prints")).alias("n_dropped"))
