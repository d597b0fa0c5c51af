"""Op 10, sharding by minimax contiguous partition.

Documents of equal text form atomic groups, ordered by their smallest id.  The smallest capacity for which
the ordered groups can be cut into the wanted number of shards is found by binary search; each
try is a greedy walk over prefix sums.  The prefix sums stay in Spark.  The driver holds a bounded sample of
them, exact around the possible cuts: each round narrows the capacities still possible and asks only for
the group boundaries that lie where their cuts can be.  Under that capacity the shards are then cut as near to equal as the known boundaries
allow: each at its share of what is left, unless the rest would no longer fit.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import documents, dropped, with_groups, written

#: Boundaries the driver holds at most, in each round.
BOUNDARIES = 40_000


def ordered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df in range partitions by order, written, with the partition's number as _part: parts are in order and hold their keys whole."""
    return written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()), name)


def _walk(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (prefix sums) with at most capacity in each shard, or None if they don't suffice."""
    cuts, at, total = [], 0, ends[-1]
    for _ in range(shards):
        if at >= total:
            break
        nxt = ends[bisect_right(ends, at + capacity) - 1]
        if nxt <= at:
            return None
        cuts.append(at := nxt)
    return cuts if at >= total else None


def _runs(ends: list[int], size: int, shards: int) -> list[list[int]] | None:
    """Runs of groups (first, past the last, shards for it) when shards hold up to `size` and a larger group stands alone; None if it takes too many."""
    runs, at, i, n = [], 0, 0, 0
    while i < len(ends):
        alone = ends[i] > at + size
        nxt = i + 1 if alone else bisect_right(ends, at + size)
        n += 1
        if n > shards:
            return None
        if runs and not alone and not runs[-1][3]:
            runs[-1][1:3] = nxt, runs[-1][2] + 1
        else:
            runs.append([i, nxt, 1, alone])
        i, at = nxt, ends[nxt - 1]
    return runs


def _even(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts with at most capacity in each shard, sizes near equal; no shard is empty if there are as many groups.

    The least size for which groups over it, standing alone, and shards up to it for the runs between suffice, says how many shards each run gets.
    """
    low, high = 1, capacity
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _runs(ends, mid, shards) else (mid + 1, high)
    runs = _runs(ends, high, shards)
    before = lambda r: ends[r[0] - 1] if r[0] else 0
    for _ in range(shards - sum(r[2] for r in runs)):
        wider = [r for r in runs if r[1] - r[0] > r[2]]
        if wider:
            max(wider, key=lambda r: (ends[r[1] - 1] - before(r)) / r[2])[2] += 1
    return [c for r in runs for c in _even_run(ends[r[0] : r[1]], before(r), capacity, r[2])]


def _even_run(ends: list[int], at: int, capacity: int, shards: int) -> list[int]:
    """Each cut at its share of what is left, or as far beyond it as the rest needs in order to fit."""
    cuts, i = [], -1
    for left in range(shards - 1, -1, -1):
        reach = bisect_right(ends, at + capacity) - 1  # a greedy cut: what follows fits, as it did one shard before
        share = at + (ends[-1] - at) / (left + 1)
        near = bisect_right(ends, share)
        near = near - 1 if near and (near >= len(ends) or share - ends[near - 1] <= ends[near] - share) else near
        high = max(i + 1, min(reach, len(ends) - 1 - left))
        low = min(max(i + 1, near), high)
        while low < high:  # the first boundary from the wanted one on after which the rest fits
            mid = (low + high) // 2
            low, high = (low, mid) if _fits(ends, ends[mid], capacity, left) else (mid + 1, high)
        i, at = low, ends[low]
        cuts.append(at)
    return cuts


def _fits(ends: list[int], at: int, capacity: int, shards: int) -> bool:
    for _ in range(shards):
        if at >= ends[-1]:
            return True
        at = max(at, ends[bisect_right(ends, at + capacity) - 1])
    return at >= ends[-1]


def _smallest(ends: list[int], low: int, high: int, shards: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _walk(ends, mid, shards) else (mid + 1, high)
    return low


def minimax_cuts(sums: DataFrame, total: int, largest: int, shards: int, limit: int = BOUNDARIES) -> list[int]:
    """Prefix sums at which to cut. sums: one row for each group, `upto` the sum of sizes up to and with it.

    Of every cell of `step` units the last boundary is known.  Cuts that are feasible on known boundaries are feasible,
    so the least such capacity is an upper bound; moving optimal cuts to their cells' last boundaries adds less than `step`
    to a shard, so that bound less `step` is a lower one.  The next round asks only where greedy cuts under these
    capacities can lie, in finer cells, until no boundary there is left out.
    """
    low = max(-(-total // shards), largest)
    high = -(-total // shards) + largest
    windows, known, step = [(0, total)], {total}, total + 1
    while True:
        inside = sums.where(F.greatest(*[F.col("upto").between(a, b) for a, b in windows], F.lit(False)))
        width = sum(b - a + 1 for a, b in windows)
        step = 1 if inside.count() <= limit else max(1, min(width // limit, step // 4))
        known |= {r["upto"] for r in inside.groupBy(F.floor(F.col("upto") / step)).agg(F.max("upto").alias("upto")).collect()}
        ends = sorted(known)
        high = _smallest(ends, low, high, shards)
        if step == 1:
            return _even(ends, high, shards)
        low = max(low, high - step)
        windows = _merged(_spans(ends, low, high, shards, step))


def _spans(ends: list[int], low: int, high: int, shards: int, step: int) -> list[tuple[int, int]]:
    """For each cut where greedy cuts lie for capacities from low to high, of boundaries known up to `step`."""
    out, a, b = [], 0, 0
    for _ in range(shards):
        a = max(a, ends[max(0, bisect_right(ends, a + low) - 1)]) if ends[0] <= a + low else a
        i = bisect_right(ends, b + high)
        hidden = i < len(ends) and ends[i] < b + high + step
        b = b + high if hidden else ends[i - 1] if i else b
        out.append((a, min(b, ends[-1])))
    return out


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null): equal texts share a shard, shard sizes are as near equal as contiguous groups allow.

    Groups are equal texts (by SHA-256), ordered by smallest id (null first). Size is UTF-8 bytes plus 1, null text none plus
    1 (crc of the empty text; null and empty form one group). Slots number a shard's rows by (id, crc, size).
    Repeated rows are rows of one group; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = written(rows, "rows")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = ordered(groups, ["first", "key"], "groups")
    parts = {r["_part"]: r for r in groups.groupBy("_part").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).collect()}
    spark, total, before = docs.sparkSession, 0, []
    for p in sorted(parts):
        before.append((p, total))
        total += parts[p]["bytes"]
    if not total:
        return rows.limit(0).select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    offsets = spark.createDataFrame(before, "_part int, offset bigint")  # a row for each partition
    w = Window.partitionBy("_part").orderBy(F.col("first").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, 0)
    sums = groups.join(F.broadcast(offsets), "_part").select("key", "n", (F.sum("bytes").over(w) + F.col("offset")).alias("upto"))
    sums = written(sums, "sums")
    dropped(groups)
    cuts = minimax_cuts(sums, total, max(r["largest"] for r in parts.values()), shards)
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + F.when(F.col("upto") > c, 1).otherwise(0)
    placed = with_groups(rows, sums.select("key", "n", shard.cast("int").alias("shard")), ["key"]).drop("key", "n")
    placed = ordered(placed, ["shard", "doc_id", "text_crc32", "size"], "placed")
    dropped(rows, sums)
    counts, seen = [], dict.fromkeys(range(shards), 0)
    for r in sorted(placed.groupBy("_part", "shard").count().collect(), key=lambda r: (r["_part"], r["shard"])):
        counts.append((r["_part"], r["shard"], seen[r["shard"]]))
        seen[r["shard"]] += r["count"]
    offsets = spark.createDataFrame(counts, "_part int, shard int, offset bigint")
    w = Window.partitionBy("_part", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    out = placed.join(F.broadcast(offsets), ["_part", "shard"]).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.row_number().over(w) - 1 + F.col("offset")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
