"""Op 1, exact top-k search over binary codes by incremental multi-index hashing.

A code of B bits is cut into m segments, as many as make probes and codes met by them fewest, each with an index of its own.  After all segments have been searched to radius r, every code within
m * (r + 1) - 1 bits of a query has been met, for a code farther in every segment differs in m * (r + 1) bits at least.  The radius grows until
a query's kth verified distance is within that bound; such queries are done, the rest go on, until a query, with the next radius, would have cost more in all (codes met, and PROBE for each probe) than there
are codes: what is still open then is compared with all codes, block by block, so that no query costs more than twice the cheaper way.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import dropped, written

TOP, BITS = 10, 64
#: A probe is a row made, shuffled and looked up; it costs about as much as so many codes met in the join.
PROBE = 16
#: Queries and codes that meet in one row when open queries are compared with all codes.
QUERY_BLOCK, CODE_BLOCK = 1024, 16_384
#: Codes that a segment's value may have in one group of the index; more are dealt to several.
HOT_CODES = 50_000


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """id, code (bigint): bit i is set where component i is over 0; missing, null and NaN components count as 0. Rows with a null vector or id go; a vector with more than `bits` components is an error."""
    v = F.col(vector_col)
    bit = F.transform(v, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(bit, F.lit(0).cast("bigint"), lambda all_, one: all_.bitwiseOR(one))
    code = F.when(F.size(v) > bits, F.raise_error(F.lit(f"a vector has more than {bits} components"))).otherwise(code)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), code.cast("bigint").alias("code"))


def _segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND((1 << width) - 1 if width < 64 else -1)


def segments(bits: int, width: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: about bits / width of them, no two widths more than one apart."""
    return _cut(bits, min(bits, max(1, round(bits / width))))


def _cut(bits: int, m: int) -> list[tuple[int, int]]:
    edges = [bits * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def cheapest_segments(bits: int, codes: int, k: int) -> list[tuple[int, int]]:
    """The segments for which a query is expected to cost least, in codes met by its probes and PROBE for each probe, were codes spread evenly.

    Then the kth nearest of `codes` lies at the least distance d within which codes * P(at most d of the bits differ) reaches k; segments must be searched to the least radius r with m (r + 1) - 1 >= d.
    """
    d, met = 0, codes / 2.0**bits
    while met < k and d < bits:
        d += 1
        met += codes * comb(bits, d) / 2.0**bits
    cost = []
    for m in range(1, bits + 1):
        radius, parts = -(-(d + 1) // m) - 1, _cut(bits, m)
        cost.append((sum((PROBE + codes / 2.0**w) * sum(comb(w, i) for i in range(min(radius, w) + 1)) for _, w in parts), m))
    return _cut(bits, min(cost)[1])


def radius_cost(parts: list[tuple[int, int]], radius: int, codes: int) -> float:
    """What one query costs at this radius alone: its probes, and the codes they are expected to meet, were codes spread evenly."""
    return sum((PROBE + codes / 2.0**w) * comb(w, radius) for _, w in parts)


def _scanned(queries: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """q, code, distance of at least the k codes nearest to each query by (distance, first id), for each block of codes: both sides are dealt to blocks, and each two meet in one row."""

    def blocks(size: int):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, part.num_rows], c) for c in part.columns], names=part.schema.names)

        return run

    def nearest(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q, code, first = (np.asarray(batch.column(c)[row].values) for c in ("q", "code", "first"))
                order = np.argsort(first, kind="stable")
                code = code[order]
                for at in range(0, len(q), 64):
                    some = q[at : at + 64]
                    # of a signed number bitwise_count takes the absolute value
                    far = np.bitwise_count((some[:, None] ^ code[None, :]).view(np.uint64))
                    # ties by first id: codes are in that order
                    best = np.argsort(far, axis=1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, best.shape[1])), pa.array(code[best].ravel()), pa.array(np.take_along_axis(far, best, 1).ravel().astype(np.int32))], names=["q", "code", "distance"])

    q = queries.select("q").mapInArrow(blocks(QUERY_BLOCK), "q array<bigint>")
    c = codes.select("code", F.col("ids")[0].alias("first")).mapInArrow(blocks(CODE_BLOCK), "code array<bigint>, first array<bigint>")
    return c.crossJoin(q).mapInArrow(nearest, "q bigint, code bigint, distance int")


def _indexed(codes: DataFrame, parts: list[tuple[int, int]], hot_codes: int) -> tuple[DataFrame, DataFrame]:
    """The index (seg, value, lot, code, first), and how many lots a hot (seg, value) has."""
    index = codes.select("code", F.col("ids")[0].alias("first"), F.posexplode(F.array(*[_segment(F.col("code"), at, w) for at, w in parts])).alias("seg", "value"))
    crowded = written(index.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_codes).select("seg", "value", F.ceil(F.col("n") / hot_codes).cast("int").alias("lots")), "crowded")
    index = index.join(crowded, ["seg", "value"], "left").withColumn("lot", F.coalesce(F.pmod(F.xxhash64("code"), F.col("lots")), F.lit(0)).cast("int")).drop("lots")
    return written(index, "index"), crowded


def _probed(open_queries: DataFrame, index: DataFrame, crowded: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """q, code, first, distance: the codes that lie at this radius in some segment and within cap, each once."""
    m = len(parts)
    probes = None
    for j, (at, size) in enumerate(parts):
        if radius <= size:
            masks = np.array([sum(1 << b for b in c) for c in combinations(range(size), radius)], np.uint64).view(np.int64)
            own = open_queries.select("q", "cap", F.lit(j).alias("seg"), F.explode(F.lit(masks)).alias("mask")).select("q", "cap", "seg", _segment(F.col("q"), at, size).bitwiseXOR(F.col("mask")).alias("value"))
            probes = own if probes is None else probes.unionByName(own)
    probes = probes.join(crowded, ["seg", "value"], "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
    # the planner takes probes for as small as their queries: keep it from broadcasting them
    met = probes.join(index.hint("shuffle_hash"), ["seg", "value", "lot"])
    # each code once: at the least distance over its segments, in the first segment that has it
    far = [F.bit_count(_segment(F.col("q").bitwiseXOR(F.col("code")), at, size)) for at, size in parts]
    once = F.lit(True)
    for j in range(m):
        once = once & F.when(F.col("seg") > j, far[j] > radius).otherwise(far[j] >= radius)
    # what is farther than the kth found so far is of no use: Spark tests this in the join
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
    return met.where(once & (distance <= F.col("cap"))).select("q", "code", "first", distance.alias("distance"))


def hamming_top_k(items: DataFrame, queries: DataFrame, k: int = TOP, bits: int = BITS, width: int | None = None, hot_codes: int = HOT_CODES) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k items nearest to each query, ties by id; fewer if there are fewer items. items, queries: id, code.

    Equal codes are one entry with its k smallest ids, so a vector that a third of the rows share costs one entry; equal queries are one
    query. Repeated rows count once for each row. Segments are those that cost least by cheapest_segments() unless `width` says otherwise; codes that share a
    segment's value beyond `hot_codes` are dealt to lots, and probes go to each of them.
    """
    w = Window.partitionBy("code").orderBy("id")
    first = items.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)  # cut before the shuffle, too
    codes = written(first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = written(queries.select(F.col("code").alias("q")).distinct().withColumn("cap", F.lit(bits)), "queries")
    seen = codes.agg(F.sum(F.size("ids")).alias("n"), F.count(F.lit(1)).alias("codes")).first()
    wanted = min(k, seen["n"] or 0)
    parts = segments(bits, width) if width else cheapest_segments(bits, seen["codes"], wanted)
    m, widest = len(parts), max(x for _, x in parts)
    index, crowded = _indexed(codes, parts, hot_codes)
    best, open_queries, radius = None, asked, 0
    done, spent = [], [codes, index, crowded, asked]
    w = Window.partitionBy("q").orderBy("distance", "id")
    scan, cost = False, 0.0
    while not scan:
        cost += radius_cost(parts, radius, seen["codes"])
        scan = radius > widest or cost > seen["codes"]
        new = _scanned(open_queries, codes, k) if scan else _probed(open_queries, index, crowded, parts, radius)
        # the k ids wanted are among the k codes nearest by (distance, smallest id)
        if scan:
            new = new.join(codes.select("code", F.col("ids")[0].alias("first")), "code")
        near = Window.partitionBy("q").orderBy("distance", "first")
        new = new.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).select("q", "code", "distance")
        new = new.join(codes, "code").select("q", F.explode("ids").alias("id"), "distance")
        if best is not None and not scan:
            new = new.unionByName(best)
        ranked = written(new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), f"radius-{radius}")
        covered = m * (radius + 1) - 1
        state = ranked.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        over = written(state.where((F.col("n") >= wanted) & (F.col("kth") <= covered)).select("q") if not scan else asked.select("q"), "covered")
        done.append(ranked.join(over, "q", "left_semi"))
        best = ranked.join(over, "q", "left_anti").drop("rank")
        cap = F.when(F.col("n") >= wanted, F.col("kth")).otherwise(F.lit(bits))
        open_queries = open_queries.select("q").join(over, "q", "left_anti").join(state, "q", "left")
        open_queries = written(open_queries.select("q", F.coalesce(cap, F.lit(bits)).alias("cap")), "open")
        spent += [ranked, over, open_queries]
        radius += 1
        if open_queries.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = written(queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(out, "q").select("query_id", "rank", "id", "distance"), "nearest")
    dropped(*spent)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = written(sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "sign-codes")
    return hamming_top_k(codes, codes.where("id % 50 = 0")).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (coalesce(q.embedding[i], 0) > 0) <> (coalesce(e.embedding[i], 0) > 0) THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
