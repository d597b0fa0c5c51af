"""Op 9, exact dedup by deterministic block naming.

A normalised text is cut into blocks of fixed size.  The distinct blocks are sorted, and a block's name is its place in the order: equal blocks get
the same integer and different blocks different ones.  Then adjacent names are paired and the distinct pairs sorted and named the same way,
level by level, until one integer stands for the whole text.

The order of blocks is by their 64-bit hash, then by their bytes.  So the bytes are shuffled once, combined before the shuffle, to find the hashes that
two or more different blocks share; their bytes alone take part in the sort, which for all others goes by the hash.  A hash collision costs a
look-up but never joins two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import SPACES, documents, dropped, numbered, text_fingerprint, with_groups, written

#: Bytes of a block.
BLOCK = 2048
_KEY = ["doc_id", "n_chars", "fp", "text_sha256", "n_blocks"]


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int, bits: int) -> DataFrame:
    """doc_id, n_chars, fp (of the text as it is), text_sha256, n_blocks, pos, bucket, block: one row for each block; an empty text has one empty block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n_chars"), text_fingerprint(text).alias("fp"), F.encode(F.translate(text, SPACES, ""), "utf-8").alias("data"))
    whole = whole.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.length("data") / block)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.substring(F.col("data"), k * block + 1, F.lit(block)))
    cut = whole.select("doc_id", "n_chars", "fp", F.sha2("data", 256).alias("text_sha256"), "n_blocks", F.posexplode(pieces).alias("pos", "block"))
    mask = -1 if bits >= 64 else (1 << bits) - 1
    return cut.withColumn("bucket", F.xxhash64("block").bitwiseAND(F.lit(mask).cast("bigint")))


def _block_names(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (doc_id, ..., pos, bucket) with `name`, the place of its block among the distinct ones. cut: the same rows with the blocks."""
    buckets = written(cut.groupBy("bucket").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count(F.lit(1)).alias("n")).select("bucket", "n", (F.col("low") != F.col("high")).alias("crowded")), "buckets")
    crowded = buckets.where("crowded").select("bucket")
    if crowded.isEmpty():
        names = numbered(buckets.select("bucket", "n"), ["bucket"], "block-names")
        out = written(with_groups(rows, names.withColumnRenamed("number", "name"), ["bucket"]).drop("n", "bucket"), "named")
        dropped(names, buckets)
        return out
    # blocks of shared hashes: with their rank among the blocks of the hash, by bytes
    full = cut.join(crowded, "bucket", "left_semi")
    ranks = full.select("bucket", "block").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("block")))
    ranked = full.join(ranks, ["bucket", "block"]).select(*_KEY, "pos", "bucket", "rank")
    every = written(rows.join(crowded, "bucket", "left_anti").select(*_KEY, "pos", "bucket", F.lit(1).alias("rank")).unionByName(ranked), "ranked")
    names = numbered(every.groupBy("bucket", "rank").agg(F.count(F.lit(1)).alias("n")), ["bucket", "rank"], "block-names")
    out = written(with_groups(every, names.withColumnRenamed("number", "name"), ["bucket", "rank"]).drop("n", "bucket", "rank"), "named")
    dropped(every, names, buckets)
    return out


def named_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """id, n_chars, fp, text_sha256, n_blocks, name: (n_blocks, name) is equal exactly for equal normalised texts.

    ``bits`` below 64 forces hash collisions, for tests.
    """
    cut = _blocks(docs, id_col, text_col, block, bits)
    rows = written(cut.drop("block"), "blocks")
    named = _block_names(rows, cut)
    dropped(rows)
    longest = named.agg(F.max("n_blocks").alias("n")).first()["n"] or 1
    out = [named.where("n_blocks = 1").select(*_KEY, F.lit(1).cast("bigint").alias("copies"), "name")]
    # rows that repeat an id and its text travel as one from here on, with their number
    level = named.where("n_blocks > 1").withColumn("copies", F.lit(1).cast("bigint"))
    size = 1
    while size < longest:
        size *= 2
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = level.groupBy(*_KEY, F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(F.sum(F.when(F.col("pos") % 2 == 0, F.col("copies"))).alias("copies"), side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        pairs = written(pairs.withColumnRenamed("half", "pos"), "pairs")
        names = numbered(pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")), ["left", "right"], "pair-names")
        level = written(with_groups(pairs, names.withColumnRenamed("number", "name"), ["left", "right"]).drop("n", "left", "right"), "named")
        dropped(pairs, names)
        out.append(level.where(F.col("n_blocks") <= size).select(*_KEY, "copies", "name"))
        level = level.where(F.col("n_blocks") > size)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    whole = whole.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")
    return whole.withColumnRenamed("doc_id", id_col)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64, fingerprints: bool = False) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256; with `fingerprints` fp (of the text as it is), too.

    Texts are equal when identical without the characters of ``SPACES``; null counts as empty. Of a group the
    row with the most code points stays, then the smallest id (null ids last). Rows that repeat an id are
    rows of their own; if the winning id has several texts of the winner's length, the one with the least fingerprint stays; rows that repeat the
    winner's id and text are all kept. Other columns are not read.
    """
    ident = ["n_blocks", "name"]
    rows = written(named_identities(docs, id_col, text_col, block, bits).withColumnRenamed(id_col, "doc_id"), "identities")
    # the smallest of (-length, id), null ids last; combined before the shuffle
    best = rows.groupBy(*ident).agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("fp").alias("d"))).alias("best"))
    out = with_groups(rows, written(best, "groups"), ident, "group_size").select(
        "doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(F.col("best.c")) & (F.col("n_chars") == -F.col("best.a")) & (F.col("fp") == F.col("best.d"))).alias("kept"), "text_sha256", *(["fp"] if fingerprints else [])
    )
    return out.withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents
), g AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
         first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM g
"""
