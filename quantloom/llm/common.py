"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources.shared import dropped, new_path, removed, shared_dir, written  # noqa: F401  (for the operators)

#: Separators of words: space and the ASCII controls TAB to CR.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written in order, with `number`: its place in the order, from 0 without gaps.

    Range partitions are sorted each in its own task; the driver adds up one count for each of them.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    offsets, total = [], 0
    for r in sorted(parts.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["count"]
    before = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")  # a row for each partition
    w = Window.partitionBy("_part").orderBy(*keys)
    out = written(parts.join(F.broadcast(before), "_part").withColumn("number", F.row_number().over(w) - 1 + F.col("_before")).drop("_part", "_before"), f"{name}-numbered")
    dropped(parts)
    return out


#: A group with more than this share of all rows is hot: there are fewer than HOT of them.
HOT = 1000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """rows joined to their groups (one row for each key, with the number of its rows), every key of rows being there.

    Hot groups, under HOT in number, are broadcast, so their rows stay where they are; the others meet in a shuffle. Both tables are written ones: each is read twice.
    """
    total = groups.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot, cold = groups.where(F.col(count) * HOT > total), groups.where(F.col(count) * HOT <= total)
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(cold, keys))


#: Bytes of an Arrow batch of whole texts; a longer row is a batch alone.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int | None = 1000) -> None:
    """Python workers keep one Arrow batch, and what they make of it, in memory: lowers, never raises, the session's bound on its bytes and (if given) on its rows.

    Spark reads both settings when a query is planned, so they can't be given to one query alone; results don't depend on them.
    """
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", rows)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None) or ""
        if most and not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= most):
            spark.conf.set(key, str(most))


def text_fingerprint(text):
    """64 bits of a text, null for null: tells apart rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def partitions_for(n_bytes: int, each: int, least: int = 1) -> int:
    """As many pieces as keep each one within `each` bytes."""
    return max(least, -(-int(n_bytes or 0) // each))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one number, from a scan of one column."""
    return int(docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0)
