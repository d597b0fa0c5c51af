"""Row windows on a stream: each batch is computed together with the last rows of the batches before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers of the whole folders batch=N under a path."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class RowWindows:
    """A function for foreachBatch: compute(rows), with windows by keys over order that look back n rows at most, on the new rows and the last n of each key before them.

    Results go to out/batch=N, the tails for the next batch to tails/batch=N, and rows that come no later than the last of their key to late/batch=N, not computed. A batch that runs again finds the tails
    of the batch before and writes the same folders anew. Tails two batches back are deleted.
    """

    def __init__(self, path: str, keys: list[str], order: str, n: int, compute: Callable[[DataFrame], DataFrame]):
        self.path, self.keys, self.order, self.n, self.compute = path, keys, order, n, compute

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [k for k in _numbers(spark, f"{self.path}/tails") if k < number]
        tails = spark.read.schema(batch.schema).parquet(f"{self.path}/tails/batch={before[-1]}") if before else batch.limit(0)
        last = tails.groupBy(*[F.col(k).alias(f"_of_{k}") for k in self.keys]).agg(F.max(self.order).alias("_last"))
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in self.keys]
        seen = batch.join(last, same, "left").select(*batch.columns, "_last")
        seen.where(F.col(self.order) <= F.col("_last")).drop("_last").write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        new = seen.where(F.col("_last").isNull() | (F.col(self.order) > F.col("_last"))).drop("_last")
        rows = tails.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        self.compute(rows).where("_new").drop("_new").write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")
        back = Window.partitionBy(*self.keys).orderBy(F.col(self.order).desc())
        kept = rows.drop("_new").withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= self.n).drop("_back")
        kept.write.mode("overwrite").parquet(f"{self.path}/tails/batch={number}")
        for k in before[:-1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tails/batch={k}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_row_windows(stream: DataFrame, path: str, keys: list[str], order: str, n: int, compute: Callable[[DataFrame], DataFrame]) -> None:
    """Runs the windows over what is there now, then stops; started again, it goes on where it was."""
    stream.writeStream.foreachBatch(RowWindows(path, keys, order, n, compute)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
