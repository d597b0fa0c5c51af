"""A cache of responses as a log: batches are appended and never changed, the newest word on a key counts, tombstones clear.

A batch is a folder of Parquet files; a compaction writes what is live as one more batch and then deletes those it has read, the oldest first, so that an entry goes before its tombstone. Whatever
is read in between, before or after, gives the same entries; batches put meanwhile are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: key: see expr.canonical_key. deleted: a tombstone.
SCHEMA = "key string, source string, row_count bigint, payload string, stored_at timestamp, deleted boolean"


class ResponseCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _batches(self) -> list[str]:
        """Folders of whole batches, the oldest first."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
        return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _append(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        number = max([int(b.rsplit("/", 1)[1].split("-")[1]) for b in self._batches()], default=0) + 1
        rows.select(*names).write.parquet(f"{self.path}/batch-{number:08d}-{uuid.uuid4().hex}")

    def _log(self) -> DataFrame:
        batches = self._batches()
        return self.spark.read.schema(SCHEMA).parquet(*batches) if batches else self.spark.createDataFrame([], SCHEMA)

    def put(self, entries: DataFrame) -> None:
        """entries: key, source, row_count, payload, stored_at. Without a key or a time nothing is stored."""
        self._append(entries.where("key IS NOT NULL AND stored_at IS NOT NULL").withColumn("deleted", F.lit(False)))

    def live(self) -> DataFrame:
        """The newest entry of each key that is not cleared: by stored_at, a tombstone over an entry of its time, then by payload. One aggregate, no window."""
        newest = F.max_by(F.struct("source", "row_count", "payload", "stored_at", "deleted"), F.struct("stored_at", "deleted", F.coalesce("payload", F.lit("")), F.coalesce("row_count", F.lit(0))))
        return self._log().groupBy("key").agg(newest.alias("x")).where("NOT x.deleted").select("key", "x.source", "x.row_count", "x.payload", "x.stored_at")

    def get(self, requests: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
        """requests (key, start, count) with `hit` and, of a hit, the payload: an entry of the key with start + count rows at least, no older than the time to live and not from the future."""
        age = F.lit(now).cast("timestamp").cast("bigint") - F.col("stored_at").cast("bigint")
        hit = F.coalesce((F.col("row_count") >= F.col("start") + F.col("count")) & age.between(0, ttl_seconds), F.lit(False))
        found = requests.join(self.live(), "key", "left").withColumn("hit", hit)
        return found.select(*requests.columns, "hit", F.when(F.col("hit"), F.col("payload")).alias("payload"))

    def clear(self, at: str, source: str | None = None, before: str | None = None) -> DataFrame:
        """Clears the entries of a source, or stored before a time, or both (all without either), with tombstones of the time `at`; returns source, n of what goes. An entry stored after `at` stays."""
        gone = F.col("stored_at") <= F.lit(at).cast("timestamp")
        if source is not None:
            gone = gone & F.col("source").eqNullSafe(source)
        if before is not None:
            gone = gone & (F.col("stored_at") < F.lit(before).cast("timestamp"))
        stones = self.live().where(gone).select("key", "source", F.lit(0).cast("bigint").alias("row_count"), F.lit(None).cast("string").alias("payload"), F.lit(at).cast("timestamp").alias("stored_at"), F.lit(True).alias("deleted"))
        seen = set(self._batches())
        self._append(stones)
        added = [b for b in self._batches() if b not in seen]
        return self.spark.read.schema(SCHEMA).parquet(*added).where("deleted").groupBy("source").agg(F.count(F.lit(1)).alias("n"))

    def stats(self) -> DataFrame:
        """source, n, rows (0 without any), newest."""
        return self.live().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.max("stored_at").alias("newest"))

    def compact(self) -> None:
        """One batch of the live entries takes the place of those there were."""
        old = self._batches()
        if not old:
            return
        self._append(self.live().withColumn("deleted", F.lit(False)))
        jvm = self.spark._jvm
        for b in old:
            p = jvm.org.apache.hadoop.fs.Path(b)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
