"""A journal of analyses as JSON files, one line for each record, in folders by code and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "code string, analysis_date date, as_of date, stance string, title string, trigger double, stop double, target double, tags array<string>, version int"
VERSION = 1
STANCES = ("bullish", "bearish", "neutral")


def write(records: DataFrame, path: str) -> None:
    """Writes records (the columns of SCHEMA) under path/code=.../day=...; each folder that gets records is replaced by Spark's commit, others stay as they are."""
    out = records.withColumns({"_code": F.col("code"), "day": F.col("analysis_date").cast("string")}).withColumnRenamed("_code", "folder")
    # one task for each folder's rows: a folder gets few files
    out.repartition("folder", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("folder", "day").json(path)


def read(spark: SparkSession, path: str, names: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Records that are sound, and a warning (path, warning) for each line that isn't: corrupt, version, missing field, stance, or a code or day other than its folder's. names: of the files."""
    raw = spark.read.schema(f"{SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, pathGlobFilter=names)
    raw = raw.withColumns({"path": F.col("_metadata.file_path"), "_folder": F.regexp_extract(F.col("_metadata.file_path"), "folder=([^/]*)", 1), "_day": F.regexp_extract(F.col("_metadata.file_path"), "day=([^/]*)", 1)})
    warning = (
        F.when(F.col("_corrupt").isNotNull(), "corrupt")
        .when(~F.col("version").eqNullSafe(VERSION), "version")
        .when(F.col("code").isNull() | F.col("analysis_date").isNull() | F.col("as_of").isNull() | F.col("title").isNull() | (F.trim("title") == ""), "missing_field")
        .when(~F.col("stance").isin(*STANCES) | F.col("stance").isNull(), "stance")
        .when((F.col("code") != F.col("_folder")) | (F.col("analysis_date").cast("string") != F.col("_day")), "misplaced")
    )
    seen = raw.withColumn("warning", warning)
    return seen.where("warning IS NULL").select(*[c.split()[0] for c in SCHEMA.split(", ")]), seen.where("warning IS NOT NULL").select("path", "warning")


def search(records: DataFrame, code: str | None = None, start: str | None = None, end: str | None = None, text: str | None = None) -> DataFrame:
    """Records of a code, of days from start to end, that hold a text in any case in code, stance, title or tags; newest day first, then by code."""
    out = records
    if code:
        out = out.where(F.col("code") == code)
    if start:
        out = out.where(F.col("analysis_date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("analysis_date") <= F.lit(end).cast("date"))
    if text:
        out = out.where(F.lower(F.concat_ws(" ", "code", "stance", "title", F.array_join("tags", " "))).contains(text.lower()))
    return out.orderBy(F.col("analysis_date").desc(), "code")


def clear(entries: DataFrame, source: str | None = None, before: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays of cache entries (source, stored_at) when those of a source, or stored before a day, or both, are cleared; and how many go, by source."""
    gone = F.lit(True)
    if source:
        gone = gone & F.col("source").eqNullSafe(source)
    if before:
        gone = gone & F.coalesce(F.col("stored_at") < F.lit(before).cast("timestamp"), F.lit(False))
    return entries.where(~gone), entries.where(gone).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def cache_hits(requests: DataFrame, entries: DataFrame, now: str, ttl_days: int) -> DataFrame:
    """Requests with `hit`: whether an entry of their key holds start + count rows at least and is not older than ttl_days. requests: key, start, count; entries: key, row_count, stored_at (one a key)."""
    age = F.datediff(F.lit(now).cast("date"), F.col("stored_at").cast("date"))
    return requests.join(entries, "key", "left").withColumn("hit", F.coalesce((F.col("row_count") >= F.col("start") + F.col("count")) & age.between(0, ttl_days), F.lit(False))).drop("row_count", "stored_at")
