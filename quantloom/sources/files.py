"""Readers of plain files: lists of symbols, frames of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.registry import source


@source("symbol_list", "symbols in text files, one a line, with # comments")
def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """position, symbol: what stands before a # in each line, without blanks around; empty lines are left out, and a symbol counts where it comes first. Positions go up with the lines of a file, files by their order of reading; they have gaps."""
    lines = spark.read.text(path).withColumn("position", F.monotonically_increasing_id())
    named = lines.select(F.trim(F.substring_index("value", "#", 1)).alias("symbol"), "position").where("symbol <> ''")
    return named.groupBy("symbol").agg(F.min("position").alias("position")).select("position", "symbol")


@source("feature_frame", "features in Parquet or CSV files")
def feature_frame(spark: SparkSession, path: str, required: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """A frame from Parquet, or, where the path ends in .csv, from CSV with a header (types by `schema`, else found in the data). Lacking `required` columns is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").lower().endswith(".csv"):
        # a column lacking in the header would be read as the next one: compare before applying a schema
        header = spark.read.option("header", True).csv(path).columns
        missing = sorted(set(required) - set(header))
        out = None if missing else reader.options(header=True, inferSchema=schema is None, enforceSchema=False, mode="FAILFAST").csv(path)
    else:
        out = reader.parquet(path)
        missing = sorted(set(required) - set(out.columns))
    if missing:
        raise ValueError(f"{path} is missing columns: {', '.join(missing)}")
    return out
