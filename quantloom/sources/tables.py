"""The given tables as market data: prints, bars, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.expr import date_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_prints(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    """Line items as prints: symbol (supplier), day, price (whole cents), volume, direction, trade_count and an order `seq`: by day, order and line, with `ties` as in the SQL by part and price, too, where these are equal."""
    li = table(spark, sf_dir, "lineitem")
    # one number, so that aggregates by it stay in hash tables: day, order, line
    packed = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * (1 << 47) + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_quantity").alias("volume"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0).alias("direction"),
        F.col("l_linenumber").alias("trade_count"),
        F.col("l_returnflag").alias("flag"),
        (F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice") if ties else packed).alias("seq"),
    )


DAILY_PRINTS = """p AS (
  SELECT l_suppkey AS symbol, l_shipdate::DATE AS day, floor(l_extendedprice * 100 / l_quantity) AS price, l_quantity AS volume,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS direction, l_linenumber AS trade_count, l_returnflag AS flag,
         l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
)"""
_SEQ = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def bars(prints: DataFrame, key: str, start: Column) -> DataFrame:
    """Bars of prints by `key` and the column `start`, as symbol, ts, open, high, low, close, volume, amount."""
    return prints.groupBy(F.col(key).alias("symbol"), start.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount")
    )


def month_bars(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    """One bar for each supplier and month."""
    return bars(daily_prints(spark, sf_dir, ties), "symbol", F.trunc("day", "month"))


def supplier_day_bars(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    """One bar for each supplier and day with prints."""
    return bars(daily_prints(spark, sf_dir, ties), "symbol", F.col("day"))


def _bars_sql(name: str, key: str, start: str) -> str:
    return f"""{name} AS (
  SELECT {key} AS symbol, {start} AS ts, first(price ORDER BY {_SEQ}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_SEQ}) AS close,
         sum(volume) AS volume, sum(price * volume) AS amount FROM p GROUP BY 1, 2
)"""


MONTH_BARS = DAILY_PRINTS + ",\n" + _bars_sql("b", "symbol", "date_trunc('month', day)::DATE")
SUPPLIER_DAY_BARS = DAILY_PRINTS + ",\n" + _bars_sql("b", "symbol", "day")

BAR_MINUTES = 30


def intraday_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prints, their clock folded onto a four-hour trading day: symbol, day, date_key, second, price (whole cents), volume, direction, trade_count, event_id.

    Ten users are one symbol, so there are more symbols in a larger table. A day's seconds are divided by six; the first two hours go to 09:30, the rest to 13:00.
    """
    ev = table(spark, sf_dir, "events")
    folded = F.floor((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))) / 6)
    return ev.select(
        F.concat(F.lit("S"), F.floor(F.col("user_id") / 10).cast("string")).alias("symbol"),
        F.col("ts").cast("date").alias("day"),
        date_key("ts").alias("date_key"),
        F.when(folded < 7200, folded + 34200).otherwise(folded + 39600).cast("int").alias("second"),
        (F.lit(1000.0) + F.floor(F.col("value"))).alias("price"),
        (F.floor(F.col("value") * 100) % 500 + 1).cast("double").alias("volume"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", -1).otherwise(0).alias("direction"),
        (F.floor(F.col("value")) % 4 + 1).alias("trade_count"),
        "event_id",
        "event_type",
    )


INTRADAY_PRINTS = """e AS (
  SELECT 'S' || (user_id // 10) AS symbol, ts::DATE AS day, (year(ts) * 10000 + month(ts) * 100 + day(ts))::INTEGER AS date_key,
         (CASE WHEN f < 7200 THEN f + 34200 ELSE f + 39600 END)::INTEGER AS second, 1000.0::DOUBLE + floor(value) AS price,
         floor(value * 100) % 500 + 1 AS volume,
         CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 WHEN 'view' THEN -1 ELSE 0 END AS direction, (floor(value) % 4 + 1)::BIGINT AS trade_count, event_id, event_type
  FROM (SELECT *, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))::INTEGER // 6 AS f FROM events)
)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of concepts: nations; code, name, exchange."""
    n = table(spark, sf_dir, "nation")
    return n.select((F.lit(885000) + F.col("n_nationkey")).cast("string").alias("code"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") % 2 == 0, "A").otherwise("HK").alias("exchange"), F.col("n_nationkey").alias("key"))


def concept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of concepts: customers by nation; code, member, balance."""
    c = table(spark, sf_dir, "customer")
    return c.select((F.lit(885000) + F.col("c_nationkey")).cast("string").alias("code"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("member"), F.col("c_acctbal").alias("balance"))
