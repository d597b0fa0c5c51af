"""Catalogues, caches and journals: lookups, completeness, search, latest-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import first_match, ratio


def member_counts(members: DataFrame) -> DataFrame:
    """For each code: rows, distinct members, members with a negative balance, and whether a member is listed twice."""
    return members.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("member").alias("n_members"), F.sum(F.when(F.col("balance") < 0, 1).otherwise(0)).alias("n_negative")).withColumn("repeated", F.col("n_rows") > F.col("n_members"))


def with_member_counts(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Catalogue entries with their counts, most members first, entries without any last; one row for each entry."""
    return catalog.join(counts, "code", "left").orderBy(F.col("n_members").desc_nulls_last(), "code")


def incomplete(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Codes in one of the two only, with the side they miss from."""
    a, b = catalog.select("code"), counts.select("code")
    return a.join(b, "code", "left_anti").withColumn("missing_from", F.lit("members")).unionByName(b.join(a, "code", "left_anti").withColumn("missing_from", F.lit("catalog")))


def concept_filter(catalog: DataFrame) -> DataFrame:
    """Concepts of the exchange `A` whose code begins with 885 or 886."""
    return catalog.where((F.col("exchange") == "A") & F.left("code", F.lit(3)).isin("885", "886")).select("code", "name")


def concepts_of(raw: DataFrame) -> DataFrame:
    """Concepts of a raw catalogue (code, name, exchange, index_type): exchange `A`, type `concept`, a code from 885 or 886 with the suffix .TI; codes trimmed and in capitals, names trimmed."""
    code = F.col("code").cast("string")
    kept = raw.where((F.col("exchange") == "A") & (F.col("index_type") == "concept") & F.left(code, F.lit(3)).isin("885", "886") & (F.right(code, F.lit(3)) == ".TI"))
    return kept.select(F.upper(F.trim(code)).alias("code"), F.trim(F.col("name").cast("string")).alias("name"))


def catalog_faults(catalog: DataFrame) -> DataFrame:
    """fault, value, n: `empty` codes or names, `duplicate_code`, `duplicate_name`; nothing for a sound catalogue."""
    void = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    empty = catalog.where(void("code") | void("name")).groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("empty").alias("fault"), F.lit("").alias("value"), "n")
    twice = lambda c: catalog.where(~void(c)).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"duplicate_{c}").alias("fault"), "value", "n")
    return empty.unionByName(twice("code")).unionByName(twice("name"))


def checked_catalog(raw: DataFrame) -> DataFrame:
    """The concepts of a raw catalogue, by code; an empty catalogue, empty or repeated codes and names are errors."""
    out = concepts_of(raw)
    if out.isEmpty():
        raise ValueError("the catalogue has no concepts")
    faults = catalog_faults(out).limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r['fault']} {r['value']} ({r['n']})" for r in faults))
    return out.orderBy("code")


def unique_match(catalog: DataFrame, column: str, wanted: str) -> DataFrame:
    """The entry whose column equals `wanted`: two rows at most are read, so that an ambiguous name is seen."""
    return catalog.where(F.col(column) == wanted).limit(2)


def search(assets: DataFrame, text: str, limit: int) -> DataFrame:
    """Assets whose code or name holds the text in any case, by code."""
    low = text.lower()
    return assets.where(F.lower("code").contains(low) | F.lower("name").contains(low)).orderBy("code").limit(limit)


def latest(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest entry of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's first row, in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def cache_stats(entries: DataFrame, by: str, size: str, stamp: str) -> DataFrame:
    return entries.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("total_rows"), F.max(stamp).alias("newest"))


def tail_slice(rows: DataFrame, key: str, order: list[str], start: int, count: int) -> DataFrame:
    """For each key `count` rows that end `start` rows before the newest; keys with fewer than start + count rows miss."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    numbered = rows.withColumns({"_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return numbered.where((F.col("_n") > start) & (F.col("_n") <= start + count) & (F.col("_all") >= start + count)).drop("_n", "_all")


def repeated_pages(rows: DataFrame, page: str, content: list[str]) -> DataFrame:
    """Pages with the same rows as an earlier page.

    The number of rows and a sum of their hashes only say which pages to compare; a page is one if none of its rows, counted, is missing from the other.
    """
    h = F.xxhash64(*content)
    pages = rows.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("digest"))
    w = Window.partitionBy("n", "digest").orderBy(page)
    like = pages.withColumns({"_n": F.row_number().over(w), "first_page": F.first(page).over(w)}).where(F.col("_n") > 1).select(page, "first_page", "n")
    counted = rows.groupBy(page, *content).agg(F.count(F.lit(1)).alias("_times"))
    mine, first = like.join(counted, page), counted.withColumnRenamed(page, "first_page").withColumnRenamed("_times", "_there")
    both = mine.join(first, ["first_page", *content], "left").groupBy(page, "first_page", "n").agg(F.min(F.coalesce(F.col("_times") == F.col("_there"), F.lit(False))).alias("same"))
    return both.where("same").drop("same")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Totals of two sources side by side, for the keys of either; `mismatch` where they differ by more than the tolerance or one is absent. An absent total stays NULL."""
    left, right = a.groupBy(*keys).agg(F.sum(value).alias("left_total")), b.groupBy(*keys).agg(F.sum(value).alias("right_total"))
    out = left.join(right, keys, "full").withColumn("share", ratio("right_total", "left_total"))
    return out.withColumn("mismatch", F.coalesce(F.abs(F.col("share") - 1) > tolerance, F.lit(True)))


def long_form(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, item, value: one row for each column that has a value."""
    return frame.unpivot(keys, columns, "item", "value").where("value IS NOT NULL")


def freshness(entries: DataFrame, stamp: str, now: object, ttl_days: int) -> DataFrame:
    """fresh, stale or future, by an entry's age against its time to live."""
    age = F.datediff(now, F.col(stamp))
    return entries.withColumn("state", first_match([(age < 0, "future"), (age <= ttl_days, "fresh")], "stale"))
