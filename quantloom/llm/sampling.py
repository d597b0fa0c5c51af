"""Bounded samples of labelled rows for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import text_fingerprint

#: Slots a label's rows are dealt to, for each row wanted, and at least: with so many, hardly any of the least hashes share one.
SLOTS, LEAST_SLOTS = 8, 4096

def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id's decimal digits leaves 1 modulo 3. A null id: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, rows: int, labels: DataFrame | None = None) -> list[tuple[object, str]]:
    """(label, text) of at most `rows` rows for each label, whole texts of any length, sorted.

    The rows with the least hashes of (doc_id, label, text) are taken, so two runs take the same ones; rows that repeat all three are one row, rows that
    repeat an id with another label or text are rows of their own. docs: doc_id, text, label; or the labels come as a table (doc_id, label). Null ids, texts
    and labels are left out. Ids and fingerprints alone are joined and grouped; texts are read for the chosen ids only. The driver
    holds at most that many ids for each label, then `rows` texts.
    """
    of = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).withColumn("fp", text_fingerprint(F.col("text"))).drop("text")
    if labels is not None:
        of = of.select("doc_id", "fp").join(labels.select("doc_id", "label").distinct(), "doc_id")
    h = F.xxhash64("doc_id", "label", "fp")
    least = of.where("label IS NOT NULL").groupBy("label", F.pmod(h, F.lit(max(rows * SLOTS, LEAST_SLOTS))).alias("slot")).agg(F.min(F.struct(h.alias("h"), "doc_id", "fp")).alias("best"))
    by_label: dict[object, list[tuple[int, int, int]]] = {}
    for r in least.collect():
        by_label.setdefault(r["label"], []).append(tuple(r["best"]))
    chosen: dict[tuple[int, int], list[object]] = {}
    for label, found in by_label.items():
        for _, doc_id, fp in sorted(found)[:rows]:
            chosen.setdefault((doc_id, fp), []).append(label)
    if not chosen:
        return []
    fp = text_fingerprint(F.col("text"))
    texts = docs.where(F.col("doc_id").isin(sorted({i for i, _ in chosen})) & F.col("text").isNotNull()).groupBy("doc_id", fp.alias("fp")).agg(F.min("text").alias("text"))
    return sorted(((label, r["text"]) for r in texts.collect() for label in chosen.get((r["doc_id"], r["fp"]), [])), key=lambda x: (str(x[0]), x[1]))
