"""From raw documents to packed sequences, in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import op03_substring, op04_near_dup, op05_language, op08_packing, op09_exact_dedup
from quantloom.llm.common import documents, text_fingerprint, written

#: The near-duplicate stage: words of a shingle, similarity in hundredths.
SHINGLE, THRESHOLD = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter (null texts too); lang becomes the predicted one where it is null.

    The predicted language is the nearest of those learned, also for a text in none of them: foreign texts stay. If none could be learned (no row has
    both a lang and a text to learn from), lang becomes `und`.
    """
    sample = op05_language.train(docs)
    # without a sample every text is `und`, those with a letter too
    lettered = F.col("lang_pred") != op05_language.UNKNOWN if sample else F.coalesce(F.col("row.text"), F.lit("")).rlike(r"\p{L}")
    out = op05_language.identify(docs, sample, carry=True).where(lettered)
    return out.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays, then the smallest doc_id; of rows that repeat an id and a text one stays.

    Rows are told apart by doc_id and a 64-bit fingerprint of the text.
    """
    groups = op09_exact_dedup.exact_groups(docs, fingerprints=True)
    marks = groups.groupBy(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).agg(F.max("kept").alias("__stays"), F.count(F.lit(1)).alias("__rows"))
    marks = written(marks.where("NOT __stays OR __rows > 1"), "marks")
    same = docs["doc_id"].eqNullSafe(marks["__id"]) & (text_fingerprint(F.col("text")) == marks["__fp"])
    out = docs.join(marks.where("NOT __stays"), same, "left_anti")
    repeated = marks.where("__stays")
    if repeated.isEmpty():
        return out
    return out.join(repeated, same, "left_anti").unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return op04_near_dup.keep_one_of_each(docs, shingle=SHINGLE, threshold=THRESHOLD)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document that loses every word goes, one that loses none keeps its text as it is."""
    out = op03_substring.remove_repeats(docs, carry=True).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast("bigint")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return op08_packing.pack_documents(docs)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]

#: The stages learn, and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
