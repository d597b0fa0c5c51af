"""Op 6, BPE encoding and decoding with a tokenization automaton (see merge_automaton)."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import textarrays as ta
from quantloom.llm.common import documents, small_batches
from quantloom.llm.merge_automaton import WordTokenizer

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text whose distinct words are encoded together.
STEP = 8_000_000


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One compiled automaton for each Python worker and file."""
    return WordTokenizer(path)


def vocabulary_path(name: str) -> str:
    """Where an executor finds a vocabulary file: a name of the public package, or a path as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, digests: bool = False) -> DataFrame:
    """Encodes whole texts and decodes them again: id, n_tokens, ids (decimal, one space between), decoded.

    With ``digests`` the two strings come as SHA-256 hex digests, as ids_sha256 and decoded_sha256.
    Null and empty texts have no tokens, two empty strings; rows are treated alone, so repeated and null
    ids stay as they are; other columns are not read. Memory: one Arrow batch and the words of STEP bytes of it.
    Letters of Unicode versions that differ between Python and the tokenizer file's library may split differently.
    """
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches):
        tok = tokenizer(vocabulary_path(vocabulary))
        for whole in batches:
            for batch in ta.slices(whole, 1, STEP):
                n, *strings = tok.encode_batch(batch.column(1))
                strings = [pa.array([sha256(x.as_buffer()).hexdigest() for x in s], pa.string()) if digests else s.cast(pa.string()) for s in strings]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *strings], names=["id", "n_tokens", *names])

    small_batches(docs.sparkSession, None)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, {names[0]} string, {names[1]} string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), digests=True)
