"""Op 11, token ids in a binary format: one static table of frequencies, independent blocks of interleaved rANS lanes with checkpoints and checksums.

A written corpus is a folder of two Parquet tables.  `table` holds the frequency of each id.  `blocks` has a row for each block of up to
rans.BLOCK ids: where it lies (part, block, first id in the whole order), the coded words, the checkpoints, a CRC-32 over both, and the documents whose ids it
holds (id, row in the part, number of ids there, whether more of it lies in other blocks).  Blocks are cut by number of ids, so a very long document is spread over many and no block grows with
it; each decodes alone, in any task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import pieces, rans
from quantloom.llm import textarrays as ta
from quantloom.llm.common import documents, dropped, new_path, removed, small_batches, text_fingerprint, written
from quantloom.llm.op06_bpe import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Id after each document; bits of the frequency table.
END, BITS = 0, 18
#: Bytes of text whose distinct words are encoded together.
STEP = 16_000_000


def _block(part: int, block: int, ids: np.ndarray, docs: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    column = lambda i, kind: pa.array([[d[i] for d in docs]], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<u4").tobytes()], pa.binary()), column(0, doc_type), column(1, pa.int64()), column(2, pa.int32()), column(3, pa.bool_())],
        names=["part", "block", "n", "ids", "doc_ids", "doc_rows", "doc_sizes", "doc_split"],
    )


def _blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end: int) -> DataFrame:
    """Ids of documents in ascending order, in blocks of rans.BLOCK: range partitions of (id, fingerprint), each sorted and cut by one task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = pieces.byte_level(vocabulary_path(vocabulary), False)
        part, block, row, held, inside, size = None, 0, 0, [], [], 0
        for whole in batches:
            for batch in ta.slices(whole, 2, STEP):
                part, doc_ids = batch.column(0)[0].as_py(), batch.column(1).to_pylist()
                ids, at = pieces.ids_of_rows(encoder, *ta.text_buffers(batch.column(2)))
                ids = np.insert(ids, at[1:], end).astype(np.uint32)
                at = at + np.arange(len(at))
                for d, doc in enumerate(doc_ids):
                    a, b = int(at[d]), int(at[d + 1])
                    split = size + b - a > rans.BLOCK
                    while a < b:
                        n = min(b - a, rans.BLOCK - size)
                        held.append(ids[a : a + n])
                        inside.append((doc, row, n, split))
                        a, size = a + n, size + n
                        if size == rans.BLOCK:
                            yield _block(part, block, np.concatenate(held), inside, batch.column(1).type)
                            block, held, inside, size = block + 1, [], [], 0
                    row += 1
                # what waits for its block must not hold the slice
                held = [np.concatenate(held)] if held else []
        if size:
            yield _block(part, block, held[0], inside, batch.column(1).type)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fp", text_fingerprint(F.col("text")))
    keys = [F.col("id").asc_nulls_first(), F.col("fp")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "id", "text")
    return rows.mapInArrow(run, f"part int, block int, n int, ids binary, doc_ids array<{kind}>, doc_rows array<bigint>, doc_sizes array<int>, doc_split array<boolean>")


def _counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs: vectors of the vocabulary's length, added up in tasks, then by a shuffle of one row for each id and task."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    found = blocks.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    out = np.zeros(max((r["id"] for r in found), default=-1) + 1, np.int64)
    for r in found:
        out[r["id"]] = r["n"]
    return out


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, bits: int = BITS) -> None:
    """Encodes whole texts and writes their ids, `end` after each document, to a new folder, in ascending order of (id, 64-bit fingerprint of the text), null ids first.

    Null texts count as empty; an empty one has the end id alone. Repeated rows are documents of their own; other columns are not read; an empty table makes
    files without rows. Memory: 16 MB of text, its distinct words, and one block for each task.
    """
    spark = docs.sparkSession
    small_batches(spark, None)
    blocks = written(_blocks(docs, id_col, text_col, vocabulary, end), "token-blocks")
    freq = rans.frequencies(_counts(blocks), bits)
    spark.createDataFrame([(i, int(f), bits) for i, f in enumerate(freq) if f], "id int, freq bigint, bits int").coalesce(1).write.parquet(f"{path}/table")
    before, first = [], 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], first))
        first += r["n"]

    def run(batches):
        coder = rans.Coder(freq, bits)
        for batch in batches:
            coded = [coder.encode(np.frombuffer(ids.as_buffer(), "<u4")) for ids in batch.column("ids")]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "ids"}
            columns |= {"words": pa.array([w for w, _ in coded], pa.binary()), "checkpoints": pa.array([m for _, m in coded], pa.binary()), "crc32": pa.array([rans.checksum(*x) for x in coded], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    rows = blocks.join(F.broadcast(spark.createDataFrame(before, "part int, before bigint")), "part")  # a row for each partition
    rows = rows.withColumn("first", F.col("before") + F.col("block").cast("bigint") * rans.BLOCK).drop("before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    rows.mapInArrow(run, f"{schema}, words binary, checkpoints binary, crc32 bigint").write.parquet(f"{path}/blocks")
    dropped(blocks)


def _decoder(spark: SparkSession, path: str):
    """A function from an Arrow batch with words, checkpoints, n and crc32 to the ids of each block; a wrong checksum is an error."""
    table = spark.read.parquet(f"{path}/table").collect()  # a row for each id of the vocabulary at most
    freq, bits = np.zeros(max((r["id"] for r in table), default=0) + 1, np.int64), max((r["bits"] for r in table), default=BITS)
    for r in table:
        freq[r["id"]] = r["freq"]

    def decode(batch):
        coder = rans.Coder(freq, bits)
        for i in range(batch.num_rows):
            payload, marks = batch.column("words")[i].as_py(), batch.column("checkpoints")[i].as_py()
            if rans.checksum(payload, marks) != batch.column("crc32")[i].as_py():
                raise ValueError(f"block {batch.column('block')[i]} of part {batch.column('part')[i]}: wrong checksum")
            yield coder.decode(payload, marks, batch.column("n")[i].as_py())

    return decode


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, block, first, ids (array of int): the ids in blocks, in the order of (part, block)."""
    decode = _decoder(spark, path)

    def run(batches):
        for batch in batches:
            for i, ids in enumerate(decode(batch)):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("part"), one.column("block"), one.column("first"), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["part", "block", "first", "ids"])

    small_batches(spark, None)
    return spark.read.parquet(f"{path}/blocks").select("part", "block", "first", "n", "words", "checkpoints", "crc32").mapInArrow(run, "part int, block int, first bigint, ids array<int>")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of each document, from the files alone. CRCs of a document's parts in different blocks are put together without its ids."""
    stored = spark.read.parquet(f"{path}/blocks")
    decode = _decoder(spark, path)
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i, ids in enumerate(decode(batch)):
                sizes = np.asarray(batch.column("doc_sizes")[i].values, np.int64)
                ends = np.cumsum(sizes)
                raw, cut = memoryview(ids.astype("<u4").tobytes()), (4 * np.append(0, ends)).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                part, first, n = batch.column("part")[i].as_py(), batch.column("first")[i].as_py(), len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), batch.column("doc_rows")[i].values, batch.column("doc_ids")[i].values, pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64()), batch.column("doc_split")[i].values],
                    names=["part", "row", "id", "start", "n_tokens", "ids_crc32", "split"],
                )

    small_batches(spark, None)
    found = written(stored.mapInArrow(run, f"part int, row bigint, id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, split boolean"), "token-documents")
    join = F.udf(lambda parts: rans.crc32_joined([(p["ids_crc32"], 4 * p["n_tokens"]) for p in parts]), "bigint")
    parts = F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32")))  # a part for each 262,144 ids of one document
    whole = found.where("split").groupBy("part", "row").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), parts.alias("parts"))
    return found.where("NOT split").select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32").unionByName(whole.select(F.col("id").alias(id_col), "start", "n_tokens", join("parts").alias("ids_crc32")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    out = read_documents(spark, path)
    removed(spark, path)  # what was read is written on its own
    return out
