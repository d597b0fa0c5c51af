"""Op 8, best-fit packing with several permitted sequence lengths.

Documents are dealt to lanes by a hash of their id and each lane is packed alone, so that no task sees more than a lane.  In a lane
the longest pieces come first.  A piece goes to the open bin it leaves the least room in.  If none has room, a bin opens, and all permitted lengths
compete for it: for each the sizes still waiting say how far it could be filled, and the one whose sequence would cost least for each word
it holds is opened.  At the end each bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import textarrays as ta
from quantloom.llm.common import documents, partitions_for, small_batches, written

LENGTHS = (256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096)
#: What a sequence costs beside its length, in words.
OVERHEAD = 32
#: Words of a lane, about.
LANE_WORDS = 2_000_000


class _Waiting:
    """How many pieces of each size are still to come; the sizes there are, as bits of one integer."""

    def __init__(self, sizes: list[int]):
        self.count = Counter(sizes)
        self.bits = 0
        for s in self.count:
            self.bits |= 1 << s

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.bits ^= 1 << size

    def fill(self, room: int) -> int:
        """Words that waiting pieces can put into a room, the largest that fits first."""
        used, below = 0, room
        while True:
            fits = self.bits & ((2 << min(below, room - used)) - 1)
            if not fits:
                return used
            size = fits.bit_length() - 1
            used += size * min(self.count[size], (room - used) // size)
            below = size - 1


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, in the order given (longest first, none over the longest length), and each bin's final length.

    The cheaper, by the sum of overhead and final length over its bins, of two packings: all lengths compete for each new bin, or all bins open at the longest.
    """
    lengths = tuple(sorted(lengths))
    return min((_packed(sizes, lengths, opening, overhead) for opening in (lengths, lengths[-1:])), key=lambda x: sum(overhead + n for n in x[2]))


def _packed(sizes: list[int], lengths: tuple[int, ...], opening: tuple[int, ...], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit over all open bins: of the least sufficient room, the bin opened first.

    Bins with equal room wait in queues, and the rooms in use are the bits of one integer. A new bin gets the opening length with the least
    (overhead + length it ends with) / words it can hold, the shortest of equal ones.
    """
    waiting = _Waiting(sizes)
    rooms, queues = 0, {}
    used: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        waiting.take(size)
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            queue = queues[room]
            b = heappop(queue)
            if not queue:
                rooms ^= 1 << room
        else:
            b, room, least = len(used), 0, None
            for x in opening[bisect_left(opening, size) :]:
                full = size + waiting.fill(x - size)
                cost = (overhead + lengths[bisect_left(lengths, full)]) / full
                if least is None or cost < least:
                    room, least = x, cost
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        room -= size
        queue = queues.setdefault(room, [])
        if not queue:
            rooms |= 1 << room
        heappush(queue, b)
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def _pieces(longest: int, texts: bool):
    """mapInArrow: (id, text) to id, piece, start, n_words and with `texts` the piece's words: texts over the longest length are cut into pieces of it."""

    def work(batches):
        for batch in batches:
            data, offsets = ta.text_buffers(batch.column(1))
            words = np.bincount(ta.word_bounds(data, offsets)[2], minlength=batch.num_rows).astype(np.int64)
            n = np.maximum(1, -(-words // longest))
            row = np.repeat(np.arange(batch.num_rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * longest
            out = {"id": batch.column(0).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start_word": pa.array(start, pa.int64()), "n_words": pa.array(np.minimum(longest, words[row] - start), pa.int64())}
            if texts:
                split = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
                out["text"] = pa.array([b" ".join(split[r][a : a + longest]).decode() for r, a in zip(row.tolist(), start.tolist())], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return work


def _packed_lane(lengths: tuple[int, ...], overhead: int):
    def work(table: pa.Table) -> pa.Table:
        # nulls last, as Arrow sorts; repeated rows side by side
        table = table.sort_by([("n_words", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offsets, final = pack(table.column("n_words").to_pylist(), lengths, overhead)
        lane = table.column("lane").to_numpy()
        table = table.append_column("bin", pa.array((lane.astype(np.int64) << 32) + np.array(bins, np.int64)))
        table = table.append_column("offset", pa.array(offsets, pa.int64()))
        return table.append_column("length", pa.array(np.array(final, np.int64)[bins])).drop_columns("lane")

    return work


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, lane_words: int = LANE_WORDS, texts: bool = False) -> DataFrame:
    """id, piece, start_word, n_words, bin, offset, length: where each piece of each document lies.

    Sizes are words (`[^\\x20\\x09-\\x0D]+`). Every word is in just one piece, pieces of a bin don't overlap, and a bin's length is the smallest
    permitted one that holds it. Null, empty and wordless texts have one piece of no words and null bin, offset and length.
    Repeated ids and null ids are packed as rows of their own. Other columns are not read. With `texts` each piece's words come along in `text`, joined by
    one space, for sequences().
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cols = f"id {kind}, piece int, start_word bigint, n_words bigint{', text string' if texts else ''}"
    pieces = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_pieces(max(lengths), texts), cols), "pieces")
    lanes = partitions_for(pieces.agg(F.sum("n_words").alias("n")).first()["n"], lane_words)
    dealt = pieces.where("n_words > 0").withColumn("lane", F.pmod(F.xxhash64("id", "piece", "n_words"), F.lit(lanes)))
    out = dealt.groupBy("lane").applyInArrow(_packed_lane(tuple(lengths), overhead), f"{cols}, bin bigint, offset bigint, length bigint")
    none = F.lit(None).cast("bigint")
    empty = pieces.where("n_words = 0").withColumns({"bin": none, "offset": none, "length": none})
    return out.unionByName(empty).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """bin, length, n_words, text, parts: the packed sequences, one row for each bin of pack_documents(..., texts=True).

    text holds the pieces in the order of their offsets, one space between; parts says whose they are: array of (offset, id, piece, n_words).
    A bin holds at most the longest length of words. Pieces without words are in no sequence.
    """
    part = F.struct("offset", F.col(id_col).alias("id"), "piece", "n_words", "text")
    whole = packed.where("bin IS NOT NULL").groupBy("bin", "length").agg(F.array_sort(F.collect_list(part)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x.text), " ")
    return whole.select("bin", "length", F.aggregate("p", F.lit(0).cast("bigint"), lambda n, x: n + x.n_words).alias("n_words"), text.alias("text"), F.transform("p", lambda x: x.dropFields("text")).alias("parts"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
