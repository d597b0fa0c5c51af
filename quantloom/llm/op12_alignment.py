"""Op 12, alignment of two tokenizers' ids, with an identity map as the fast path.

Texts are cut into groups where a token of A and one of B end at the same byte; the last two tokens of a group are linked.  A link of an A id with the B
id of the same bytes, alone in its group, is regular: such links are counted in a vector with a place for each A id.  Only the others enter a shuffle, as pairs of ids with
their number in a slice.

Two linked tokens end together, so one's bytes are a suffix of the other's: there are at most as many pairs of ids as all entries of both vocabularies have bytes.  This
bounds what is counted and broadcast, whatever the corpus is.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import pieces
from quantloom.llm import textarrays as ta
from quantloom.llm.common import documents, small_batches, written
from quantloom.llm.op06_bpe import vocabulary_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose distinct words are encoded together.
STEP = 8_000_000
#: Pieces whose groups a Python worker keeps.
KEPT = 200_000

_DOCS = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, links_n binary"


def _same_bytes(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id of the same bytes, the least of several, or -1."""
    of: dict[bytes, int] = {}
    for i, x in enumerate(b):
        of.setdefault(x, i)
    return np.array([of.get(x, -1) if x else -1 for x in a], np.int64)


class Aligner:
    """Groups and links of pieces; links are numbers: an A id alone for a regular one, else (A id + 1) * B ids + B id beyond them."""

    def __init__(self, a: pieces.Encoder, b: pieces.Encoder):
        self.a, self.b = a, b
        self.same = _same_bytes(a.tokens, b.tokens)
        self.n_a, self.n_b = len(a.tokens), len(b.tokens)
        self.known: dict[bytes, tuple | None] = {}

    def pair(self, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A and B ids of links."""
        regular = link < self.n_a
        a = np.where(regular, link, (link - self.n_a) // self.n_b)
        return a, np.where(regular, self.same[a], (link - self.n_a) % self.n_b)

    def aligned(self, words: list[bytes]) -> list[tuple | None]:
        """Of each piece: number of A and of B tokens, its groups as text, and its links (int64 bytes); None if tokens are not its bytes."""
        known = self.known
        new = [w for w in words if w not in known]
        found = dict(zip(new, self._aligned(new)))
        if len(known) + len(found) <= KEPT:
            known.update(found)
            return [known[w] for w in words]
        return [known[w] if w in known else found[w] for w in words]

    def _aligned(self, words: list[bytes]) -> list[tuple | None]:
        ids_a, ids_b = self.a.ids(words), self.b.ids(words)
        good = [i for i, (x, y) in enumerate(zip(ids_a, ids_b)) if x is not None and y is not None]
        out: list[tuple | None] = [None] * len(words)
        if not good:
            return out
        n_a, n_b = (np.array([len(x[i]) // 4 for i in good], np.int64) for x in (ids_a, ids_b))
        a, b = (np.frombuffer(b"".join([x[i] for i in good]), np.int32).astype(np.int64) for x in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        # no token is empty, so ends are distinct on either side
        common, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        alone = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        la, lb = a[last_a], b[last_b]
        links = np.where(alone & (self.same[la] == lb), la, self.n_a + la * self.n_b + lb)
        text, text_ends = _group_texts(a, b, last_a, last_b)
        # a piece's last group ends with its last token
        upto = np.searchsorted(last_a, np.cumsum(n_a) - 1) + 1
        raw, cut = links.tobytes(), np.append(0, 8 * upto).tolist()
        places = np.append(0, text_ends[upto - 1]).tolist()
        for i, na, nb, x, y, s, t in zip(good, n_a.tolist(), n_b.tolist(), cut[:-1], cut[1:], places[:-1], places[1:]):
            out[i] = (na, nb, text[s:t], raw[x:y])
        return out


def _group_texts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All groups as `a1,a2|b1;`, and where each ends."""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    start = np.cumsum(n_a + n_b) - n_a - n_b
    ids = np.empty(len(a) + len(b), np.int64)
    ids[ta.ranges(start, n_a)], ids[ta.ranges(start + n_a, n_b)] = a, b
    after = np.full(len(ids), ord(","), np.uint8)
    after[start + n_a - 1], after[start + n_a + n_b - 1] = ord("|"), ord(";")
    digits = np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - 1] = after
    for d in range(int(digits.max())):
        use = digits > d
        out[ends[use] - 2 - d] = 48 + ids[use] // 10**d % 10
    return out.tobytes(), ends[start + n_a + n_b - 1]


@lru_cache(2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(pieces.byte_level(a, True), pieces.sentence_pieces(b))


def _documents(batch: pa.RecordBatch, tool: Aligner) -> tuple[list, ...]:
    """n_a, n_b, n_groups, groups_sha256, distinct links and how often each occurs (int64 and int32 bytes), of each text."""
    text = batch.column(1).fill_null("")
    data, offsets = ta.text_buffers(pc.binary_join_element_wise(pa.scalar(" ", text.type), text, ""))
    codes, words, ends = pieces.distinct_pieces(data, offsets)
    found = tool.aligned(words)
    of_doc = np.split(codes, ends[1:-1]) if len(ends) > 1 else []
    empty = np.diff(offsets) < 2
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for d, own in enumerate(of_doc):
        parts = [found[c] for c in own.tolist()]
        if empty[d] or None in parts:
            row = (0, 0, 0, "", b"", b"")
        else:
            na, nb, texts, links = zip(*parts)
            raw = b"".join(links)
            link, n = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
            h = sha256()
            h.update(b"".join(texts)[:-1])
            row = (sum(na), sum(nb), len(raw) // 8, h.hexdigest(), link.tobytes(), n.astype(np.int32).tobytes())
        for column, value in zip(out, row):
            column.append(value)
    return out


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """id, n_a, n_b, n_groups, groups_sha256, and the links in binary form (see Aligner), of each row: one pass, no shuffle.

    Null or empty texts, and texts whose tokens are not a space and the text, byte for byte (any text with U+2581), have no tokens: zeros, '' and no links. Rows are treated alone: repeated
    and null ids stay. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tool = aligner(vocabulary_path(a), vocabulary_path(b))
        for whole in batches:
            for batch in ta.slices(whole, 1, STEP):
                na, nb, ng, sha, links, n = _documents(batch, tool)
                columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (na, nb, ng)], pa.array(sha, pa.string()), pa.array(links, pa.binary()), pa.array(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "links_n"])

    small_batches(docs.sparkSession, None)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {_DOCS}")


def link_counts(aligned: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """link, n: how often each link occurs in all texts. Regular ones are added up in a vector by task, the others in a table of the pairs a task meets (bounded by the vocabularies' bytes)."""

    def run(batches):
        tool = aligner(vocabulary_path(a), vocabulary_path(b))
        regular, pairs, waiting, held = np.zeros(tool.n_a, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            link, n = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind) for i, kind in ((0, np.int64), (1, np.int32)))
            one = link < tool.n_a
            regular += np.bincount(link[one], n[one], tool.n_a).astype(np.int64)
            waiting.append((link[~one], n[~one].astype(np.int64)))
            held += len(waiting[-1][0])
            if held > 1_000_000:
                pairs, waiting, held = _summed([pairs, *waiting]), [], 0
        link, n = _summed([pairs, *waiting])
        used = np.flatnonzero(regular)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, link)), pa.array(np.append(regular[used], n))], names=["link", "n"])

    return aligned.select("links", "links_n").mapInArrow(run, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    link, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return link, np.bincount(where, np.concatenate([n for _, n in parts]), len(link)).astype(np.int64)


def pair_counts(aligned: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """a_id, b_id, n, best: the corpus-wide table of linked ids; best marks the most frequent of a B id (ties included)."""
    tool = aligner(vocabulary_path(a), vocabulary_path(b))
    link, n, best = _tables(tool, link_counts(aligned, a, b))
    ids = tool.pair(link)
    rows = pa.table({"a_id": ids[0], "b_id": ids[1], "n": n, "best": best})
    return aligned.sparkSession.createDataFrame(rows)  # bounded by the vocabularies' bytes


def _tables(tool: Aligner, counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links in ascending order, the count of each one's pair of ids, and whether it is the highest of its B id. At most as many rows as the vocabularies have bytes."""
    rows = counts.toArrow()
    link, n = (rows.column(c).to_numpy() for c in ("link", "n"))
    order = np.argsort(link)
    link, n = link[order], n[order]
    a, b = tool.pair(link)
    # a pair of the same bytes may be linked inside longer groups, too: both kinds count for the pair
    _, where = np.unique(a * tool.n_b + b, return_inverse=True)
    n = np.bincount(where, n, len(link)).astype(np.int64)[where] if len(link) else n
    most = np.zeros(tool.n_b, np.int64)
    np.maximum.at(most, b, n)
    return link, n, n == most[b]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row (see aligned_documents)."""
    aligned = written(aligned_documents(docs, id_col, text_col, a, b), "aligned")
    tool = aligner(vocabulary_path(a), vocabulary_path(b))
    link, n, best = _tables(tool, link_counts(aligned, a, b))
    counts = aligned.sparkSession.sparkContext.broadcast((link, n, best))

    def run(batches):
        link, n, best = counts.value
        for batch in batches:
            sizes = np.array([x // 8 for x in pc.binary_length(batch.column("links")).to_pylist()], np.int64)
            own, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("links", np.int64), ("links_n", np.int32)))
            at = np.searchsorted(link, own)
            place = np.append(0, np.cumsum(sizes))
            total = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x))[place]).astype(np.int64))
            columns = [batch.column(c) for c in ("id", "n_a", "n_b", "n_groups")]
            columns += [total(times), total(times * best[at]), total(times * n[at]), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = aligned.schema["id"].dataType.simpleString()
    out = aligned.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
