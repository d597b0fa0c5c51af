"""Op 3, substring dedup by super-k-mer partitioning.

A window is `window` consecutive words.  Its minimiser is the least hash among its runs of `run` words; equal windows have equal
minimisers.  Consecutive windows of a document with one minimiser travel as one packed string to the minimiser's bucket.
In a bucket the windows are sorted by a hash of their words' exact codes, equal ones are compared word by word, and all but the
first are reported.  Before that, each map batch drops windows it has itself seen earlier, so that a passage shared by
many documents is sent once for each batch, however often it occurs.  Windows of a minimiser that very many unlike windows share
are dealt by that minimiser and their next-least run.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import textarrays as ta
from quantloom.llm.common import documents, partitions_for, small_batches, text_bytes, text_fingerprint

WINDOW, RUN = 20, 3
#: Bytes of packed strings aimed at for a bucket, and how much longer they are than the text.
BUCKET_BYTES, GROWN = 6 << 20, 3.1
#: Bytes of packed strings from which a minimiser is split, one document in so many that are weighed for it, how many are split at most.
HOT_BYTES, SAMPLED, MOST_HOT = 4 << 20, 32, 1_000_000
#: Bytes of text that a map step holds in arrays at once; bytes of packed strings it gathers before it compresses them.
STEP, GATHER = 3_000_000, 24_000_000
_HEAD = np.dtype([("doc", "<i8"), ("fp", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("bytes", "<i4")])


def _later(order_hash: np.ndarray, codes: np.ndarray, at: np.ndarray, window: int, place: np.ndarray) -> np.ndarray:
    """Of windows at word positions `at`, in order of preference: which have the words of an earlier one at another place."""
    order = np.argsort(order_hash, kind="stable")
    h = order_hash[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    out = np.zeros(len(h), bool)
    if not same.any():
        return out
    # positions in sorted order of each run's first
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    cand = np.flatnonzero(same)
    equal = np.ones(len(cand), bool)
    a, b = at[order[cand]], at[order[lead[cand]]]
    for k in range(window):
        equal &= codes[a + k] == codes[b + k]
    out[order[cand]] = equal & (place[order[cand]] != place[order[lead[cand]]])
    if not equal.all():  # unlike windows of one hash: settle their runs by the words themselves
        for run in np.unique(lead[cand[~equal]]):
            seen: dict[bytes, int] = {}
            stop = run + 1
            while stop < len(h) and same[stop]:
                stop += 1
            for i in np.sort(order[run:stop]):
                key = codes[at[i] : at[i] + window].tobytes()
                out[i] = seen.setdefault(key, place[i]) != place[i]
    return out


def _runs(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of neighbours with mask set and one group."""
    idx = np.flatnonzero(mask)
    if not len(idx):
        return idx, idx
    new = np.ones(len(idx), bool)
    new[1:] = (idx[1:] != idx[:-1] + 1) | (group[idx[1:]] != group[idx[:-1]])
    first = np.flatnonzero(new)
    return idx[first], np.diff(np.append(first, len(idx)))


def _second(runs: np.ndarray, low: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of windows of n runs that begin at `at`: the least run hash beside the minimiser."""
    out = np.empty(len(at), np.uint64)
    for k in range(0, len(at), 100_000):
        some = at[k : k + 100_000]
        each = runs[some[:, None] + np.arange(n)]
        out[k : k + len(some)] = np.where(each == low[some, None], np.uint64(0xFFFFFFFFFFFFFFFF), each).min(1)
    return out


def _weighed(window: int, run: int):
    """mapInArrow: (text) to (low, bytes): what the windows of each minimiser would send, about."""

    def work(batches):
        for whole in batches:
            for batch in ta.slices(whole, 0, STEP):
                data, offsets = ta.text_buffers(batch.column(0))
                starts, ends, row = ta.word_bounds(data, offsets)
                n = len(starts) - window + 1
                if n < 1:
                    continue
                codes, words = ta.coded(*ta.packed(data, starts, ends))
                low = ta.sliding_min(ta.rolling(ta.word_hashes(words)[codes], run), window - run + 1)
                use = row[:n] == row[window - 1 :]
                first = use.copy()
                first[1:] &= (low[1:n] != low[: n - 1]) | ~use[:-1]
                size = (ends[:n] - starts[:n] + 1) + first * (window - 1) * 8
                found, at = np.unique(low[:n][use], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at, size[use]).astype(np.int64))], names=["low", "bytes"])

    return work


def hot_minimisers(docs: DataFrame, window: int, run: int, total: int) -> np.ndarray:
    """Minimisers whose windows would send HOT_BYTES or more, judged by one document in SAMPLED; at most MOST_HOT of them, the driver and each task hold them sorted.

    Which ones are split changes where windows meet, never what is found.
    """
    some = docs.where(F.pmod(F.xxhash64("doc", "fp"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_weighed(window, run), "low bigint, bytes bigint")
    least = max(HOT_BYTES, int(total * GROWN) // MOST_HOT) / SAMPLED
    found = some.groupBy("low").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") >= least).select("low")
    return np.sort(np.array([r["low"] for r in found.collect()], np.int64).view(np.uint64))


def _packed_rows(buckets: int, window: int, run: int, hot: np.ndarray):
    """mapInArrow: (doc, fp, text) to (bucket, blob)."""

    def work(batches):
        held: dict[int, list[bytes]] = {}
        size = 0
        for whole in batches:
            for batch in ta.slices(whole, 2, STEP):
                for b, raw in strings(batch):
                    held.setdefault(b, []).append(raw)
                    size += len(raw)
                if size >= GATHER:
                    yield pressed(held)
                    held, size = {}, 0
        if held:
            yield pressed(held)
            held = {}
        ta.give_back()

    def pressed(held: dict[int, list[bytes]]) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        blobs = [press.compress(b"".join(parts)) for parts in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def strings(batch):
        """Bucket, and bytes for it: number of heads, heads, packed strings."""
        doc, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        order = np.lexsort((fp, doc))  # windows come in order of preference
        doc, fp = doc[order], fp[order]
        data, offsets = ta.text_buffers(batch.column(2).take(pa.array(order)))
        starts, ends, row = ta.word_bounds(data, offsets)
        if len(starts) < window:
            return
        body, at = ta.packed(data, starts, ends)
        codes, words = ta.coded(body, at)
        h = ta.word_hashes(words)[codes]
        first_word = np.searchsorted(row, np.arange(len(doc)), "left")
        spaced = at + np.arange(len(at))  # offsets with one space after each word
        text = np.full(spaced[-1], 32, np.uint8)
        text[ta.ranges(spaced[:-1], np.diff(at))] = body
        text = text.tobytes()
        n = len(starts) - window + 1
        runs = ta.rolling(h, run)
        low = ta.sliding_min(runs, window - run + 1)
        whole = row[:n] == row[window - 1 :]
        if len(hot):
            split = np.flatnonzero(whole & (hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low))
            low[split] = ta.mix(low[split] + ta.mix(_second(runs, low, split, window - run + 1)))
        fresh = np.ones(len(doc), np.int64)  # repeated rows are one document
        fresh[1:] = (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])
        place = (np.cumsum(fresh)[row] << 32) + np.arange(len(row)) - first_word[row]
        later = np.zeros(n, bool)
        pick = np.flatnonzero(whole)
        later[pick] = _later(ta.rolling(h, window)[pick], codes, pick, window, place[pick])
        # runs with one minimiser in one document; those seen before go along as bare ranges
        bound = np.zeros(n, np.int64)
        bound[1:] = np.cumsum((low[1:n] != low[: n - 1]) | (row[1:n] != row[: n - 1]))
        send, size = _runs(whole & ~later, bound)
        known, known_size = _runs(whole & later, row[:n])
        first = np.concatenate([send, known])
        head = np.zeros(len(first), _HEAD)
        r = row[first]
        head["doc"], head["fp"], head["start"] = doc[r], fp[r], first - first_word[r]
        head["windows"] = np.concatenate([size, -known_size])
        a, b = spaced[send], spaced[send + size + window - 1]
        head["bytes"][: len(send)] = b - a
        bucket = np.concatenate([low[send] % np.uint64(buckets), ta.mix(doc[row[known]].astype(np.uint64)) % np.uint64(buckets)]).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(by))):
            k = by[lo:hi]
            s = k[k < len(send)]
            yield int(bucket[k[0]]), np.int64(len(k)).tobytes() + head[k].tobytes() + b"".join([text[x:y] for x, y in zip(a[s].tolist(), b[s].tolist())])

    return work


def _unpack(blobs) -> tuple[np.ndarray, np.ndarray]:
    heads, texts = [], []
    opened = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw, at = opened.decompress(blob.as_py()), 0
        while at < len(raw):
            n = int(np.frombuffer(raw, np.int64, 1, at)[0])
            head = np.frombuffer(raw, _HEAD, n, at + 8)
            at += 8 + n * _HEAD.itemsize
            size = int(head["bytes"].sum())
            heads.append(head)
            texts.append(np.frombuffer(raw, np.uint8, size, at))
            at += size
    return np.concatenate(heads), np.concatenate(texts)


def _bucket_ranges(window: int):
    """applyInArrow on a bucket: (doc, fp, start, windows) of the windows that also start earlier."""

    def work(table: pa.Table) -> pa.Table:
        out = found(table)
        ta.give_back()  # the bucket's arrays are gone
        return out

    def found(table: pa.Table) -> pa.Table:
        head, text = _unpack(table.column("blob"))
        known, head = head[head["windows"] < 0], head[head["windows"] > 0]
        out = [(known["doc"], known["fp"], known["start"], -known["windows"])]
        if len(head):
            begin = np.zeros(len(head), np.int64)
            np.cumsum(head["bytes"][:-1], out=begin[1:])
            order = np.lexsort((head["start"], head["fp"], head["doc"]))
            head, begin = head[order], begin[order]
            # words of all strings, in order of preference
            text = text[ta.ranges(begin, head["bytes"].astype(np.int64))]
            space = np.flatnonzero(text == 32)
            ends = space - np.arange(len(space))
            codes, words = ta.coded(text[text != 32], np.append(0, ends))
            n_words = head["windows"].astype(np.int64) + window - 1
            begin = np.cumsum(n_words) - n_words
            at = ta.ranges(begin, head["windows"].astype(np.int64))
            h = ta.rolling(ta.mix(codes.astype(np.uint64)), window)[at]
            piece = np.repeat(np.arange(len(head)), head["windows"])
            fresh = np.ones(len(head), np.int64)
            fresh[1:] = (head["doc"][1:] != head["doc"][:-1]) | (head["fp"][1:] != head["fp"][:-1])
            place = (np.cumsum(fresh)[piece] << 32) + (head["start"] - (np.cumsum(head["windows"]) - head["windows"]))[piece] + np.arange(len(piece))
            later = _later(h, codes, at, window, place)
            first, size = _runs(later, piece)
            p = piece[first]
            offset = first - (np.cumsum(head["windows"]) - head["windows"])[p]
            out.append((head["doc"][p], head["fp"][p], head["start"][p] + offset, size))
        doc, fp, start, windows = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc": pa.array(doc, pa.int64()), "fp": pa.array(fp, pa.int64()), "start": pa.array(start, pa.int32()), "windows": pa.array(windows, pa.int32())})

    return work


def repeated_ranges(docs: DataFrame, window: int = WINDOW, run: int = RUN, buckets: int | None = None, hot: np.ndarray | None = None) -> DataFrame:
    """doc, fp, start, windows: runs of windows (by first word, from 0) whose words also start earlier. docs: doc, fp, text."""
    total = text_bytes(docs)
    if buckets is None:
        buckets = partitions_for(int(total * GROWN), BUCKET_BYTES, 32)
    if hot is None:
        hot = hot_minimisers(docs, window, run, total)
    sent = docs.mapInArrow(_packed_rows(buckets, window, run, hot), "bucket int, blob binary")
    return sent.groupBy("bucket").applyInArrow(_bucket_ranges(window), "doc bigint, fp bigint, start int, windows int")


def _pressed_texts(batches):
    """mapInArrow: the column text, compressed row by row."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        blobs = pa.array([None if t is None else press.compress(t.encode()) for t in (x.as_py() for x in batch.column(at))], pa.binary())
        yield batch.set_column(at, "text", blobs)


def _kept(window: int, digest: bool, carry: bool):
    """mapInArrow: (..., text, spans) to (..., text, n_words, n_removed, kept), without text unless carried: removes the words that the spans cover."""

    def work(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            n, gone, kept, texts = [], [], [], []
            for packed, span in zip(batch.column("text"), batch.column("spans")):
                raw = None if not packed.is_valid else opened.decompress(packed.as_py())
                texts.append(raw)
                words = (raw or b"").split()
                n.append(len(words))
                if span.is_valid and len(span):
                    span = span.as_py()
                    cover = np.zeros(len(words) + 1, np.int32)
                    for s in span:
                        cover[s["start"]] += 1
                        cover[min(len(words), s["start"] + s["windows"] + window - 1)] -= 1
                    free = np.cumsum(cover[:-1]) == 0
                    words = [w for w, f in zip(words, free.tolist()) if f]
                gone.append(n[-1] - len(words))
                joined = b" ".join(words)
                kept.append(sha256(joined).hexdigest() if digest else joined.decode())
            rest = [k for k in range(batch.num_columns) if batch.schema.names[k] not in ("text", "spans")]
            more = {"text": pa.array([None if t is None else t.decode() for t in texts], pa.string())} if carry else {}
            more |= {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *more.values()], names=[*(batch.schema.names[k] for k in rest), *more])
        ta.give_back()

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, buckets: int | None = None, digest: bool = False, carry: bool = False, hot: np.ndarray | None = None) -> DataFrame:
    """For each row of docs: id, n_words, n_removed, kept (kept words joined by one space; with `digest` its SHA-256 in hex).

    A word goes if a window over it, of `window` words, also starts earlier: at a smaller id, or earlier in the same document. Windows are judged on the
    input. Null and empty texts have no words. Rows with one id and one text are one document, and each gets its result; rows with one id and
    different texts are ordered by a hash of the text; a null id comes before all others. Texts shorter than a window stay whole. With `carry`
    the row's other columns come along in the struct `row`, whatever they are called, and the text as `text`; else other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), text_fingerprint(F.col(text_col)).alias("fp"), F.col(text_col).alias("text")]
    lead = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row") if carry else F.col(id_col).alias("id")
    found = repeated_ranges(docs.select(*own), window, run, buckets, hot)
    spans = found.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))  # of one document
    rows = docs.select(lead, *own)
    kind = f"{rows.columns[0]} {rows.schema[0].dataType.simpleString()}"
    # texts cross the shuffle compressed
    rows = rows.mapInArrow(_pressed_texts, f"{kind}, doc bigint, fp bigint, text binary")
    joined = rows.join(spans.hint("shuffle_hash"), ["doc", "fp"], "left").select(rows.columns[0], "text", "spans")
    out = joined.mapInArrow(_kept(window, digest, carry), f"{kind}, {'text string, ' if carry else ''}n_words bigint, n_removed bigint, kept string")
    return out if carry else out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, greatest(len(words) - 18, 1))) AS start, words FROM w
), k AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(words[start:start + 19], ' ') ORDER BY doc_id, start) AS nth FROM s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM k WHERE nth > 1
), p AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS t, count(*) AS n FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos
  WHERE g.pos IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
