"""Op 7, toxicity from subword-bag embeddings.

The bag of a word holds itself and its character n-grams; the bag of a text is the average of its words' bags, which goes into a linear softmax over two
classes.  A plain average over hundreds of words would drown a few insults, so words are weighed, and the weights are learned with the rest: a
word's share of the average is the exponential of HEED times its own logit, over that of all words of the text.  Embeddings and softmax
are trained jointly, in numpy, on whole texts; a misspelling never seen in training lies near the words whose n-grams it shares.  A bag's
logit is linear, so the trained model folds into one number for each n-gram bucket.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import textarrays as ta
from quantloom.llm.common import documents, small_batches
from quantloom.llm.sampling import held_out, labelled_sample

#: Bound of the training sample: rows of each label.
SAMPLE_ROWS = 1000
BUCKETS, DIM, GRAMS = 1 << 18, 4, (4, 5, 6)
#: A word's bag is the mean over its buckets times GAIN; HEED times its logit is its weight in the average; how much more a missed toxic row costs.
GAIN, HEED, CARE = 4.0, 1.0, 2.0
#: Adam steps, step size, weight decay, and what is added to the root of the second moment: buckets that few texts share learn slowly.
STEPS, RATE, DECAY, EASE = 60, 0.03, 1e-5, 1e-4
THRESHOLD = 0.7
_ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the lower-cased words (letters and digits) of all texts, the distinct words, and each word's row."""
    data, offsets = ta.text_buffers(texts)
    data = np.where(_ALNUM[data], ta.lowered(data), 32).astype(np.uint8)
    starts, ends, row = ta.word_bounds(data, offsets)
    codes, words = ta.coded(*ta.packed(data, starts, ends))
    return codes, words, row


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of distinct words, with boundary marks, and the word of each."""
    n = len(words)
    lengths = np.fromiter((len(w) for w in words.to_pylist()), np.int64, n) if n else np.zeros(0, np.int64)
    body = np.frombuffer(b"".join(b"<" + w + b">" for w in words.to_pylist()), np.uint8)
    size = lengths + 2
    owner = np.repeat(np.arange(n), size)
    h = ta.mix(body.astype(np.uint64) + np.uint64(1))
    buckets, of = [ta.word_hashes(words) % np.uint64(BUCKETS)], [np.arange(n)]
    inner = (body & 0xC0) != 0x80  # n-grams begin at characters
    for k in GRAMS:
        grams = ta.rolling(h, k)
        ok = (owner[: len(grams)] == owner[k - 1 :]) & inner[: len(grams)] if len(grams) else np.zeros(0, bool)
        buckets.append(ta.mix(grams[ok] + np.uint64(k)) % np.uint64(BUCKETS))
        of.append(owner[: len(grams)][ok])
    bucket, of = np.concatenate(buckets).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return bucket[order], of[order]


class Sparse:
    """A sparse matrix that multiplies dense ones from either side, by sorted sums."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape, self.parts = shape, []
        value = value.astype(np.float32)
        for a, b in ((row, col), (col, row)):
            order = np.argsort(a, kind="stable")
            key = a[order]
            self.parts.append((b[order], value[order][:, None], np.flatnonzero(np.diff(key, prepend=-1)), np.unique(key)))

    def dot(self, x: np.ndarray, turned: bool = False) -> np.ndarray:
        other, value, at, rows = self.parts[turned]
        out = np.zeros((self.shape[turned], x.shape[1]), x.dtype)
        if len(at):
            out[rows] = np.add.reduceat(x[other] * value, at, axis=0)
        return out


def _share(weight: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each word's share of its text: the softmax of the words' weights over the text."""
    out = np.exp(weight - np.repeat(np.maximum.reduceat(weight, starts), length))
    return out / np.repeat(np.add.reduceat(out, starts), length)


class SubwordClassifier:
    """`toxic` says for each bucket what it adds to the logit of toxicity."""

    def __init__(self, toxic: np.ndarray, bias: float):
        self.toxic, self.bias = toxic, bias

    @staticmethod
    def gradients(params: list[np.ndarray], spell: Sparse, word: np.ndarray, starts: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss, and its derivatives by embeddings, softmax and bias. word: of each occurrence; starts: where texts begin; y: of each text."""
        embed, soft, bias = params
        length = np.diff(np.append(starts, len(word)))
        toward = soft[:, 1] - soft[:, 0]
        bags = spell.dot(embed)
        share = _share(HEED * (bags @ toward)[word], starts, length)
        text = np.add.reduceat(share[:, None] * bags[word], starts, axis=0)
        z = text @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        cost = balance[y] / len(y)
        loss = -float(np.sum(cost * np.log(np.maximum(p[np.arange(len(y)), y], 1e-30))))
        p[np.arange(len(y)), y] -= 1
        err = p * cost[:, None]
        back = err @ soft.T
        each = np.repeat(back, length, axis=0)
        # a word pulls at its share as far as its bag differs from the text's
        m = len(bags)
        pull = HEED * np.bincount(word, share * np.einsum("ij,ij->i", each, bags[word] - np.repeat(text, length, axis=0)), m)
        by_word = np.stack([np.bincount(word, share * each[:, k], m) for k in range(each.shape[1])], 1) + pull[:, None] * toward
        turn = pull @ bags
        return loss, [spell.dot(by_word.astype(embed.dtype), turned=True), text.T @ err + np.stack([-turn, turn], 1), err.sum(0)]

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], steps: int = STEPS) -> SubwordClassifier:
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:  # nothing to tell apart
            return cls(np.zeros(BUCKETS, np.float32), 4.0 if labels and labels[0] else -4.0)
        codes, words, row = words_of(pa.array(texts))
        m = len(words)
        pair = np.unique(row * np.int64(m) + codes)
        row, word = pair // m, pair % m
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        y = y[row[starts]]
        bucket, of = subwords(words)
        used, bucket = np.unique(bucket, return_inverse=True)
        spell = Sparse(of, bucket, GAIN / np.bincount(of, minlength=m)[of], (m, len(used)))
        rng = np.random.default_rng(7)
        params = [rng.normal(0, 0.01, (len(used), DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)]
        params = [p.astype(np.float32) for p in params]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        balance = 0.5 * len(y) * np.array([1.0, CARE]) / np.maximum(np.bincount(y, minlength=2), 1)
        for step in range(1, steps + 1):
            _, grads = cls.gradients(params, spell, word, starts, y, balance)
            for p, g, a, b in zip(params, grads, first, second):
                g = g + DECAY * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + EASE)
        embed, soft, bias = params
        out = np.zeros(BUCKETS, np.float32)
        out[used] = embed @ (soft[:, 1] - soft[:, 0])
        return cls(out, float(bias[1] - bias[0]))

    def scores(self, texts: pa.Array) -> np.ndarray:
        codes, words, row = words_of(texts)
        out = np.zeros(len(texts))
        if not len(codes):
            return out
        m = len(words)
        pair = np.unique(row * np.int64(m) + codes)
        row, word = pair // m, pair % m
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        bucket, of = subwords(words)
        n = np.bincount(of, minlength=m)
        toxic = GAIN * np.bincount(of, self.toxic[bucket], m) / n
        share = _share(HEED * toxic[word], starts, np.diff(np.append(starts, len(word))))
        z = np.add.reduceat(share * toxic[word], starts) + self.bias
        out[row[starts]] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return out


@lru_cache(2)
def _restored(toxic: bytes, bias: float) -> SubwordClassifier:
    return SubwordClassifier(np.frombuffer(toxic, np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> SubwordClassifier:
    """Fits on at most `rows` rows of each label, whole texts, none of them held out. docs: doc_id, text; labels: doc_id, label (0, 1)."""
    fold = labels.where(~held_out() & F.col("label").isin(0, 1)).select("doc_id", "label")
    sample = labelled_sample(docs.select("doc_id", "text"), rows, fold)
    return SubwordClassifier.fit([t for _, t in sample], [int(y) for y, _ in sample])


def score_documents(docs: DataFrame, model: SubwordClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: label 1 likelier) for each row of docs; null and empty texts and texts without letters or digits score 0. Other columns are not read."""
    model = model.toxic.astype(np.float32).tobytes(), model.bias

    def run(batches):
        tool = _restored(*model)
        for whole in batches:
            for batch in ta.slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tool.scores(batch.column(1)), pa.float64())], names=["id", "score"])

    small_batches(docs.sparkSession, None)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("label"))
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
