"""The corpus pipeline against a brute-force version, and its stages on odd documents."""

from __future__ import annotations

from conftest import SMALL
from test_ops import SCHEMA, brute_near, brute_pack, brute_substring, empty, odd  # noqa: F401

import corpus_pipeline as pipeline
from quantloom.llm import op08_packing

SPACES = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    """Packed pieces of (doc_id, text) rows with distinct ids: {(doc_id, piece): (bin, offset, length, n_words)}."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    best = {}
    for i, t in rows:
        key = t.translate(SPACES)
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    rows = [(i, t) for i, t in rows if best[t.translate(SPACES)][1] == i]
    near = brute_near(rows, pipeline.SHINGLE, pipeline.THRESHOLD)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    cut = brute_substring(rows, 20)
    rows = [(i, cut[i][2] if cut[i][1] else t) for i, t in rows if not cut[i][1] or cut[i][1] < cut[i][0]]
    longest, pieces = max(op08_packing.LENGTHS), []
    for i, t in rows:
        n = len(t.encode().split())
        pieces += [(-min(longest, n - k), i, k // longest) for k in range(0, n, longest)]
    pieces.sort()
    places, final = brute_pack([-n for n, _, _ in pieces], op08_packing.LENGTHS, op08_packing.OVERHEAD)
    return {(i, p): (b, o, final[b], -n) for (n, i, p), (b, o) in zip(pieces, places)}


def test_pipeline_against_brute_force(spark, duck):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {(r["doc_id"], r["piece"]): (r["bin"], r["offset"], r["length"], r["n_words"]) for r in pipeline.run(spark, SMALL).collect()}
    assert got == brute(rows)


def test_stages_on_odd_documents(spark, odd, tmp_path):  # noqa: F811
    docs = odd.withColumn("lang", odd["source"])  # labelled, so that a language is learned
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, SMALL)
        assert out.columns == odd.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 0
    texts = [r["text"] for r in docs.collect()]
    assert None not in texts and "a b c" in texts and len(texts) == len(set(texts))
    assert pipeline.STAGES[-1][1](spark, docs, SMALL).where("piece = 0").count() == docs.count()


def test_stages_on_no_documents(spark, empty):  # noqa: F811
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_near_stage_tells_rows_of_one_id_apart(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(80)) for x in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c + " more"), (None, d), (None, d + " more"), (None, b + " more"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_stage(spark, docs, SMALL).collect()]
    assert {(1, a), (2, b), (4, None), (4, "")} <= set(got) and len(got) == 6
    assert sum(i == 3 for i, _ in got) == 1 and [t[:2] for i, t in got if i is None] == ["d0"]


def test_language_stage_without_labels(spark):
    texts = ["plain words", "слова", "12 + 3", "", None, "𐐷 1"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = sorted((r["doc_id"], r["text"], r["lang"]) for r in pipeline.language_stage(spark, docs, SMALL).collect())
    assert got == [(i, texts[i], "und") for i in (0, 1, 5)]


def test_exact_stage_tells_rows_of_one_id_and_length_apart(spark):
    rows = [(7, "a b\tc"), (7, "a\tb c"), (7, "x y z"), (8, "abc"), (9, "xyz"), (9, "xyz"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in pipeline.exact_stage(spark, docs, SMALL).collect()]
    assert len(got) == 3 and {(7, "x y z"), (None, "q")} <= set(got) and got.count((None, "q")) == 1
    assert sum(t.split() == ["a", "b", "c"] for _, t in got) == 1
