"""The ten operators: SQL on the smallest tables, brute force, and odd inputs (nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns)."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from quantloom.llm import components, op01_topk, op02_chat, op03_substring, op04_near_dup, op05_language, op06_bpe, op07_toxicity, op08_packing, op09_exact_dedup, op10_sharding, registry, sampling, textarrays
from quantloom.llm.merge_automaton import WordTokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, row string, bucket int, family string, kept string, n_words int, task int, bin int, key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null, empty, blank, very long, repeated and tied texts, and columns named as the operators' own."""
    r = random.Random(4)
    words = ["".join(r.choice(["the", "an", "er", "on", "ié", "ß", "ton"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    base = " ".join(words[:60])
    texts = ["a b c", None, "", " \n\t", long, base, base, base + " tail", "x " + base, "A  B\nc", "z" * 5000, "1 2 3 !!", "ﬁn İstanbul 日本語"]
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    rows += [(6, base), (6, base), (7, "other text under a used id"), (None, base), (None, None)]
    return spark.createDataFrame([(i, t, None, "s", None, 1, "r", 2, "f", "k", 3, 4, 5, "y") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLES[name])


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# 1


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    codes = [int(x) for x in rng.integers(0, 1 << 16, 300)] + [7] * 120
    df = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    got = defaultdict(list)
    for r in op01_topk.hamming_top_k(df, df.where("id % 50 = 0"), k=5, bits=16, width=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    assert got == {q: sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:5] for q in range(0, 420, 50)}


@pytest.mark.parametrize("width, hot", [(None, 50_000), (5, 3), (16, 10), (7, 1)])
def test_topk_for_any_width_and_hot_values(spark, width, hot):
    rng = np.random.default_rng(3)
    codes = [int(x) for x in rng.integers(0, 1 << 8, 150)] + [int(x) << 8 for x in rng.integers(0, 1 << 8, 60)]
    df = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    got = defaultdict(list)
    for r in op01_topk.hamming_top_k(df, df.where("id % 50 = 0"), k=4, bits=16, width=width, hot_codes=hot).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    assert got == {q: sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:4] for q in range(0, 210, 50)}


@pytest.mark.parametrize("probe", [1, 16, 10**6])
def test_topk_of_64_bits_whether_probed_or_compared(spark, monkeypatch, probe):
    """Negative codes, too; from probes alone to a comparison with all codes at once."""
    monkeypatch.setattr(op01_topk, "PROBE", probe)
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    codes = [int(b ^ np.int64(1 << int(rng.integers(0, 60)))) for b in np.repeat(base, 10)]
    df = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint").repartition(3)
    got = defaultdict(list)
    for r in op01_topk.hamming_top_k(df, df.where("id % 50 = 0"), k=12).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    u = [c & (1 << 64) - 1 for c in codes]
    assert got == {q: sorted(((u[q] ^ c).bit_count(), i) for i, c in enumerate(u))[:12] for q in range(0, 400, 50)}


def test_topk_refuses_vectors_that_are_too_long(spark):
    with pytest.raises(Exception, match="more than 4 components"):
        op01_topk.sign_codes(spark.createDataFrame([(1, [1.0] * 5)], "vec_id bigint, embedding array<float>"), bits=4).collect()


def test_topk_few_and_odd_vectors(spark):
    rows = [(0, [1.0, -1.0]), (1, None), (2, [float("nan"), None, 3.0]), (None, [1.0]), (0, [1.0, -1.0]), (3, [])]
    codes = op01_topk.sign_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), bits=16)
    assert sorted((r["id"], r["code"]) for r in codes.collect()) == [(0, 1), (0, 1), (2, 4), (3, 0)]
    got = [(r["query_id"], r["rank"], r["id"], r["distance"]) for r in op01_topk.hamming_top_k(codes, codes.where("id = 3"), k=10, bits=16, width=8).orderBy("rank").collect()]
    assert got == [(3, 1, 3, 0), (3, 2, 0, 1), (3, 3, 0, 1), (3, 4, 2, 1)]
    none = codes.limit(0)
    assert op01_topk.hamming_top_k(none, none, bits=16, width=8).count() == 0


# 2


def test_reply_tree_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", "c", 1.0), (1, 5, 3, "user", "d", 1.0), (2, 9, 77, "user", None, None)]
    m = spark.createDataFrame(rows, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    got = sorted((r["conv_id"], r["path"], r["depth_from_root"], r["text"]) for r in op02_chat.branches(m, top=2).fillna("").collect())
    assert got == [(1, 1, 0, "q"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 2, 0, "q"), (1, 2, 1, "b"), (1, 2, 2, "d"), (2, 1, 0, "")]


def test_reply_tree_circles_and_repeated_nodes(spark):
    kind = "conv_id bigint, node bigint, parent bigint, role string, text string, score double"
    rows = [(1, 5, 7, "u", "five", 1.0), (1, 7, 9, "u", "seven", 1.0), (1, 9, 5, "u", "nine", 1.0), (1, 11, 7, "u", "leaf", 1.0), (1, 2, 2, "u", "self", 9.0)]
    rows += [(2, 1, None, "u", "b", 1.0), (2, 1, None, "u", "a", 1.0), (2, None, 1, "u", "no node", 1.0), (None, 3, 4, "u", "x", 0.0), (None, 4, 3, "u", "y", 0.0)]
    got = defaultdict(list)
    for r in op02_chat.branches(spark.createDataFrame(rows, kind), top=3).orderBy("path", "depth_from_root").collect():
        got[(r["conv_id"], r["path"])].append(r["text"])
    # 5 heads the circle 5 <- 9 <- 7, 2 is alone, and of the null conversation 3 is the root
    assert got == {(1, 1): ["self"], (1, 2): ["five", "nine", "seven", "leaf"], (2, 1): ["a"], (None, 1): ["x", "y"]}


def test_chat_reads_back_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] <s>", "", None, "</s>\n<s>[INST] user [/INST]\n", "plain", "$1 \\ $2"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, None, "x"), (3, 0, "assistant", "<"), (3, 1, "assistant", "/s>")]
    t = spark.createDataFrame(rows, "conv_id bigint, depth_from_root int, role string, text string").withColumn("path", F.lit(1))
    back = {r["conv_id"]: r for r in op02_chat.read_back(op02_chat.format_conversations(t)).collect()}
    assert [(x["role"], x["text"]) for x in back[1]["turns"]] == [(r[2], r[3] or "") for r in rows[: len(texts)]]
    assert back[1]["trained_text"] == "".join(t or "" for t in texts[1::2])
    assert [(x["role"], x["text"]) for x in back[2]["turns"]] == [("", "x")] and back[3]["trained_text"] == "</s>"
    assert op02_chat.digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, "x"), (None, 1, "user", "n", "x")], "conv_id bigint, turn bigint, role string, text string, path string")
    assert {r["conv_id"]: r["n_turns"] for r in op02_chat.digests(odd).collect() if r["conv_id"] is not None} == {1: 3}


def test_chat_null_conversation(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "né"), (None, 2, "user", None), (4, 0, "assistant", "x")]
    got = {r["conv_id"]: r for r in op02_chat.digests(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {None, 4}
    said, none = "user\nq\nassistant\nné\nuser\n\n", got[None]
    assert (none["n_turns"], none["loss_chars"], none["formatted_chars"]) == (3, 2, len("user" "q" "assistant" "né" "user") + 3 * 24)
    assert none["turns_sha256"] == sha256(said.encode()).hexdigest() and none["loss_sha256"] == sha256("né".encode()).hexdigest()
    tree = [(None, 1, None, "user", "q", 0.0), (None, 2, 1, "user", "a", 1.0), (None, 3, 1, "user", "b", 5.0), (1, 1, None, "user", "z", 0.0)]
    m = spark.createDataFrame(tree, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    assert sorted((r["conv_id"] or 0, r["depth_from_root"], r["text"]) for r in op02_chat.branches(m).collect()) == [(0, 0, "q"), (0, 1, "b"), (1, 0, "z")]


# 3


def brute_substring(rows, window):
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    seen, out = {}, {}
    for k in order:
        w = rows[k][1].encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if seen.setdefault(key, (rows[k][0], s)) != (rows[k][0], s):
                gone[s : s + window] = [True] * window
        out[rows[k][0]] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("buckets", [1, 7])
def test_substring_against_brute_force(spark, buckets):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 40)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in op03_substring.remove_repeats(df, window=6, run=2, buckets=buckets).collect()}
    assert got == brute_substring(rows, 6)


def test_substring_with_split_minimisers(spark):
    """Whichever minimisers are split, the same words go."""
    r = random.Random(10)
    rows = [(i, " ".join(r.choice(["the cat sat", "a", "b", "c d"]) for _ in range(r.randrange(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    source = df.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("fp"), "text")
    lows = sorted({r["low"] for r in source.select("text").mapInArrow(op03_substring._weighed(6, 2), "low bigint, bytes bigint").collect()})
    assert len(lows) > 5
    for some in (lows, lows[::2]):
        hot = np.sort(np.array(some, np.int64).view(np.uint64))
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in op03_substring.remove_repeats(df, window=6, run=2, buckets=5, hot=hot).collect()}
        assert got == brute_substring(rows, 6)
    sampled, least, op03_substring.SAMPLED, op03_substring.HOT_BYTES = op03_substring.SAMPLED, op03_substring.HOT_BYTES, 1, 3000
    try:
        assert 0 < len(op03_substring.hot_minimisers(source, 6, 2, 1)) < len(lows)
    finally:
        op03_substring.SAMPLED, op03_substring.HOT_BYTES = sampled, least


def test_substring_collisions_are_settled_by_words():
    codes = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2], np.int32)
    at = np.array([0, 3, 6])
    later = op03_substring._later(np.zeros(3, np.uint64), codes, at, 3, np.arange(3))
    assert later.tolist() == [False, False, True]


def test_substring_odd_inputs(odd, empty):
    got = op03_substring.remove_repeats(odd, carry=True).collect()
    assert len(got) == odd.count() and all(r["row"]["key"] == "y" for r in got)
    by = defaultdict(set)
    for r in got:
        by[(r["row"]["doc_id"], r["text"])].add((r["n_words"], r["n_removed"], r["kept"]))
    assert all(len(v) == 1 for v in by.values())  # repeated rows alike
    null_row = next(v for (i, t), v in by.items() if i is None and t)
    assert next(iter(null_row))[1] == 0  # a null id comes first
    assert next(iter(by[(6, got[0]["text"] if False else next(t for i, t in by if i == 6))]))[1] == 60
    assert next(iter(by[(2, None)])) == (0, 0, "")
    assert op03_substring.remove_repeats(empty).count() == 0


# 4


def brute_near(rows, k, threshold):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets[i] = s
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [600_000, 500])
def test_near_against_brute_force(spark, block):
    r = random.Random(3)
    origin = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(origin) if i % 3 else [f"v{r.randrange(400)}" for _ in range(80)]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"X{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in op04_near_dup.near_components(df, block=block).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_odd_inputs(odd, empty):
    got = op04_near_dup.near_components(odd, shingle=5, threshold=80).collect()
    assert len(got) == odd.count()
    assert {(r["n_shingles"], r["kept"]) for r in got if r["doc_id"] in (2, 3, 4)} == {(0, True)}
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7, 8, 9)} == {6}
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(None, True)}
    assert op04_near_dup.near_components(empty).count() == 0
    assert op04_near_dup.keep_one_of_each(odd).columns == odd.columns


def test_components_of_a_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(7, 60), 7)}


def test_tensored_keys_bound_the_misses():
    for t in (80, 85, 95):
        half = op04_near_dup.half_keys(t)
        assert 2 * (1 - (t / 100) ** 3) ** half <= 2e-6


# 5


def test_language_held_out_accuracy(spark, duck):
    got = [(r["lang_pred"], r["doc_id"]) for r in registry.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").where("held_out").collect()]
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sum(lang[i] == p for p, i in got) >= 0.98 * len(got)


def brute_phrases(text, train):
    n, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def test_cross_parse_against_brute_force():
    train = {"xx": "the cat sat on the mat and the hat", "yy": "der hund und die katze sitzen"}
    p = op05_language.CrossParser(tuple(train.items()))
    r = random.Random(12)
    texts = ["the hound sat", "katze und hut", "", "123", "ﬁsh the the zq", "and" * 400]
    texts += [train["xx"][4:] * 90, "".join(r.choice(["the cat ", "und", "on the", "q", " sitz", "hat"]) for _ in range(6000))]  # over 20,000 symbols
    got, has = p.phrases(texts)
    for k, lang in enumerate(p.languages):
        for t, n in zip(texts, got[k]):
            flat = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t))
            assert n == brute_phrases(flat, train[lang]), t[:50]
    assert has.tolist() == [True, True, False, False, True, True, True, True]
    langs, scores = p.predict(texts)
    for k, t in enumerate(texts):
        flat = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t))
        cost = sorted((brute_phrases(flat, train[x]) * math.log2(len(train[x])), x) for x in train)
        assert (langs[k], round(float(scores[k]), 9)) == ((cost[0][1], round(1 - cost[0][0] / cost[1][0], 9)) if has[k] else ("und", 0.0))


def test_cross_parse_of_a_wide_alphabet():
    r = random.Random(3)
    train = {k: "".join(chr(0x4E00 + r.randrange(2700)) for _ in range(4000)) for k in "ab"}
    p = op05_language.CrossParser(tuple(train.items()))
    assert p.arcs.cells.nbytes < 4_000_000  # as its transitions, not states times letters
    texts = [train["a"][500:900] + train["b"][:300], train["b"][7:80]]
    assert p.phrases(texts)[0].tolist() == [[brute_phrases(t, train[k]) for t in texts] for k in "ab"]


def test_sample_is_whole_and_the_same_twice(spark):
    long = "long " * 9000
    rows = [(1, "x", "en"), (1, "y", "de"), (2, "z", "en"), (2, "z", "en"), (2, "z", "fr"), (3, long, "en"), (4, None, "en"), (None, "n", "en"), (5, "u", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string").repartition(4)
    got = sampling.labelled_sample(docs, 9)
    assert got == [("de", "y"), ("en", long), ("en", "x"), ("en", "z"), ("fr", "z")]
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None)], "doc_id bigint, label int")
    assert sampling.labelled_sample(docs, 9, labels) == [(0, "x"), (0, "y"), (0, "z"), (1, "z")]
    many = spark.createDataFrame([(k, f"t{k}", "en") for k in range(300)], "doc_id bigint, text string, label string")
    one, two = (sampling.labelled_sample(many.repartition(n), 20) for n in (2, 5))
    assert one == two and len(one) == 20


def test_language_odd_inputs(odd, empty, spark):
    out = op05_language.identify(odd, (("en", "the an on"), ("fr", "ié ton")), carry=True).collect()
    assert len(out) == odd.count()
    assert {r["lang_pred"] for r in out if not any(c.isalpha() for c in r["row"]["text"] or "")} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert op05_language.train(odd) == () and op05_language.train(empty) == ()
    assert {r["lang_pred"] for r in op05_language.identify(odd, ()).collect()} == {"und"}
    assert op05_language.identify(empty, ()).count() == 0


# 6


def test_bpe_equals_the_library(odd, empty, spark):
    from tokenizers import Tokenizer

    path = op06_bpe.vocabulary_path(op06_bpe.VOCABULARY)
    lib = Tokenizer.from_file(path)
    r = random.Random(1)
    texts = [t for _, t in pairs(odd)] + ["".join(r.choice("ab lothexin's .,!?<|>éÉßΣσ12²日한😀\n\x00\x1c") for _ in range(r.randrange(50))) for _ in range(3000)]
    texts += ["<|endoftext|>a <|startoftext|>", "<|endoftext|", "aaaaaaaaaaaaaaaaaaa" * 20, "hahahahahaha", "-" * 77]
    texts += ["日本語漢字仮名" * 700, "<|ENDOFTEXT|>x<|endoftext|>", "\u00a0 \u2003", "e\u0301\u0323 \u0301"]
    tok = WordTokenizer(path)
    want = [(len(e.ids), " ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False)) for e in lib.encode_batch(texts, add_special_tokens=False)]
    n, ids, decoded = tok.encode_batch(pa.array(texts))
    assert list(zip(n.tolist(), ids.to_pylist(), decoded.to_pylist())) == want
    assert [tok.encode(t) for t in texts[-20:]] == want[-20:]
    out = op06_bpe.encode_documents(odd)
    assert out.count() == odd.count() and {(r["n_tokens"], r["ids"]) for r in out.where("doc_id IN (2, 3, 4)").collect()} == {(0, "")}
    assert op06_bpe.encode_documents(empty, digests=True).count() == 0


def test_bpe_automaton_equals_plain_merging():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "ab"), ("c</w>", "x"), ("a", "b</w>"), ("aa", "aa"), ("b", "b</w>")]
    vocab = {t: k for k, t in enumerate(dict.fromkeys([*"abcx", *(c + "</w>" for c in "abcx"), *(a + b for a, b in merges)]))}
    from quantloom.llm.merge_automaton import MergeAutomaton

    auto = MergeAutomaton(vocab, merges)

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (a, b):
                    parts[k : k + 2] = [a + b]
                k += 1
        return [vocab[p] for p in parts]

    import itertools

    for n in range(1, 8):
        for w in itertools.product("abc", repeat=n):
            assert auto.encode_word("".join(w)) == plain("".join(w)), w


# 7


def test_toxicity_learns_stems_and_keeps_its_folds(spark):
    r = random.Random(2)
    words = ["".join(r.choice(["the", "an", "er", "on", "ing", "st"]) for _ in range(r.randrange(1, 4))) for _ in range(400)]
    text = lambda bad: " ".join([r.choice(words) for _ in range(60)] + ([r.choice(["grubl", "skronk"]) + r.choice(["", "y", "ers", "ian", "ot"])] * 2 if bad else []))
    train = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(240)]
    model = op07_toxicity.SubwordClassifier.fit(*zip(*train))
    s = model.scores(pa.array([text(False) + " grublish", text(False), "", None, "skronkatory " + text(False)]))
    assert s[0] >= 0.7 and s[4] >= 0.7 and s[1] < 0.7 and s[2] == s[3] == 0


def test_toxicity_against_a_slow_loop():
    """The scores by plain loops over words and n-grams, with the buckets that single words get."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdéß9") for _ in range(r.randrange(1, 9))) for _ in range(50)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(40)] + ["", "-- !", "Ab,aB ab"]
    model = op07_toxicity.SubwordClassifier.fit(texts[:30], [k % 2 for k in range(30)], 5)
    got = model.scores(pa.array(texts))
    for t, score in zip(texts, got):
        logits = []
        for w in {x for x in re.split(r"[^\w]+", t.lower()) if x}:
            bag = op07_toxicity.subwords(pa.array([w.encode()], pa.large_binary()))[0]
            marked = f"<{w}>"
            assert len(bag) == 1 + sum(len(marked[i:].encode()) >= k for i in range(len(marked)) for k in op07_toxicity.GRAMS)
            logits.append(op07_toxicity.GAIN * sum(float(model.toxic[b]) for b in bag) / len(bag))
        if not logits:
            assert score == 0
            continue
        heed = [math.exp(op07_toxicity.HEED * x) for x in logits]
        z = sum(h * x for h, x in zip(heed, logits)) / sum(heed) + model.bias
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-5


def test_toxicity_gradients():
    rng = np.random.default_rng(4)
    m, buckets, dim = 6, 9, 3
    of = np.repeat(np.arange(m), 3)
    spell = op07_toxicity.Sparse(of, rng.integers(0, buckets, len(of)), np.full(len(of), 4 / 3), (m, buckets))
    word, starts, y, balance = np.array([0, 1, 2, 2, 3, 4, 5, 0]), np.array([0, 3, 5]), np.array([0, 1, 1]), np.array([1.5, 0.75])
    params = [rng.normal(0, 0.3, (buckets, dim)), rng.normal(0, 0.5, (dim, 2)), rng.normal(0, 0.1, 2)]
    f = op07_toxicity.SubwordClassifier.gradients
    _, grads = f(params, spell, word, starts, y, balance)
    for p, g in zip(params, grads):
        for at in np.ndindex(p.shape):
            old, step = p[at], 1e-5
            p[at] = old + step
            up = f(params, spell, word, starts, y, balance)[0]
            p[at] = old - step
            down = f(params, spell, word, starts, y, balance)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_toxicity_odd_inputs(odd, empty, spark):
    labels = spark.createDataFrame([(1, 0, "x"), (5, 1, "x"), (6, None, "x"), (None, 1, "x")], "doc_id bigint, label int, text string")
    model = op07_toxicity.train(odd, labels)
    out = op07_toxicity.score_documents(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert op07_toxicity.score_documents(empty, op07_toxicity.train(empty, labels)).count() == 0


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.88), ("sf0.1", 0.9)])
def test_toxicity_held_out(spark, duck, sf, least):
    """At sf0.01 two of the 18 held-out toxic rows have no toxic word: 16 is all there is to find."""
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("needs the larger tables")
    got = registry.QUERIES["op7_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    hit, false = (np.mean([r["predicted"] for r in got if r["toxic"] == y]) for y in (1, 0))
    assert hit >= least and false <= 0.03
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


# 8


def brute_pack(sizes, lengths, overhead):
    found = []
    for opening in (lengths, [max(lengths)]):
        bins, out = [], []
        for i, s in enumerate(sizes):
            fit = [(length - used, k) for k, (used, length) in enumerate(bins) if length - used >= s]
            if fit:
                k = min(fit)[1]
            else:
                k, costs = len(bins), []
                for x in sorted(opening):
                    if x >= s:
                        full = s
                        for t in sizes[i + 1 :]:  # longest first
                            full += t if full + t <= x else 0
                        costs.append(((overhead + min(y for y in lengths if y >= full)) / full, x))
                bins.append([0, min(costs)[1]])
            out.append((k, bins[k][0]))
            bins[k][0] += s
        final = [min(x for x in lengths if x >= u) for u, _ in bins]
        found.append((sum(overhead + x for x in final), len(found), out, final))
    return min(found)[2:]


def test_packing_against_brute_force():
    r = random.Random(8)
    for _ in range(60):
        lengths = r.choice([(8, 16, 32), (5, 12, 20, 32), (32,)])
        sizes = sorted((r.randrange(1, 33) for _ in range(r.randrange(1, 60))), reverse=True)
        bins, offsets, final = op08_packing.pack(sizes, lengths, 3)
        assert (list(zip(bins, offsets)), final) == brute_pack(sizes, lengths, 3)


def test_packing_lengths_jointly_beats_each_length_alone():
    r = random.Random(3)
    lengths = op08_packing.LENGTHS
    mixes = [  # sizes, and the least gain over one length with the bins downsized at the end
        ([r.randrange(1400, 2100) for _ in range(500)], 0.03),
        ([1360] * 200 + [r.randrange(1000, 1500) for _ in range(200)], 0.0),
        ([r.randrange(1, 4097) for _ in range(500)], 0.0),
        ([min(4096, int(r.lognormvariate(5.8, 1.1)) + 1) for _ in range(500)], 0.0),
    ]
    for sizes, gain in mixes:
        sizes = sorted(sizes, reverse=True)
        cost = lambda final: sum(op08_packing.OVERHEAD + x for x in final)
        joint, (bins, _, alone) = op08_packing.pack(sizes)[2], op08_packing.pack(sizes, (4096,))
        used = Counter()
        for b, s in zip(bins, sizes):
            used[b] += s
        assert cost(joint) <= (1 - gain) * cost([min(x for x in lengths if x >= u) for u in used.values()])
        assert cost(joint) < cost(alone)


def test_packed_sequences_read_back(odd):
    packed = op08_packing.pack_documents(odd, lengths=(64, 96, 1024), lane_words=9000, texts=True)
    found, total = Counter(), 0
    for r in op08_packing.sequences(packed).collect():
        words = r["text"].encode().split()
        assert len(words) == r["n_words"] <= r["length"]
        for p in r["parts"]:
            found[(p["id"], p["piece"], b" ".join(words[p["offset"] : p["offset"] + p["n_words"]]).decode())] += 1
    want = Counter()
    for i, t in pairs(odd):
        w = t.encode().split()
        want.update((i, k // 1024, b" ".join(w[k : k + 1024]).decode()) for k in range(0, len(w), 1024))
    assert found == want


def test_packing_holds_every_word_once(odd, empty):
    out = op08_packing.pack_documents(odd, lengths=(64, 256, 1024), lane_words=9000).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(i for i, _ in pairs(odd))
    assert sum(r["n_words"] for r in out) == sum(len(t.encode().split()) for _, t in pairs(odd))
    bins = defaultdict(list)
    for r in out:
        if r["n_words"]:
            bins[r["bin"]].append((r["offset"], r["n_words"], r["length"]))
        else:
            assert r["bin"] is None and r["length"] is None
    for parts in bins.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert {x[2] for x in parts} == {min(x for x in (64, 256, 1024) if x >= at)}
    assert op08_packing.pack_documents(empty).count() == 0


# 9


@pytest.mark.parametrize("block, bits", [(8192, 64), (8, 64), (8, 3), (1, 2)])
def test_exact_groups_against_brute_force(odd, empty, block, bits, spark):
    rows = pairs(odd)
    if block < 100:  # many levels and many collisions
        rows = [(i, t[:200]) for i, t in rows]
        odd = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(t.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))].append((-len(t), i is None, i or 0, i))
    want = Counter()
    for s, g in groups.items():
        best = min(g, key=lambda x: x[:3])
        for n, _, _, i in g:
            want[(i, best[3], len(g), i == best[3] and n == best[0], sha256(s.encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in op09_exact_dedup.exact_groups(odd, block=block, bits=bits).collect())
    assert got == want
    assert op09_exact_dedup.exact_groups(empty).count() == 0


# 10


def brute_capacity(sizes, shards):
    def feasible(c):
        n, load = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, load = (n + 1, s) if load + s > c else (n, load + s)
        return n <= shards

    c = max(max(sizes), -(-sum(sizes) // shards))
    while not feasible(c):
        c += 1
    return c


@pytest.mark.parametrize("limit, hot", [(40_000, False), (40, False), (40, True)])
def test_cuts_are_minimax(spark, limit, hot):
    r = random.Random(6)
    sizes = [r.randrange(1, 90) for _ in range(1500)]
    if hot:
        sizes[700] = 60_000
    ends = np.cumsum(sizes).tolist()
    cuts = op10_sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "upto bigint"), ends[-1], max(sizes), 7, limit)
    assert set(cuts) <= set(ends) and cuts[-1] == ends[-1] and len(cuts) == 7
    loads = [b - a for a, b in zip([0, *cuts], cuts)]
    assert max(loads) == brute_capacity(sizes, 7)
    rest = sorted(loads)[: 6 if hot else 7]  # the hot group is a shard's whole load
    assert min(rest) >= (0.9 if limit > 40 else 0.5) * max(rest)


def test_cuts_leave_no_shard_empty():
    r = random.Random(1)
    for _ in range(300):
        sizes = [r.choice([1, 5, 40, 700]) for _ in range(r.randrange(1, 40))]
        ends, shards = np.cumsum(sizes).tolist(), r.randrange(1, 9)
        c = brute_capacity(sizes, shards)
        cuts = op10_sharding._even(ends, c, shards)
        assert len(cuts) == min(shards, len(sizes)) and cuts[-1] == ends[-1] and cuts == sorted(set(cuts))
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == c


def test_shards_keep_groups_whole(odd, empty, spark, duck):
    for df, n in ((odd, 3), (spark.read.parquet(f"{SMALL}/documents.parquet"), 16)):
        rows = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in pairs(df))
        out = op10_sharding.shard_documents(df, n).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == rows
        of = defaultdict(set)
        slots = defaultdict(list)
        for r in out:
            of[(r["size"], r["text_crc32"])].add(r["shard"])
            slots[r["shard"]].append(r["slot"])
        assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(slots) < n
    assert op10_sharding.shard_documents(empty).count() == 0


def test_shards_of_a_hot_text_are_even(spark):
    rows = [(i, "h" * 4999 if i == 500 else f"t{i:08d}") for i in range(1000)] + [(2000 + i, "copies of it") for i in range(300)]
    out = op10_sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 16).collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert sorted(load) == list(range(16)) and len({r["shard"] for r in out if r["doc_id"] >= 2000}) == 1
    small = sorted(load.values())[:14]  # beside the two hot groups
    assert max(load.values()) == 5000 and small[0] >= 0.9 * small[-1]


# arrays


def test_rolling_and_sliding():
    h = np.arange(1, 60, dtype=np.uint64)
    for k in (1, 2, 3, 5, 16, 20):
        assert len(set(textarrays.rolling(h, k).tolist())) == 60 - k
        again = textarrays.rolling(np.concatenate([h[7 : 7 + k], h[7 : 7 + k]]), k)
        assert again[0] == again[k] == textarrays.rolling(h, k)[7]
        assert textarrays.sliding_min(h, k).tolist() == [h[i : i + k].min() for i in range(60 - k)]
    assert textarrays.ranges(np.array([5, 0, 9, 2]), np.array([2, 0, 1, 3])).tolist() == [5, 6, 9, 2, 3, 4]


def test_words_do_not_cross_rows():
    data, offsets = textarrays.text_buffers(pa.array(["ab", "cd e", None, "", "f"]))
    s, e, row = textarrays.word_bounds(data, offsets)
    assert [(bytes(data[a:b]), r) for a, b, r in zip(s, e, row)] == [(b"ab", 0), (b"cd", 1), (b"e", 1), (b"f", 4)]
    body, at = textarrays.packed(data, s, e)
    codes, words = textarrays.coded(body, at)
    assert [words[int(c)].as_py() for c in codes] == [b"ab", b"cd", b"e", b"f"]
