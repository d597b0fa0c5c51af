"""Ops 11 to 13 against the libraries and brute force, round trips, and odd inputs (nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns)."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SMALL
from tokenizers import Tokenizer

from quantloom.llm import op11_token_files as op11
from quantloom.llm import op12_alignment as op12
from quantloom.llm import op13_prefix_trie as op13
from quantloom.llm import pieces, rans
from quantloom.llm import textarrays as ta
from quantloom.llm.common import new_path

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b\n", "it's  we'll\t\tx", "é è à", "x  y", "x  y", "   z", "a　 b", "ends ", "ends  ", "日本語 テキスト", "▁ sign", "a▁b",
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "</s>[INST] ok", "\x00 \x01", "ﬁ İ ß", "🙂 🙂🙂", "12345 6 7,8.9", "www.a-b.c/d?e=f&g", "w" * 3000, "a b " * 3000, "\r\n\r\n x", "\x85 x", "x \x1c y", " \x0b\x0c a",
]
EXTRA = "doc_id bigint, text string, lang string, id int, part int, ids string, n int, link bigint"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, 1, 2, "x", 3, 4) for i, t in enumerate(ODD)] + [(3, "under a used id", None, 1, 2, "x", 3, 4), (5, "a", None, 1, 2, "x", 3, 4), (None, "null id", None, 1, 2, "x", 3, 4), (None, None, None, 1, 2, "x", 3, 4)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def random_texts(n=400):
    r = random.Random(5)
    parts = ["a", "bc", "é", "日", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", " ", " ", "\x85", "▁", "ß", "-", "<|endoftext|>", "The", "ing", "🙂", "\x1d"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(n)]


def encoded(encoder, texts, lead=""):
    data, offsets = ta.text_buffers(pa.array([lead + t for t in texts]))
    ids, at = pieces.ids_of_rows(encoder, data, offsets)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_are_the_librarys_ids(plain):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    texts = [t or "" for t in ODD] + random_texts()
    for _ in range(2):  # the second time from what is kept
        assert encoded(pieces.byte_level(path, plain), texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_sentence_pieces_are_the_librarys_ids():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in [t or "" for t in ODD] + random_texts() if t and "▁" not in t]
    assert encoded(pieces.sentence_pieces(path), texts, " ") == model.encode(texts)


# 11


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, rans.SEGMENT - 1, rans.SEGMENT, rans.SEGMENT + 1, 3 * rans.SEGMENT + 700, rans.BLOCK])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32) if n else np.zeros(0, np.uint32)
    coder = rans.Coder(rans.frequencies(np.bincount(np.append(ids, 7), minlength=50_001), 18), 18)
    payload, marks = coder.encode(ids)
    assert (coder.decode(payload, marks, n) == ids).all()
    if n == rans.BLOCK:
        p = np.bincount(ids)[np.bincount(ids) > 0] / n
        assert len(payload) * 8 / n < -(p * np.log2(p)).sum() * 1.03 + 0.02


def test_frequencies_add_up():
    rng = np.random.default_rng(1)
    for counts in ([5], [1, 0, 1], rng.zipf(1.2, 3000), np.append(np.ones(30_000, np.int64), 10**12)):
        f = rans.frequencies(np.asarray(counts, np.int64), 18)
        assert f.sum() == 1 << 18 and ((f > 0) == (np.asarray(counts) > 0)).all()
    assert rans.frequencies(np.zeros(4, np.int64), 18).sum() == 0
    with pytest.raises(ValueError, match="more than 4 bits"):
        rans.frequencies(np.ones(9, np.int64), 4)


def test_crc_of_joined_parts():
    r = random.Random(3)
    for _ in range(30):
        parts = [r.randbytes(r.choice([0, 1, 7, 1000])) for _ in range(r.randrange(1, 5))]
        assert rans.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def wanted_ids(rows):
    tok = Tokenizer.from_file(public_tokenizers.path(op11.VOCABULARY))
    return [(d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for d, t in rows]


def test_token_files_are_the_librarys_ids(spark, duck):
    want, start = [], 0
    for doc, ids in wanted_ids(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()):
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op11.query(spark, SMALL).collect()) == want


def test_token_files_odd_inputs_and_documents_over_many_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 500)  # the functions sent to the workers are made with the module as imported there: see below
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    path = new_path(spark, "test-token-files")
    op11.write_token_files(odd, path)
    got = op11.read_documents(spark, path).collect()
    assert len(got) == len(rows)
    want = Counter((d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in wanted_ids(rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    # starts leave no gap, in ascending order of ids
    by = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by] == [0, *np.cumsum([r["n_tokens"] for r in by])[:-1].tolist()]
    assert [r["doc_id"] for r in by] == sorted((r["doc_id"] for r in got), key=lambda d: (d is not None, d))
    # the stream itself
    stream = [i for r in op11.read_ids(spark, path).orderBy("first").collect() for i in r["ids"]]
    at = {(r["doc_id"], r["ids_crc32"]): r for r in by}
    for d, ids in wanted_ids(rows):
        r = at[d, zlib.crc32(ids.tobytes())]
        assert stream[r["start"] : r["start"] + r["n_tokens"]] == ids.tolist()


def test_a_document_of_many_blocks(spark):
    words = np.random.default_rng(2).integers(0, 900, 700_000)
    rows = [(1, "first"), (2, " ".join(f"w{x}" for x in words)), (3, None), (4, "last one")]
    path = new_path(spark, "test-token-files")
    op11.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), path)
    assert spark.read.parquet(f"{path}/blocks").count() > 4
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in op11.read_documents(spark, path).collect())
    assert got == [(d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in wanted_ids(rows)]


def test_token_files_notice_damage(spark):
    path = new_path(spark, "test-token-files")
    op11.write_token_files(spark.createDataFrame([(1, "some text")], "doc_id bigint, text string"), path)
    bad = spark.read.parquet(f"{path}/blocks").selectExpr("* EXCEPT (crc32)", "crc32 + 1 AS crc32").collect()
    other = new_path(spark, "test-token-files")
    spark.read.parquet(f"{path}/table").write.parquet(f"{other}/table")
    spark.createDataFrame(bad, spark.read.parquet(f"{path}/blocks").schema).write.parquet(f"{other}/blocks")
    with pytest.raises(Exception, match="wrong checksum"):
        op11.read_documents(spark, other).collect()


def test_token_files_of_nothing(spark, empty):
    path = new_path(spark, "test-token-files")
    op11.write_token_files(empty, path)
    assert op11.read_documents(spark, path).count() == 0 and op11.read_ids(spark, path).count() == 0


# 12


def brute_alignment(rows):
    tok = Tokenizer.from_file(public_tokenizers.path(op12.A))
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op12.B))
    symbols = pieces.byte_symbols()
    bytes_a = lambda i: bytes(symbols[c] for c in tok.id_to_token(i))
    bytes_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    counts, found = Counter(), []
    for d, t in rows:
        a, b = (tok.encode(f" {t}", add_special_tokens=False).ids, model.encode(t)) if t else ([], [])
        if any(b"".join(map(f, x)) != f" {t}".encode() for f, x in ((bytes_a, a), (bytes_b, b))):
            a = b = []
        ends_a, ends_b = (dict(zip(np.cumsum([len(f(i)) for i in x]).tolist(), range(len(x)))) for f, x in ((bytes_a, a), (bytes_b, b)))
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(map(str, a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, b[j : ends_b[e] + 1])))
            links.append((a[ends_a[e]], b[ends_b[e]]))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        counts.update(links)
        found.append((d, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for d, na, nb, groups, links in found:
        yield d, na, nb, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha256(";".join(groups).encode()).hexdigest() if na else ""


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_against_brute_force(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = op12.query(spark, SMALL)
    assert set(COLUMNS) <= set(got.columns)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == Counter(brute_alignment(rows))


def test_alignment_of_odd_inputs(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(tuple(r) for r in op12.align(odd).select(*COLUMNS).collect()) == Counter(brute_alignment(rows))
    assert op12.align(empty).count() == 0


def test_alignment_of_random_texts_and_the_pair_table(spark):
    rows = list(enumerate(random_texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert Counter(tuple(r) for r in op12.align(df).select(*COLUMNS).collect()) == Counter(brute_alignment(rows))
    table = op12.pair_counts(op12.aligned_documents(df)).collect()
    assert sum(r["n"] for r in table) == sum(x[4] for x in brute_alignment(rows))
    most = defaultdict(int)
    for r in table:
        most[r["b_id"]] = max(most[r["b_id"]], r["n"])
    assert all(r["best"] == (r["n"] == most[r["b_id"]]) for r in table)


# 13


def brute_trie(rows):
    """rows: (conv_id, turn, role, text), without ties of turns."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [q for q in out if len(q) == len(p) + 1 and q[:-1] == p]
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        out[p] = (sum(out[q][0] for q in below) or 1, saved + sum(out[q][1] for q in below), ends)
    return Counter((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), kids[p], *out[p][:2], sha256(out[p][2].encode()).hexdigest()) for p in members)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id bigint, turn bigint, role string, text string, path string, lens int, depth int, kind string"


def trie(df, cells):
    return Counter(tuple(r) for r in op13.prefix_trie(op13.shared_heads(op13.conversation_paths(df)), cells).select(*NODE).collect())


@pytest.mark.parametrize("cells", [1, 60, 100_000])
def test_trie_against_brute_force(spark, cells):
    r = random.Random(cells)
    rows = []
    for c in [*range(0, 130), 200, 205, 299, 777]:
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 9]) + (c == 205) * 60):
            rows.append((c, t, r.choice(["user", None]), r.choice(["x", "yy", "né", None])))
    df = spark.createDataFrame([(*x, "p", 1, 2, "k") for x in rows], TURNS).repartition(5)
    assert trie(df, cells) == brute_trie(rows)


def test_trie_of_copies_and_odd_turns(spark):
    rows = [(c, t, "u", "same") for c in range(1000, 1150) for t in range(3)]  # one conversation many have
    rows += [(7, None, "u", "first"), (7, 0, None, None), (7, -1, "u", ""), (None, 0, "u", "nobody's")]
    df = spark.createDataFrame([(*x, "p", 1, 2, "k") for x in rows], TURNS).repartition(7)
    for cells in (1, 100_000):
        assert trie(df, cells) == brute_trie(rows)


def test_trie_of_ties_repeats_and_nothing(spark):
    one = [(100, 0, "u", "b"), (100, 0, "u", "a"), (100, 0, "u", "a")]
    df = spark.createDataFrame([(*x, "p", 1, 2, "k") for x in one], TURNS)
    got = trie(df, 100)
    assert sum(got.values()) == 4 and got == trie(df.repartition(3), 100)  # turns of one number: by digest, so always in one order
    assert sum(trie(df.limit(0), 100).values()) == 0


def test_trie_over_two_levels_of_handed_on_paths(spark):
    """Chunks of 16 paths, so that handed-on paths fill several chunks again."""
    r = random.Random(8)
    rows = [(c, t, "u", r.choice("ab")) for c in range(1500) for t in range(r.randrange(0, 7))]
    df = spark.createDataFrame([(*x, "p", 1, 2, "k") for x in rows], TURNS).repartition(3)
    assert trie(df, 1) == brute_trie(rows)
