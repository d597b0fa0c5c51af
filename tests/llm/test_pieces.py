"""Byte-level pieces against the tokenizers library on whole texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import pieces
from quantloom.llm import textarrays as ta
from quantloom.llm.op06_bpe import vocabulary_path
from quantloom.llm.op11_token_files import VOCABULARY

PARTS = ["word", " Wörter", "ñandú", " é", "é éa", "×÷", "中文", " ", "　", "٣٤", " 12", "3x", "don't", "it'll", "'s", " '", "%%%", "a%b", "a_b", "x-y", "a.b", "(c)", "#", "@me", "<|endoftext|>", "<|end", "|>", "<", ">", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x00", "▁", " ▁", "é  a", "́", "🙂", "ÿÀß", "º"]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_the_librarys(plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    tok.encode_special_tokens = plain
    rng = random.Random(5)
    texts = ["", *PARTS, *("".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(4000))]
    encoder = pieces.byte_level(vocabulary_path(VOCABULARY), plain)
    ids, at = pieces.ids_of_rows(encoder, *ta.text_buffers(pa.array(texts)))
    for k, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids, texts[k]


def test_letters_and_marks_are_pieces_of_their_own():
    """A word before marks is the same piece as without them, and words of letters do not go through whole strings."""
    data, offsets = ta.text_buffers(pa.array(["some words%%% words### words"]))
    _, found, _ = pieces.distinct_pieces(data, offsets, pieces.byte_level_starts)
    assert sorted(found) == sorted([b"some", b" words", b"%%%", b"###"])
    encoder = pieces.Encoder(*(lambda e: (e.tokens, None, e.cut, e.skip, e.words))(pieces.byte_level(vocabulary_path(VOCABULARY), False)))
    assert all(encoder.ids([b"some", b" words", " Wörter".encode()], np.ones(3, np.int64)))
