"""Tokenizer libraries over whole Arrow columns, word by word.

Texts are cut at spaces that no token can cross, the distinct pieces of a slice are told apart by Arrow, and the library
encodes each of them once, many joined to a string at the same kind of cut.  Ids are those of the library on the whole text.

A cut lies before a space that is not a row's last byte and follows no white space, where the byte before is ASCII or the byte after is ASCII and no white space.
Byte-level BPE splits words there (white space joins a word only as one leading space); pieces of the SentencePiece file begin with
spaces or have none, so no merge crosses them either (the latter is checked when the file is read).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quantloom.llm import textarrays as ta

#: Pieces whose ids a Python worker keeps.
KEPT = 500_000
#: Bytes of pieces that are joined to a string, and strings that the library is given at once.
JOINED, STRINGS = 2_000, 160
#: SentencePiece's sign for a space.
SIGN = "▁".encode()

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII but white space.
_PLAIN = ~_SPACE
_PLAIN[128:] = False
_PLAIN[0] = False


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of all rows; pieces tile the bytes, none crosses rows."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    if n > 2:
        before, at, after = data[:-2], data[1:-1], data[2:]
        plain = before < 128
        first[1 : n - 1] = (at == 32) & ~_SPACE[before] & (before != SIGN[-1]) & (plain | ((after < 128) & ~_SPACE[after]))
        ends = offsets[1:] - 1
        first[ends[ends >= 0]] = False  # a row's last byte
    first[offsets] = True
    return np.flatnonzero(first[:n])


#: A piece may start at a byte if it and the byte before have a bit in common: white space after ASCII that is none; a mark, without the signs of contractions and of special tokens, after a letter or digit.
_OPENS, _FOLLOWS = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_OPENS[_SPACE] = 1
_OPENS[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2
_FOLLOWS[:128] = np.where(_SPACE[:128], 0, 1)
_FOLLOWS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3
#: One word of byte-level BPE whatever surrounds it: a space at most, then letters of ASCII or Latin-1.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_level_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same for byte-level BPE alone, whose words end before any white space that follows ASCII that is none, and before a mark that follows an ASCII letter or digit."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    if n > 1:
        before, at = data[:-1], data[1:]
        first[1:n] = _OPENS[at] & _FOLLOWS[before]
        k = np.flatnonzero((at == 32) & (before >= 128))
        first[k + 1] = (before[k] != SIGN[-1]) & _PLAIN[np.append(data, 0)[k + 2]]
    first[offsets] = True
    return np.flatnonzero(first[:n])


def distinct_pieces(data: np.ndarray, offsets: np.ndarray, cut=piece_starts) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Code of each piece, the distinct pieces by code, and how many pieces end by each row's end (from 0)."""
    starts = cut(data, offsets)
    ends = np.append(starts, len(data)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(starts, offsets, "left")


class Encoder:
    """Ids of pieces (int32 bytes) by one library; None where the joined tokens are not the piece's bytes."""

    def __init__(self, tokens: list[bytes], encode, cut=piece_starts, skip: int = 0, words=None):
        """tokens: bytes of each id; encode: strings to lists of ids; cut: where pieces start; skip: bytes at the head of a string that the library adds itself; words: pieces of letters alone to the ids of all."""
        self.tokens, self.encode, self.cut, self.skip, self.words = tokens, encode, cut, skip, words
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.known: dict[bytes, bytes | None] = {}

    def ids(self, pieces: list[bytes], counts: np.ndarray | None = None) -> list[bytes | None]:
        """Ids of distinct pieces. Those that occur more than once (by counts) are kept, while there is room: most others never come again."""
        known, missing = self.known, object()
        out = [known.get(p, missing) for p in pieces]
        at = [i for i, x in enumerate(out) if x is missing]
        found = dict(self._joined([pieces[i] for i in at]))
        for i in at:
            out[i] = found[pieces[i]]
        often = at if counts is None else np.array(at, np.int64)[counts[at] > 1].tolist()
        for i in often[: max(0, KEPT - len(known))]:
            known[pieces[i]] = out[i]
        return out

    def _joined(self, pieces: list[bytes]):
        if self.words:
            letters, rest = [], []
            for p in pieces:
                (letters if _LETTERS.fullmatch(p) else rest).append(p)
            for i in range(0, len(letters), 10_000):
                lot = letters[i : i + 10_000]
                out = self._split(lot, self.words(lot))
                if out is None:
                    rest += lot
                else:
                    yield from zip(lot, out)
            pieces = rest
        ascii_end, ascii_head, alone, space = [], [], [], _SPACE.tolist()
        for p in pieces:
            if len(p) < 2 or not space[p[0]] or space[p[-1]]:
                alone.append(p)
            elif p[-1] < 128:
                ascii_end.append(p)
            elif p[1] < 128 and not space[p[1]]:
                ascii_head.append(p)
            else:
                alone.append(p)
        lots = []
        for kind in (ascii_end, ascii_head):
            sizes = np.cumsum([len(p) for p in kind]) // JOINED
            cuts = np.append(np.flatnonzero(np.diff(sizes, prepend=-1)), len(kind))
            lots += [kind[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in range(0, len(lots), STRINGS):
            some = lots[i : i + STRINGS]
            for lot, ids in zip(some, self.encode([b"".join(x)[self.skip :].decode() for x in some])):
                out = self._split(lot, np.array(ids, np.int32))
                if out is None:
                    alone += lot
                else:
                    yield from zip(lot, out)
        for i in range(0, len(alone), 1000):
            some = alone[i : i + 1000]
            for p, ids in zip(some, self.encode([p[self.skip :].decode() for p in some])):
                yield p, np.array(ids, np.int32).tobytes() if b"".join([self.tokens[t] for t in ids]) == p else None

    def _split(self, lot: list[bytes], ids: np.ndarray) -> list[bytes] | None:
        if b"".join([self.tokens[t] for t in ids.tolist()]) != b"".join(lot):
            return None
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum([len(p) for p in lot])
        cut = np.searchsorted(ends, wanted)
        if (ends[cut] != wanted).any():
            return None
        raw, cut = ids.tobytes(), (4 * np.append(0, cut + 1)).tolist()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]


def byte_symbols() -> dict[str, int]:
    """The letters that byte-level BPE writes for bytes: printable Latin-1 for itself, the rest from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def byte_level(path: str, plain: bool) -> Encoder:
    """The tokenizers library on a byte-level file; plain: special tokens' strings inside texts are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = plain
    symbols, vocabulary = byte_symbols(), tok.get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    for word, i in vocabulary.items():
        tokens[i] = word.encode() if word in special else bytes(symbols[c] for c in word)
    other = [(chr(b), c) for c, b in symbols.items() if chr(b) != c and b != 10]
    model, cutter, added = tok.model, tok.pre_tokenizer, [t.content.encode() for t in tok.get_added_tokens_decoder().values()]

    def words(pieces: list[bytes]) -> np.ndarray:
        text = b"\n".join(pieces).decode("latin-1")
        for byte, letter in other:
            text = text.replace(byte, letter)
        return np.array([t.id for w in text.split("\n") for t in model.tokenize(w)], np.int32)

    # the library's model takes a word as it is; where the file has steps before it, or tokens that may lie inside words, whole strings go through all of them
    alike = tok.normalizer is None and isinstance(model, models.BPE) and isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space and not any(_LETTERS.fullmatch(t) for t in added)
    return Encoder(tokens, lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], byte_level_starts, words=words if alike else None)


@lru_cache(4)
def sentence_pieces(path: str) -> Encoder:
    """The sentencepiece library, which adds the first space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).encode()
        if SIGN in piece.lstrip(SIGN):
            raise ValueError(f"{path}: a piece has a space inside")
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else piece.replace(SIGN, b" "))
    return Encoder(tokens, lambda texts: model.encode(texts, num_threads=1), skip=1)


def ids_of_rows(encoder: Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one after another, and each row's first and past-the-last place among them."""
    codes, pieces, ends = distinct_pieces(data, offsets, encoder.cut)
    found = encoder.ids(pieces, np.bincount(codes, minlength=len(pieces)))
    if None in found:
        raise ValueError("tokens that are not their text's bytes")
    sizes = np.array([len(x) // 4 for x in found], np.int64)
    ids = np.frombuffer(b"".join(found), np.int32)
    places = np.cumsum(sizes) - sizes
    per_piece = sizes[codes]
    return ids[ta.ranges(places[codes], per_piece)], np.append(0, np.cumsum(per_piece))[ends]
