"""BPE by a tokenization automaton.

``MergeAutomaton`` compiles a merge list into a deterministic automaton over tokens, one merge
gadget after another.  A state is named by the token last read.  The gadget of merge ``u v -> w``
at rank i

* adds the state ``w``, a copy of state ``v`` as it stood before rank i (what may follow ``v`` may follow ``w``),
* adds an arc ``p -w->`` beside every arc ``p -u->`` whose target still has an arc ``v``, and
* takes the arc ``v`` away from state ``u`` (``u`` then ``v`` would have been merged).

A table of states times tokens would hold over a thousand million arcs, so it is kept factored, as the gadgets made it: three arrays as long as the
vocabulary (state copied, left part, rank) and a hashed table of the arcs taken away.  ``arcs`` reads any number of arcs from these at once.

A token sequence is accepted exactly if it is the BPE encoding of its own string, and every prefix of a word has just one encoding.  So a word is
read from left to right once: a byte trie of the labels lists the arcs that can end at each position, and the one that leaves an
accepted state gives the state of that position.  Nothing is taken back; all distinct words of a batch move in step.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from quantloom.llm import textarrays as ta

_END = "</w>"
#: Words of a piece; a newline stands between pieces.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\n")
#: What stands behind a word, beside 256 bytes.
_STOP, _BYTES = 256, 256
_FOREVER = 1 << 30


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], extra = chr(256 + extra), extra + 1
    return [table[b] for b in range(256)]


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = _END):
        size = max(vocab.values()) + 1
        self.size = size
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.born = np.full(size, -1, np.int32)
        # compiled with plain lists and a dictionary: gadgets come one at a time
        self._parts = self.left.tolist(), self.right.tolist(), self.born.tolist()
        self._cut: dict[tuple[int, int], int] = {}
        self._dead: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self.left, self.right, self.born = (np.array(x, np.int32) for x in self._parts)
        keys = np.array([u * size + v for u, v in self._cut], np.int64)
        order = np.argsort(keys)
        self.cut_keys, self.cut_ranks = np.append(keys[order], np.int64(1) << 62), np.append(np.array(list(self._cut.values()), np.int64)[order], _FOREVER)
        self.cut_marks = np.zeros(1 << 22, bool)
        self.cut_marks[self._slot(keys)] = True
        self._trie(vocab, end)

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        left, right, born = self._parts
        if u in self._dead or v in self._dead or not self._arc(u, v, rank):
            if born[w] < 0:
                self._dead.add(w)  # no accepted sequence ever reaches it
            return
        self._dead.discard(w)
        left[w], right[w], born[w] = u, v, rank
        self._cut.setdefault((u, v), rank)
        if u == v:
            self._cut.setdefault((u, w), rank)  # runs pair off from the left: never u before uu

    def _arc(self, state: int, token: int, rank: int = _FOREVER) -> bool:
        """Whether state has an arc for token once the gadgets below rank are in."""
        left, right, born = self._parts
        while True:
            made = born[token]
            if made >= rank or self._cut.get((state, token), rank) < rank:
                return False
            own = born[state]
            if own > made:  # the state was copied after the arc was added: look at what it was copied from
                state, rank = right[state], own
            elif made >= 0:  # the arc was added beside that of the token's left part
                if left[token] == right[token] == state:
                    return False
                token, rank = left[token], made
            else:  # a character's arc, and a state that never was a copy
                return True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * ta.SEQ) >> np.uint64(42)).astype(np.int64)

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token beside it: ``_arc`` for whole arrays."""
        out = np.zeros(len(state), bool)
        at, rank = np.arange(len(state)), np.full(len(state), _FOREVER, np.int32)
        while len(at):
            made, own = self.born[token], self.born[state]
            keys = state.astype(np.int64) * self.size + token
            gone = made >= rank
            maybe = np.flatnonzero(self.cut_marks[self._slot(keys)])
            if len(maybe):
                found = np.searchsorted(self.cut_keys, keys[maybe])
                gone[maybe] |= (self.cut_keys[found] == keys[maybe]) & (self.cut_ranks[found] < rank[maybe])
            copied = own > made
            plain = ~copied & (made < 0)
            part = self.left[token]
            gone |= ~copied & ~plain & (part == state) & (self.right[token] == state)
            out[at[plain & ~gone]] = True
            go = ~plain & ~gone
            at, copied = at[go], copied[go]
            rank = np.where(copied, own[go], made[go])
            token = np.where(copied, token[go], part[go])
            state = np.where(copied, self.right[state[go]], state[go])
        return out

    def _trie(self, vocab: dict[str, int], end: str) -> None:
        """Labels of the live tokens as byte strings: rows of `goto` for nodes with children, which come first; 0 is the root, and no way.

        `token` is the token a node spells, `last` the one it spells with the end of the word; -1 if there is none.
        """
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        nodes: list[dict[int, int]] = [{}]
        spelt: tuple[dict[int, int], dict[int, int]] = {}, {}
        for label, token in vocab.items():
            closes = bool(end) and label.endswith(end) and len(label) > len(end)
            stem = label[: len(label) - len(end)] if closes else label
            if token in self._dead or self.born[token] < 0 and len(stem) > 1:
                continue
            node = 0
            for s in (byte_of[c] for c in stem):
                if s not in nodes[node]:
                    nodes[node][s] = len(nodes)
                    nodes.append({})
                node = nodes[node][s]
            spelt[closes][node] = token
        inner = [k for k, arcs in enumerate(nodes) if arcs or k == 0]
        name = {k: i for i, k in enumerate([*inner, *(k for k, arcs in enumerate(nodes) if not arcs and k)])}
        self.rows = len(inner)
        goto = np.zeros((len(inner), _BYTES), np.int32)
        for k in inner:
            for s, to in nodes[k].items():
                goto[name[k], s] = name[to]
        self.goto = goto.ravel()
        self.token, self.last = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -1, np.int32)
        for table, tokens in zip((self.token, self.last), spelt):
            for k, token in tokens.items():
                table[name[k]] = token

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and all tokens in order. Words are bytes data[offsets[i]:offsets[i + 1]], none empty."""
        size = np.diff(offsets).astype(np.int64)
        if not len(size):
            return size, np.zeros(0, np.int32)
        order = np.argsort(-size, kind="stable")  # words still being read are the first ones
        size = size[order]
        # each word, its stop, and one position more
        first = np.cumsum(size + 2) - size - 2
        symbols = np.full(int(size.sum()) + 2 * len(size), _STOP, np.int16)
        inside = ta.ranges(first, size)
        symbols[inside] = data[ta.ranges(offsets[:-1][order].astype(np.int64), size)]
        ends, tokens = self._candidates(symbols, inside)
        # the candidates of a position side by side, the longest first
        count = np.zeros(len(symbols) + 1, np.int32)
        for e in ends:
            count[e] += 1
        slot = np.cumsum(count, dtype=np.int64) - count
        total = int(count.sum())
        cand, span, fill = np.zeros(total, np.int32), np.zeros(total, np.int32), slot.copy()
        for k in range(len(ends) - 1, -1, -1):
            at = fill[ends[k]]
            cand[at], span[at] = tokens[k], k + 1 + (symbols[ends[k] - 1] == _STOP)
            fill[ends[k]] += 1
        state = np.full(len(symbols) + 1, -1, np.int32)
        length, made = np.zeros(len(symbols) + 1, np.int32), np.zeros(len(symbols) + 1, np.int32)
        live = len(size)
        for step in range(1, int(size[0]) + 2):
            while live and size[live - 1] + 1 < step:
                live -= 1
            if live <= 4:  # few words are left: the same tables, one position after another
                for w in range(live):
                    self._read_on(int(first[w]), step, int(size[w]) + 1, slot, count, cand, span, state, length, made)
                break
            e = first[:live] + step
            e = e[count[e] > 0]
            at, last = slot[e], slot[e] + count[e] - 1
            while len(e):
                before = state[e - span[at]]
                # of all arcs into a position one is accepted: the last one left needs no look
                ask = np.flatnonzero((before >= 0) & (at < last))
                ok = np.ones(len(e), bool)
                ok[ask] = self.arcs(before[ask], cand[at[ask]])
                hit, chosen = e[ok], at[ok]
                state[hit], length[hit] = cand[chosen], span[chosen]
                made[hit] = made[hit - span[chosen]] + 1
                e, at, last = e[~ok], at[~ok] + 1, last[~ok]
        # back from the ends of the words
        e = first + size + 1
        n = np.zeros(len(size), np.int64)
        n[order] = made[e]
        out = np.zeros(int(n.sum()), np.int32)
        begin = (np.cumsum(n) - n)[order]
        while len(e):
            out[begin + made[e] - 1] = state[e]
            e = e - length[e]
            more = made[e] > 0
            e, begin = e[more], begin[more]
        return n, out

    def _candidates(self, symbols: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each number of bytes from 1: where tokens of that many end, and which; just before a word's end, only those that close it."""
        ends, tokens = [], []
        node, k = self.goto[symbols[at]], 1
        while len(at):
            closing = symbols[at + k] == _STOP
            token = np.where(closing, self.last[node], self.token[node])
            use = token >= 0
            ends.append((at + k + closing)[use])
            tokens.append(token[use])
            go = (node > 0) & (node < self.rows) & ~closing
            at, node = at[go], node[go]
            node = self.goto[node.astype(np.int64) * _BYTES + symbols[at + k]]
            k += 1
        return ends, tokens

    def _read_on(self, first: int, step: int, size: int, slot, count, cand, span, state, length, made) -> None:
        for e in range(first + step, first + size + 1):
            n, at = int(count[e]), int(slot[e])
            for c in range(at, at + n):
                back = e - int(span[c])
                before = int(state[back])
                if before < 0 or c == at + n - 1 or self._arc(before, int(cand[c])):
                    state[e], length[e], made[e] = cand[c], span[c], made[back] + 1
                    break

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word given in the byte alphabet."""
        table = byte_alphabet()
        data = np.array([table.index(c) for c in word], np.uint8)
        return self.encode_words(data, np.array([0, len(data)]))[1].tolist() if word else []


class WordTokenizer:
    """Normaliser, special strings, splitter and automaton of a word-ending byte-level BPE file.

    Works on the distinct pieces between ASCII white space of a batch, on which all of these steps act alone.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        label = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        names = range(max(label) + 1)
        self.decimal, self.label = pa.array([str(i) for i in names], pa.large_string()), pa.array([label.get(i, "") for i in names], pa.large_string())

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # lower-cased one character at a time: no rule looks at the neighbours
        return "".join(map(str.lower, unicodedata.normalize("NFC", text)))

    def _words(self, pieces: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The words of all pieces, and how many each has. A special string is a word as it is, after a newline."""
        joined = b"\n".join(pieces).decode()
        if not any(m in joined for m in self.special):
            found = np.array(_SPLIT.findall(self._normal(joined)), object)
            cuts = np.flatnonzero(found == "\n")
            ends = np.append(cuts - np.arange(len(cuts)), len(found) - len(cuts))
            return found[found != "\n"].tolist(), np.diff(ends, prepend=0)
        words, count = [], []
        for piece in joined.split("\n"):
            before = len(words)
            for part in self.cut.split(piece):
                words += ["\n" + part] if part in self.special else _SPLIT.findall(self._normal(part))
            count.append(len(words) - before)
        return words, np.array(count, np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text: number of ids, decimal ids joined by one space, decoded text (the arc labels joined by one space)."""
        data, offsets = ta.text_buffers(texts)
        starts, ends, row = ta.word_bounds(data, offsets)
        if not len(starts):
            return np.zeros(len(texts), np.int64), *[pa.array([""] * len(texts), pa.large_string())] * 2
        codes, pieces = ta.coded(*ta.packed(data, starts, ends))
        words, per_piece = self._words(pieces.to_pylist())
        coded = pa.array(words, pa.string()).dictionary_encode()
        n, ids = self._ids(coded.dictionary)
        # tokens to words, words to pieces, pieces to texts
        word, some = coded.indices.to_numpy(), per_piece[codes] > 0  # a piece of other white space has no words
        per_row = np.bincount(row[some], minlength=len(texts))
        strings = []
        for names in (self.decimal, self.label):
            each = _joined(names, ids, n)
            each = _joined(each, word, per_piece)
            strings.append(_joined(each, codes[some], per_row))
        of_piece = np.bincount(np.repeat(np.arange(len(per_piece)), per_piece), n[word], len(per_piece)) if len(word) else np.zeros(len(per_piece))
        return np.bincount(row, of_piece[codes], len(texts)).astype(np.int64), *strings

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of distinct words, and the ids."""
        data, offsets = ta.text_buffers(words)
        n, ids = self.automaton.encode_words(data, offsets)
        special = np.flatnonzero(pc.starts_with(words, "\n"))
        if len(special):
            keep = np.ones(len(ids), bool)
            first = np.cumsum(n) - n
            ids[first[special]] = [self.special[words[k].as_py()[1:]] for k in special.tolist()]
            keep[ta.ranges(first[special] + 1, n[special] - 1)] = False
            ids, n[special] = ids[keep], 1
        return n, ids

    def encode(self, text: str) -> tuple[int, str, str]:
        n, ids, decoded = self.encode_batch(pa.array([text], pa.string()))
        return int(n[0]), ids[0].as_py(), decoded[0].as_py()


def _joined(strings: pa.Array, index: np.ndarray, per_group: np.ndarray) -> pa.Array:
    """Groups of strings[index] joined by one space: the first per_group[0] of them, the next per_group[1], ..."""
    offsets = np.zeros(len(per_group) + 1, np.int64)
    np.cumsum(per_group, out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(index)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
