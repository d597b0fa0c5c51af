"""Op 5, language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language.  A text is cross-parsed against each: from where the last
phrase ended, the longest string that occurs in the language's text is the next phrase.  The language that needs the fewest phrases, each weighed
by log2 of the length of its text, wins.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import documents, small_batches
from quantloom.llm.sampling import held_out, labelled_sample
from quantloom.llm.textarrays import ranges

#: Bound of the training sample: rows of a language.
SAMPLE_ROWS = 24
#: Symbols that a lane parses ahead from a guessed beginning; characters held in arrays at once.
AHEAD, AT_ONCE = 1024, 2_000_000
UNKNOWN = "und"


def suffix_automaton(symbols: list[int]) -> tuple[int, np.ndarray]:
    """Number of states, and the transitions as rows (state, symbol, next state), of all substrings; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    arcs = np.fromiter((x for state, to in enumerate(nxt) for c, t in to.items() for x in (state, c, t)), np.int64)
    return len(nxt), arcs.reshape(-1, 3)


class ArcTable:
    """Transitions (state, symbol) -> state of all languages, rows of states laid over each other in one array.

    A state's transition for a symbol, if it has one, is at its offset plus the symbol, with the state's number. Memory grows with the transitions, not with
    states times letters.
    """

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, width: int):
        self.cells = np.full(2 * len(state) + 2 * width, -1, np.int64)  # state << 32 | next state
        self.offset = np.zeros(states, np.int64)
        order = np.argsort(state, kind="stable")
        state, symbol, cell = state[order], symbol[order], (state << 32 | to)[order]
        many = np.bincount(state, minlength=states)
        begin = np.cumsum(many) - many
        rng = np.random.default_rng(5)
        open_ = np.flatnonzero(many > 1)
        while len(open_):  # the widest rows first, at random offsets, until they meet no other
            wide = open_[2 * many[open_] > many[open_].max()]
            at = rng.integers(0, len(self.cells) - width, len(wide))
            arc = ranges(begin[wide], many[wide])
            owner = np.repeat(np.arange(len(wide)), many[wide])
            slot = at[owner] + symbol[arc]
            taken = self.cells[slot] >= 0
            by = np.argsort(slot, kind="stable")
            taken[by[1:]] |= slot[by[1:]] == slot[by[:-1]]
            fits = np.bincount(owner, taken, len(wide)) == 0
            put = fits[owner]
            self.cells[slot[put]] = cell[arc[put]]
            self.offset[wide[fits]] = at[fits]
            open_ = np.setdiff1d(open_, wide[fits])
        one = np.flatnonzero(many == 1)
        slot = np.flatnonzero(self.cells < 0)
        slot = slot[slot >= width][: len(one)]
        self.cells[slot] = cell[begin[one]]
        self.offset[one] = slot - symbol[begin[one]]

    def find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is no transition."""
        cell = self.cells[self.offset[state] + symbol]
        return np.where(cell >> 32 == state, cell & 0xFFFFFFFF, 0)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


class CrossParser:
    """Languages with their automata, in one table."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.languages = sorted({lang for lang, _ in sample})
        texts = {lang: " ".join(t for x, t in sample if x == lang) for lang in self.languages}
        letters = letter_table()
        points = {lang: letters[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for lang, t in texts.items()}
        alphabet = np.unique(np.concatenate([*points.values(), np.zeros(1, np.uint32)]))[1:]
        # symbols: 0 what isn't a letter, 1 a letter seen in no language, then the alphabet
        self.width = len(alphabet) + 2
        self.symbol = np.where(letters > 0, 1, 0)
        known = np.zeros(0x110000, np.int64)
        known[alphabet] = np.arange(2, self.width)
        self.symbol = np.where(known[letters] > 0, known[letters], self.symbol)
        # states are numbered on from language to language
        self.weight, self.first = [], np.zeros((len(self.languages), self.width), np.int64)
        rows, states = [np.zeros((0, 3), np.int64)], 0
        for k, lang in enumerate(self.languages):
            symbols = self._squeezed(self.symbol[np.frombuffer(texts[lang].encode("utf-32-le"), np.uint32)])
            n, arcs = suffix_automaton(symbols.tolist())
            inner = arcs[:, 0] > 0
            rows.append(arcs[inner] + [states, 0, states])
            self.first[k, arcs[~inner, 1]] = arcs[~inner, 2] + states
            states += n
            self.weight.append(math.log2(max(2, len(symbols))))
        self.first = self.first.ravel()
        self.arcs = ArcTable(*np.concatenate(rows).T, states, self.width)

    @staticmethod
    def _squeezed(symbols: np.ndarray) -> np.ndarray:
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        return symbols[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (languages x texts), and which texts have a letter."""
        n, n_lang = len(texts), len(self.languages)
        joined = "".join(texts)
        points = self.symbol[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(n), [len(t) for t in texts])
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
        points, owner = points[keep], owner[keep]
        has = np.bincount(owner[points > 0], minlength=n) > 0
        count = np.bincount(owner, minlength=n)
        first = np.cumsum(count) - count
        return self._parsed(points, np.tile(first, n_lang), np.tile(count, n_lang), np.repeat(np.arange(n_lang), n)).reshape(n_lang, n), has

    def _step(self, root: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States after a symbol, 0 where the phrase can't go on; from state 0 a phrase begins. root: where a language's row of first states begins."""
        new = self.arcs.find(state, symbol)
        fresh = np.flatnonzero(state == 0)
        new[fresh] = self.first[root[fresh] + symbol[fresh]]
        return new

    def _parsed(self, points: np.ndarray, first: np.ndarray, count: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Phrases of each text, points[first:first + count], in its language; a text comes once for each language.

        Lanes of AHEAD symbols are parsed in step, each as if a phrase began where it begins. Then every text is parsed from its beginning: where one of
        its phrases begins at a symbol at which a lane's phrase begins, the two go alike to the lane's end and beyond, until the phrase
        that is under way there ends; else it goes on symbol by symbol.
        """
        n, total = len(count), len(points) + 1
        lanes = -(-count // AHEAD)
        of = np.repeat(np.arange(n), lanes)
        start = first[of] + AHEAD * (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop, end, root, shift = np.minimum(start + AHEAD, (first + count)[of]), (first + count)[of], (lang * self.width)[of], (lang * total)[of]
        order = np.argsort(start - stop, kind="stable")  # the longest first
        begins = np.zeros((int(lang.max(initial=0)) + 1) * total, np.int32)
        at, size, base, row, state, live = start[order], (stop - start)[order], root[order], shift[order], np.zeros(len(of), np.int64), len(of)
        for t in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= t:
                live -= 1
            here = at[:live] + t
            s, old = points[here], state[:live]
            new = self._step(base[:live], old, s)
            begins[(row[:live] + here)[(new == 0) | (old == 0)]] = 1
            ended = np.flatnonzero((new == 0) & (old > 0))
            new[ended] = self.first[base[ended] + s[ended]]
            state[:live] = new
        # to the end of the phrase under way
        leave, carried = stop.copy(), np.zeros(len(of), np.int64)
        carried[order] = state
        going = np.flatnonzero((carried > 0) & (leave < end))
        while len(going):
            carried[going] = self._step(root[going], carried[going], points[leave[going]])
            going = going[carried[going] > 0]
            leave[going] += 1
            going = going[leave[going] < end[going]]
        before = np.cumsum(begins, dtype=np.int32) - begins  # phrases of lanes before a symbol
        made = np.zeros(n, np.int64)
        text = np.flatnonzero(count > 0)
        lane0, cur, state, root, shift = np.cumsum(lanes) - lanes, first.copy(), np.zeros(n, np.int64), lang * self.width, lang * total
        while len(text):
            known = (state[text] == 0) & (begins[shift[text] + cur[text]] > 0)
            jump = text[known]
            lane = lane0[jump] + (cur[jump] - first[jump]) // AHEAD
            made[jump] += before[shift[jump] + stop[lane]] - before[shift[jump] + cur[jump]]
            cur[jump] = leave[lane]
            walk = text[~known]
            old = state[walk]
            new = self._step(root[walk], old, points[cur[walk]])
            made[walk] += old == 0
            cur[walk] += (new > 0) | (old == 0)
            state[walk] = new
            text = text[cur[text] < first[text] + count[text]]
        return made

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        phrases, has = self.phrases(texts)
        cost = phrases * np.array(self.weight)[:, None]
        best = np.argmin(cost, axis=0)
        low = np.take_along_axis(cost, best[None], 0)[0]
        rest = cost.copy()
        np.put_along_axis(rest, best[None], np.inf, 0)
        second = rest.min(axis=0)
        score = np.where(np.isfinite(second), 1 - low / np.maximum(second, 1e-9), 1.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], np.where(has, np.clip(score, 0, 1), 0.0)


@lru_cache(2)
def parser(sample: tuple[tuple[str, str], ...]) -> CrossParser:
    """One for each Python worker and sample."""
    return CrossParser(sample)


def train(labelled: DataFrame, lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> tuple[tuple[str, str], ...]:
    """The training sample: at most `rows` whole texts for each language, of rows that are not held out."""
    return tuple((str(a), b) for a, b in labelled_sample(labelled.where(~held_out()).select("doc_id", "text", F.col(lang_col).alias("label")), rows))


def identify(docs: DataFrame, sample: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, lang_pred, score for each row of docs (with `carry` also `row`, the row as a struct).

    lang_pred is `und` with score 0 for null texts, texts without a letter, and if nothing could be learned. The score is 1 less the winner's cost over
    the runner-up's: 0 for a tie, which the first language in order wins. Rows are treated alone; letters are lower-cased, all else is one space.
    """

    def run(batches):
        tool = parser(sample)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores, at = [], [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= AT_ONCE):
                    chars += len(texts[end])
                    end += 1
                got = tool.predict(texts[at:end])
                langs += got[0]
                scores.append(got[1])
                at = end
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", *batch.schema.names[2:], "lang_pred", "score"])

    small_batches(docs.sparkSession)
    extra = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra).mapInArrow(run, f"id {kind}, {f'row {docs.schema.simpleString()}, ' if carry else ''}lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
