"""Boosted trees for a 0/1 label, from histograms of gradients.

Features become bin numbers once (bin 0: missing), by quantile edges.  A level of a tree takes one pass: tasks add up gradients and curvatures by (node, feature, bin) in arrays of a fixed
size, a shuffle adds the tasks' arrays, and the driver, which never holds more than those sums, picks the splits.  Sums are of integers (2^-24ths), so they, and the trees, are
the same however the rows are dealt.  Rows' margins are written anew every few trees, so a pass applies few.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.sources.shared import dropped, written

#: Fixed point of the sums, trees between two writings of the margins, relative error of the quantiles (1 / ACCURACY).
POINT, FRESH, ACCURACY = 1 << 24, 10, 10_000
_TRAIN, _VALID = 0, 1


@dataclass(frozen=True)
class Rules:
    rounds: int = 500
    depth: int = 4
    rate: float = 0.05
    bins: int = 64
    penalty: float = 1.0
    least_weight: float = 1.0
    patience: int = 30


@dataclass(frozen=True)
class Tree:
    """Nodes as in a heap: those below i are 2i + 1 and 2i + 2. A feature of -1 is a leaf. A row goes down on the left if its bin is at most `cut`, or 0 and missing goes left."""

    feature: tuple[int, ...]
    cut: tuple[int, ...]
    missing_left: tuple[bool, ...]
    weight: tuple[float, ...]

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row has come to after some levels."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = feature[at]
            b = bins[rows, np.maximum(f, 0)]
            goes_left = np.where(b == 0, left[at], b <= cut[at])
            at = np.where(f < 0, at, 2 * at + np.where(goes_left, 1, 2))
        return at

    def margin(self, bins: np.ndarray) -> np.ndarray:
        depth = (len(self.feature) + 1).bit_length() - 2
        return np.array(self.weight)[self.nodes(bins, depth)]


@dataclass(frozen=True)
class Boosted:
    columns: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    trees: tuple[Tree, ...]
    losses: tuple[float, ...] = field(default=(), compare=False)  # mean validation loss before each round

    def binned(self, values: list[np.ndarray]) -> np.ndarray:
        return binned(values, self.edges)

    def probability(self) -> Column:
        """P(label = 1) of a row, from its columns."""
        model = self

        @F.pandas_udf("double")
        def score(columns: pd.DataFrame) -> pd.Series:
            bins = model.binned([columns.iloc[:, i].to_numpy(np.float64) for i in range(len(model.columns))])
            return pd.Series(1 / (1 + np.exp(-sum((t.margin(bins) for t in model.trees), np.full(len(columns), model.base)))))

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns]))


def binned(values: list[np.ndarray], edges) -> np.ndarray:
    """Bin numbers (rows x features): 0 for a missing value, else 1 + the number of edges below it."""
    out = np.zeros((len(values[0]) if values else 0, len(values)), np.uint8)
    for i, (v, e) in enumerate(zip(values, edges)):
        out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(np.array(e), v, "left") + 1)
    return out


def quantile_edges(rows: DataFrame, columns: list[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Up to bins - 1 edges of each column, at its quantiles, in one pass; a value equal to an edge lies below it."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be from 2 to 255")
    shares = [k / bins for k in range(1, bins)]
    row = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, ACCURACY).alias(c) for c in columns]).first()
    return tuple(tuple(sorted(set(row[c] or ()))) for c in columns)


def _columns(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, n)
    return bins, np.asarray(batch.column("label"), np.float64), np.asarray(batch.column("part")), np.asarray(batch.column("margin"))


def _level(table: DataFrame, fresh: tuple[Tree, ...], tree: Tree | None, level: int, n: int, width: int) -> dict[int, tuple[int, int]]:
    """Sums of (gradient, curvature) by (node of this level, feature, bin) over the training rows; under -1 the validation rows' loss and number, at the first level."""
    nodes = 1 << level

    def run(batches):
        sums = np.zeros((2, nodes * n * width), np.int64)
        loss = [0, 0]
        for batch in batches:
            bins, y, part, margin = _columns(batch, n)
            margin = margin + sum(t.margin(bins) for t in fresh) if fresh else margin
            p = 1 / (1 + np.exp(-margin))
            held = part == _VALID
            if level == 0 and held.any():
                loss[0] += int(np.rint(np.logaddexp(0, np.where(y[held] > 0, -margin[held], margin[held])) * POINT).astype(np.int64).sum())
                loss[1] += int(held.sum())
            at = np.zeros(len(y), np.int64) if tree is None else tree.nodes(bins, level) - (nodes - 1)
            use = ~held & (at >= 0)
            g, h = np.rint((p - y)[use] * POINT), np.rint((p * (1 - p))[use] * POINT)
            place = ((at[use, None] * n + np.arange(n)) * width + bins[use]).ravel()
            for k, v in enumerate((g, h)):  # doubles hold these sums of a batch exactly
                sums[k] += np.bincount(place, np.repeat(v, n), nodes * n * width).astype(np.int64)
        used = np.flatnonzero(sums.any(axis=0))
        key, g, h = np.append(used, -1), np.append(sums[0][used], loss[0]), np.append(sums[1][used], loss[1])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(g), pa.array(h)], names=["key", "g", "h"])

    found = table.mapInArrow(run, "key bigint, g bigint, h bigint").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return {r["key"]: (r["g"], r["h"]) for r in found.collect()}  # nodes x features x bins at most


def best_split(g: np.ndarray, h: np.ndarray, rules: Rules) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing goes left) of a node, from its sums by feature and bin; the first of equals; None if nothing is gained."""
    best = None
    total_g, total_h = g[0].sum(), h[0].sum()
    score = lambda a, b: a * a / (b + rules.penalty)
    for f in range(len(g)):
        for missing_left in (True, False):
            gl, hl = np.cumsum(g[f, 1:])[:-1], np.cumsum(h[f, 1:])[:-1]
            if missing_left:
                gl, hl = gl + g[f, 0], hl + h[f, 0]
            gr, hr = total_g - gl, total_h - hl
            gain = score(gl, hl) + score(gr, hr) - score(total_g, total_h)
            gain = np.where((hl >= rules.least_weight) & (hr >= rules.least_weight), gain, -np.inf)
            cut = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[cut] > 1e-12 and (best is None or gain[cut] > best[0] + 1e-12):
                best = float(gain[cut]), f, cut + 1, missing_left
    return best


def _grown(table: DataFrame, fresh: tuple[Tree, ...], n: int, width: int, rules: Rules, after_first) -> Tree | None:
    """A tree, level by level; after_first is given the validation loss and says whether to go on."""
    size = (1 << (rules.depth + 1)) - 1
    feature, cut, left, weight = [-1] * size, [0] * size, [False] * size, [0.0] * size
    for level in range(rules.depth):
        tree = Tree(tuple(feature), tuple(cut), tuple(left), tuple(weight)) if level else None
        sums = _level(table, fresh, tree, level, n, width)
        if level == 0 and not after_first(*sums.pop(-1, (0, 0))):
            return None
        sums.pop(-1, None)
        grid = np.zeros((2, 1 << level, n, width))
        for key, (g, h) in sums.items():
            node, rest = divmod(key, n * width)
            grid[:, node, rest // width, rest % width] = g / POINT, h / POINT
        split = False
        for k in range(1 << level):
            g, h, at = grid[0, k], grid[1, k], (1 << level) - 1 + k
            found = best_split(g, h, rules)
            if level == 0:
                weight[at] = _weight(g[0].sum(), h[0].sum(), rules)
            if not found:
                continue
            _, f, c, missing_left = found
            feature[at], cut[at], left[at], split = f, c, missing_left, True
            gl, hl = g[f, 1 : c + 1].sum() + missing_left * g[f, 0], h[f, 1 : c + 1].sum() + missing_left * h[f, 0]
            weight[2 * at + 1], weight[2 * at + 2] = _weight(gl, hl, rules), _weight(g[f].sum() - gl, h[f].sum() - hl, rules)
        if not split:
            break
    return Tree(tuple(feature), tuple(cut), tuple(left), tuple(weight))


def _weight(g: float, h: float, rules: Rules) -> float:
    return float(-rules.rate * g / (h + rules.penalty))


def fit_boosted(rows: DataFrame, columns: list[str], label: str, valid: Column | None = None, rules: Rules = Rules()) -> Boosted:
    """Trees on the rows with a label that are not `valid`; stops when the validation rows' loss has not fallen for `patience` rounds, and keeps the trees up to its least. Missing and NaN values are bin 0 and go where the gain is greater. No labelled rows: no trees, even odds."""
    rows = rows.where(F.col(label).isNotNull()).withColumn("_valid", F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False))
    edges = quantile_edges(rows.where("NOT _valid"), columns, rules.bins)
    counts = rows.where("NOT _valid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).first()
    if not counts["n"]:
        return Boosted(tuple(columns), edges, 0.0, ())
    share = min(max(counts["pos"] / counts["n"], 1e-6), 1 - 1e-6)
    base, n, width = float(np.log(share / (1 - share))), len(columns), rules.bins + 1

    def coded(batches):
        for batch in batches:
            bins = binned([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)], edges)
            part = np.where(np.asarray(batch.column(n + 1)), _VALID, _TRAIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in bins], pa.binary()), batch.column(n), pa.array(part), pa.array(np.full(batch.num_rows, base))], names=["bins", "label", "part", "margin"])

    kind = "bins binary, label double, part int, margin double"
    table = written(rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("label"), "_valid").mapInArrow(coded, kind), "boosting")
    trees, fresh, losses = [], (), []

    def go_on(loss: int, held: int) -> bool:
        losses.append(loss / POINT / held if held else float("nan"))
        return not held or len(losses) - 1 - int(np.argmin(losses)) < rules.patience

    while len(trees) < rules.rounds:
        tree = _grown(table, fresh, n, width, rules, go_on)
        if tree is None:
            break
        trees.append(tree)
        fresh += (tree,)
        if len(fresh) == FRESH:
            before, table, fresh = table, _moved(table, fresh, n), ()
            dropped(before)
    if losses and not np.isnan(losses[0]):
        if len(losses) == len(trees):  # the last tree's loss is not known yet
            go_on(*_level(table, fresh, None, 0, n, width).get(-1, (0, 0)))
        trees = trees[: int(np.argmin(losses))]
    dropped(table)
    return Boosted(tuple(columns), edges, base, tuple(trees), tuple(losses))


def _moved(table: DataFrame, fresh: tuple[Tree, ...], n: int) -> DataFrame:
    """The table with the margins of some trees added."""

    def run(batches):
        for batch in batches:
            bins, _, _, margin = _columns(batch, n)
            yield batch.set_column(3, "margin", pa.array(margin + sum(t.margin(bins) for t in fresh)))

    return written(table.mapInArrow(run, table.schema), "boosting")
