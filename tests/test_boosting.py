"""Boosted trees against a plain recursive version, whatever the partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import boosting as b


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(11)
    n = 200
    x, y, z = r.normal(size=n), np.round(r.normal(size=n), 1), r.integers(0, 3, n).astype(float)
    label = ((x + (z == 1) * 2 - y * 0.5 + r.normal(size=n) * 0.3) > 0.4).astype(int)
    x[r.random(n) < 0.15] = np.nan
    return pd.DataFrame({"x": x, "y": y, "z": z, "label": label, "k": np.arange(n)})


def spark_frame(spark, frame):
    return spark.createDataFrame(frame.astype({"x": object}).where(frame.notna(), None), "x double, y double, z double, label int, k int")


def naive_tree(bins, g, h, rules, node=0, level=0, out=None, weight=None):
    """Every (feature, side of the missing, cut) tried on the rows themselves."""
    out = {} if out is None else out
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + rules.penalty)
    rows = np.ones(len(g), bool) if weight is None else weight
    out[node] = -rules.rate * g[rows].sum() / (h[rows].sum() + rules.penalty), None
    if level == rules.depth:
        return out
    best = None
    for f in range(bins.shape[1]):
        for left in (True, False):
            for cut in range(1, rules.bins):
                side = rows & np.where(bins[:, f] == 0, left, bins[:, f] <= cut)
                if h[side].sum() < rules.least_weight or h[rows & ~side].sum() < rules.least_weight:
                    continue
                gain = score(side) + score(rows & ~side) - score(rows)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, cut, left, side
    if best:
        _, f, cut, left, side = best
        out[node] = out[node][0], (f, cut, left)
        naive_tree(bins, g, h, rules, 2 * node + 1, level + 1, out, side)
        naive_tree(bins, g, h, rules, 2 * node + 2, level + 1, out, rows & ~side)
    return out


def test_trees_against_a_plain_version(spark, frame):
    rules = b.Rules(rounds=4, depth=3, rate=0.3, bins=8, least_weight=0.5)
    model = b.fit_boosted(spark_frame(spark, frame).repartition(5), ["x", "y", "z"], "label", rules=rules)
    bins = model.binned([frame[c].to_numpy(float) for c in "xyz"])
    y = frame["label"].to_numpy(float)
    margin = np.full(len(frame), np.log(y.mean() / (1 - y.mean())))
    assert model.base == pytest.approx(margin[0]) and len(model.trees) == 4
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want = naive_tree(bins, p - y, p * (1 - p), rules)
        for node, (weight, split) in want.items():
            assert tree.weight[node] == pytest.approx(weight, abs=1e-5)
            assert (tree.feature[node], tree.cut[node], tree.missing_left[node])[: 3 if split else 1] == (split or (-1,))
        margin = margin + tree.margin(bins)
    got = spark_frame(spark, frame).select("k", model.probability().alias("p")).toPandas().sort_values("k")["p"]
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-margin)), rtol=1e-9)


def test_the_same_trees_however_rows_are_dealt(spark, frame):
    rules = b.Rules(rounds=12, depth=2, rate=0.2, bins=16)  # margins are written anew in between
    df = spark_frame(spark, frame)
    one, two = (b.fit_boosted(df.repartition(n), ["x", "y", "z"], "label", F.col("k") % 4 == 0, rules) for n in (1, 7))
    assert one == two and one.losses == two.losses and len(one.trees) > 2


def test_early_stop_keeps_the_best_round(spark, frame):
    noise = frame.assign(label=np.random.default_rng(2).integers(0, 2, len(frame)))
    model = b.fit_boosted(spark_frame(spark, noise), ["x", "y", "z"], "label", F.col("k") % 2 == 0, b.Rules(rounds=40, depth=4, rate=0.8, bins=32, least_weight=0.1, patience=3))
    assert len(model.losses) < 40 and len(model.trees) == int(np.argmin(model.losses))
    assert len(model.losses) - 1 - len(model.trees) == 3


def test_no_rows_one_class_and_empty_columns(spark, frame):
    df = spark_frame(spark, frame)
    assert b.fit_boosted(df.limit(0), ["x"], "label").trees == ()
    one = b.fit_boosted(df.withColumn("label", F.lit(1)), ["x"], "label", rules=b.Rules(rounds=2))
    assert df.select(F.min(one.probability())).first()[0] > 0.99
    none = b.fit_boosted(df.withColumn("e", F.lit(None).cast("double")), ["e", "x"], "label", rules=b.Rules(rounds=2, depth=2))
    assert none.edges[0] == () and any(1 in t.feature for t in none.trees)
    with pytest.raises(ValueError, match="bins"):
        b.fit_boosted(df, ["x"], "label", rules=b.Rules(bins=500))
