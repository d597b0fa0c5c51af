"""Event study, ridge regression from sums, walk-forward scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.expr import ratio
from quantloom.operators.ranks import average_ranks, numbered
from quantloom.sources.shared import written


def bucket_edge(n, k: int, q: int):
    """k-th of the inner edges of q equal-frequency buckets of the ranks 1..n: the k/q quantile by linear interpolation, in the usual order of rounding."""
    at = (n - 1) * F.lit((k * (1.0 / q)) * 100 / 100)
    low = F.floor(at)
    t = at - low
    return F.when(t >= 0.5, (low + 2) - (1 - t)).otherwise((low + 1) + t)


def event_study(rows: DataFrame, q: int, cost: float) -> DataFrame:
    """For each group of `group` and each of q equal-frequency buckets of the factor's rank (ties by key): size, range and mean of the factor, mean outcome, net of cost, and share of gains.

    rows: group, key, factor, outcome.
    """
    ranked = numbered(rows.where("factor IS NOT NULL AND outcome IS NOT NULL"), ["group"], ["factor", "key"], size="n")
    # the bucket is the first whose upper edge reaches the rank
    bucket = F.lit(1)
    for k in range(1, q):
        bucket = bucket + (F.col("rank") > bucket_edge(F.col("n"), k, q)).cast("int")
    return ranked.groupBy("group", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("factor").alias("low"), F.max("factor").alias("high"), F.avg("factor").alias("mean_factor"), F.avg("outcome").alias("mean_outcome"), (F.avg("outcome") - cost).alias("mean_net"), F.avg((F.col("outcome") > 0).cast("double")).alias("hit_rate")
    )


@dataclass(frozen=True)
class Ridge:
    """Standardised ridge model: medians fill gaps; columns without any value are left out."""

    columns: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self):
        out = F.lit(self.intercept)
        for c, med, mean, scale, weight in zip(self.columns, self.medians, self.means, self.scales, self.weights):
            out = out + weight * (F.coalesce(F.col(c), F.lit(med)) - mean) / scale
        return out


def fit_ridge(rows: DataFrame, columns: list[str], target: str, penalty: float = 1.0) -> Ridge:
    """Fits from two passes of aggregates (medians; sums of products); only p x p numbers reach the driver. Without rows: a model that scores 0."""
    found = _fold_models(rows.withColumn("fold", F.lit(0)), columns, target, penalty)
    return found[0][1] if found else Ridge((), (), (), (), (), 0.0)


def choose_threshold(scored: DataFrame, candidates: list[float], outcome: str, cost: float, least: int = 10) -> float:
    """The candidate with the best mean net outcome above it, in one pass; the first of equals; infinity if none has `least` rows."""
    row = scored.agg(*[x for i, t in enumerate(candidates) for x in (F.avg(F.when(F.col("score") >= t, F.col(outcome) - cost)).alias(f"m{i}"), F.count_if(F.col("score") >= t).alias(f"n{i}"))]).first()
    able = [(row[f"m{i}"], -i) for i in range(len(candidates)) if row[f"n{i}"] >= least and row[f"m{i}"] is not None]
    return candidates[-max(able)[1]] if able else float("inf")


def _fold_models(rows: DataFrame, columns: list[str], target: str, penalty: float) -> dict[int, tuple[int, Ridge]]:
    """For each fold (column `fold`) the number of its rows and its model: two aggregates for all folds together."""
    rows = rows.where(F.col(target).isNotNull())
    med = rows.groupBy("fold").agg(*[F.percentile(c, 0.5).alias(f"_m{i}") for i, c in enumerate(columns)])
    spark = rows.sparkSession
    found = {r["fold"]: r for r in med.collect()}  # a row for each fold
    if not found:
        return {}
    kind = "fold int, " + ", ".join(f"_m{i} double" for i in range(len(columns)))
    filled = rows.join(F.broadcast(spark.createDataFrame([tuple(r) for r in found.values()], kind)), "fold")
    x = [F.coalesce(F.col(c), F.col(f"_m{i}")) for i, c in enumerate(columns)]
    y = F.col(target)
    sums = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("y")]
    for i, a in enumerate(x):
        sums += [F.avg(a).alias(f"m{i}"), F.stddev_pop(a).alias(f"s{i}"), F.covar_pop(a, y).alias(f"y{i}"), *[F.covar_pop(a, b).alias(f"c{i}_{j}") for j, b in enumerate(x) if j >= i]]
    out = {}
    for r in filled.groupBy("fold").agg(*sums).collect():
        kept = [i for i in range(len(columns)) if found[r["fold"]][f"_m{i}"] is not None]
        out[r["fold"]] = r["n"], _solved(r, [columns[i] for i in kept], kept, [float(found[r["fold"]][f"_m{i}"]) for i in kept], penalty)
    return out


def _solved(r, columns: list[str], at: list[int], medians: list[float], penalty: float) -> Ridge:
    p, n = len(at), r["n"]
    scale = np.array([r[f"s{i}"] if r[f"s{i}"] > 1e-12 else 1.0 for i in at])
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in at] for i in at]).reshape(p, p)
    gram, moment = n * cov / np.outer(scale, scale) + penalty * np.eye(p), n * np.array([r[f"y{i}"] for i in at]) / scale
    try:
        weight = np.linalg.solve(gram, moment)
    except np.linalg.LinAlgError:
        weight = np.linalg.lstsq(gram, moment, rcond=None)[0]
    return Ridge(tuple(columns), tuple(medians), tuple(float(r[f"m{i}"]) for i in at), tuple(map(float, scale)), tuple(map(float, weight)), float(r["y"]))


def _scored(rows: DataFrame, models: dict[int, Ridge], columns: list[str]) -> DataFrame:
    """rows with `score`, each by its fold's model; the models travel as a small table."""
    table = []
    for fold, m in models.items():
        of = {c: (med, mean, s, w) for c, med, mean, s, w in zip(m.columns, m.medians, m.means, m.scales, m.weights)}
        table.append((fold, m.intercept, *[v for c in columns for v in of.get(c, (0.0, 0.0, 1.0, 0.0))]))
    kind = "fold int, _b double" + "".join(f", _a{i} double, _e{i} double, _s{i} double, _w{i} double" for i in range(len(columns)))
    score = F.col("_b")
    for i, c in enumerate(columns):
        score = score + F.col(f"_w{i}") * (F.coalesce(F.col(c), F.col(f"_a{i}")) - F.col(f"_e{i}")) / F.col(f"_s{i}")
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, kind)), "fold").withColumn("score", score).drop("_b", *[f"_{k}{i}" for i in range(len(columns)) for k in "aesw"])


def walk_forward(rows: DataFrame, columns: list[str], target: str, train: int, validate: int, test: int, candidates: list[float], cost: float = 0.0, least: int = 30, penalty: float = 1.0) -> DataFrame:
    """Out-of-sample scores: over sessions in order, fit on `train`, choose a threshold on `validate`, refit on both and score `test`; then move on by `test`.

    rows: session (ordered), label_end (session in which the label is known), columns, target. Rows whose label is known only at or after the next
    part begins are left out of a fit. A row is dealt to each fold whose windows it lies in, (train + validate) / test + 1 of them, and all folds are fitted, tuned and
    scored together, in five jobs however many there are. The driver holds the sessions and a model for each fold.
    """
    spark = rows.sparkSession
    days = [r["session"] for r in rows.select("session").distinct().orderBy("session").collect()]
    base, n = train + validate, len(range(train + validate, len(days), test))
    none = F.lit(None).cast("double")
    empty = rows.limit(0).withColumns({"score": none, "threshold": none, "fold": F.col("session"), "prediction": F.lit(0)})
    if not n:
        return empty
    kind = rows.schema["session"].dataType.simpleString()
    at = F.broadcast(spark.createDataFrame(list(zip(days, range(len(days)))), f"session {kind}, _at int"))
    edges = F.broadcast(spark.createDataFrame([(f, days[base + f * test - validate], days[base + f * test]) for f in range(n)], f"fold int, _valid {kind}, _test {kind}"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_at") - (test - 1) - base) / test)).cast("int"), F.least(F.lit(n - 1), F.floor((F.col("_at") + base - base) / test)).cast("int")
    dealt = rows.join(at, "session").withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("fold", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    begin = base + F.col("fold") * test
    part = F.when(F.col("_at") >= begin, "test").when(F.col("_at") >= begin - validate, "valid").otherwise("train")
    dealt = dealt.withColumn("_part", part).where(F.col("_at") >= begin - base).join(edges, "fold")
    names = list(dict.fromkeys([*rows.columns, "fold", "_part", "_valid", "_test"]))
    dealt = written(dealt.select(*names), "walk-forward")  # five passes read it
    known, end = F.col("_part"), F.col("label_end")
    fitted = _fold_models(dealt.where((known == "train") & (end < F.col("_valid"))), columns, target, penalty)
    fitted = {f: m for f, (k, m) in fitted.items() if k >= least}
    if not fitted:
        return empty
    valid = _scored(dealt.where((known == "valid") & (end < F.col("_test"))), fitted, columns)
    tries = [x for i, t in enumerate(candidates) for x in (F.avg(F.when(F.col("score") >= t, F.col(target) - cost)).alias(f"m{i}"), F.count_if(F.col("score") >= t).alias(f"n{i}"))]
    cut = dict.fromkeys(fitted, float("inf"))
    for r in valid.groupBy("fold").agg(*tries).collect():
        able = [(r[f"m{i}"], -i) for i in range(len(candidates)) if r[f"n{i}"] >= 10 and r[f"m{i}"] is not None]
        cut[r["fold"]] = candidates[-max(able)[1]] if able else float("inf")
    both = {f: m for f, (_, m) in _fold_models(dealt.where((known != "test") & (end < F.col("_test")) & F.col("fold").isin(list(fitted))), columns, target, penalty).items()}
    out = _scored(dealt.where(known == "test"), both, columns).join(F.broadcast(spark.createDataFrame(list(cut.items()), "fold int, threshold double")), "fold")
    out = out.withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int")).withColumn("fold", F.col("_test"))
    return out.select(*rows.columns, "score", "threshold", "fold", "prediction")


def score_latest(rows: DataFrame, columns: list[str], target: str, penalty: float = 1.0) -> DataFrame:
    """The newest session's rows with their score, by a model of the rows whose label was known before it. rows: as for walk_forward."""
    newest = rows.agg(F.max("session").alias("s")).first()["s"]
    model = fit_ridge(rows.where(F.col("label_end") < F.lit(newest)), columns, target, penalty)
    return rows.where(F.col("session") == F.lit(newest)).withColumn("score", model.score())


def execution_signals(scored: DataFrame, threshold: float, exit_threshold: float = 0.0) -> DataFrame:
    """Adds signal: 1 where an eligible row's score reaches the threshold, -1 where it is at most exit_threshold, else 0. Rows without score or not eligible never trade. scored: score, eligible."""
    able = F.coalesce(F.col("eligible"), F.lit(False)) & F.col("score").isNotNull()
    return scored.withColumn("signal", F.when(able & (F.col("score") >= threshold), 1).when(able & (F.col("score") <= exit_threshold), -1).otherwise(0))


def summary(predicted: DataFrame, target: str, cost: float) -> DataFrame:
    """For each fold: rows, predictions, their mean net outcome and share of gains, and the Spearman correlation of score and outcome (`ic`) over rows that have both."""
    hit = F.col("prediction") == 1
    out = predicted.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_predicted"), F.avg(F.when(hit, F.col(target) - cost)).alias("mean_net"), ratio(F.count_if(hit & (F.col(target) > cost)), F.count_if(hit)).alias("hit_rate"))
    return out.join(spearman(predicted.select("fold", "score", F.col(target).alias("outcome")), "fold").select("fold", "ic"), "fold", "left")


def spearman(scored: DataFrame, by: str) -> DataFrame:
    """n and ic for each group: Pearson's correlation of average ranks of score and outcome, NULL where either has one rank only; rows without both are left out. scored: `by`, score, outcome."""
    both = scored.where("score IS NOT NULL AND outcome IS NOT NULL").select(by, "score", "outcome")
    ranked = average_ranks(average_ranks(both, [by], "score", "r1"), [by], "outcome", "r2")
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), ratio(F.covar_pop("r1", "r2"), F.stddev_pop("r1") * F.stddev_pop("r2")).alias("ic"))
