"""Daily panel: features, labels, evaluation of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom.functions import windows as w
from quantloom.functions.expr import first_match, ratio
from quantloom.operators.learning import spearman
from quantloom.operators.ranks import running_before

RETURNS, AVERAGES = (1, 5, 10, 20), (5, 10, 20)


def panel_features(bars: DataFrame) -> DataFrame:
    """Returns over 1, 5, 10, 20 bars, distance from means of 5, 10, 20, volatility of 20 (population), volume against its mean of 5 with this bar, limit flags."""
    s, c = w.by("symbol"), F.col("close")
    # each window once: the planner does not see that a ratio names one twice
    past = {f"_lag_{n}": F.lag("close", n).over(s) for n in RETURNS} | {f"_mean_{n}": w.trailing("mean", "close", s, n) for n in AVERAGES} | {"_volume_5": w.trailing("mean", "volume", s, 5)}
    out = bars.withColumns(past)
    out = out.withColumns({f"ret_{n}": ratio(c - F.col(f"_lag_{n}"), f"_lag_{n}") for n in RETURNS} | {f"dev_{n}": ratio(c - F.col(f"_mean_{n}"), f"_mean_{n}") for n in AVERAGES} | {"volume_ratio": ratio("volume", "_volume_5")})
    limit = {"limit_up": F.coalesce(F.col("ret_1") >= 0.1 - 1e-6, F.lit(False)), "limit_down": F.coalesce(F.col("ret_1") <= -0.1 + 1e-6, F.lit(False))}
    return out.withColumns({"vol_20": w.trailing("std0", "ret_1", s, 20)} | limit).drop(*past)


def panel_labels(feat: DataFrame) -> DataFrame:
    """Return from the next open to the next close, its sign as label, and why a row can't be used: no_next_bar, close_limit_up, next_open_limit_up."""
    s = w.by("symbol")
    feat = feat.withColumns({"_next_open": F.lead("open").over(s), "_next_close": F.lead("close").over(s)})
    nxt_o, nxt_c = F.col("_next_open"), F.col("_next_close")
    reason = first_match([(nxt_o.isNull(), "no_next_bar"), (F.col("limit_up"), "close_limit_up"), (nxt_o >= F.col("close") * 1.1 - 1e-6, "next_open_limit_up")])
    out = feat.withColumns({"next_return": ratio(nxt_c - nxt_o, nxt_o), "reason": reason})
    return out.drop("_next_open", "_next_close").withColumns({"eligible": F.col("reason").isNull(), "label": F.when(F.col("reason").isNull(), (F.col("next_return") > 0).cast("int"))})


def auc(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Area under the ROC curve from rank sums with average ranks for ties. scored: score, label (0, 1). With `by`, for each group. Distinct scores are ranked over range partitions, so a group,
    or the whole table, may be of any size."""
    keys = [by] if by else []
    counts = scored.where("score IS NOT NULL AND label IS NOT NULL").groupBy(*keys, "score").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    pairs = running_before(counts, keys, ["score"], {"below": "neg"}).withColumn("wins", F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
    return pairs.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("wins") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def rank_ic(scored: DataFrame, by: str) -> DataFrame:
    """Spearman correlation of score and outcome in each group: Pearson over average ranks."""
    return spearman(scored, by)


def threshold_grid(scored: DataFrame, low: int = 50, high: int = 70) -> DataFrame:
    """Youden's J of each threshold in hundredths, in one pass; `best` marks the first of the largest."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    row = scored.agg(*[(F.count_if((F.col("score") >= t / 100) & (F.col("label") == 1)) / pos - F.count_if((F.col("score") >= t / 100) & (F.col("label") == 0)) / neg).alias(str(t)) for t in range(low, high + 1)])
    grid = row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("percent"), F.col(str(t)).alias("j")) for t in range(low, high + 1)])))
    return grid.withColumn("best", F.row_number().over(Window.orderBy(F.col("j").desc(), "percent")) == 1)  # a row for each threshold


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold."""
    hit = F.col("score") >= threshold
    tp, fp = F.count_if(hit & (F.col("label") == 1)), F.count_if(hit & (F.col("label") == 0))
    fn, tn = F.count_if(~hit & (F.col("label") == 1)), F.count_if(~hit & (F.col("label") == 0))
    return scored.where("score IS NOT NULL AND label IS NOT NULL").agg(ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
