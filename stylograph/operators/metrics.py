"""Evaluation of scores: rows of y (0 or 1), p, and pred or a group where needed. Aggregates only; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stage
from . import selection


def confusion(scores: DataFrame, *by: str) -> DataFrame:
    """tp, tn, fp, fn, accuracy, precision, recall, f1, mcc; 0 where a ratio has no ground."""
    n = lambda y, p: F.sum(((F.col("y") == y) & (F.col("pred") == p)).cast("long"))
    c = scores.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = over(tp, tp + fp), over(tp, tp + fn)
    return c.withColumns({
        "accuracy": over(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": over(2 * precision * recall, precision + recall),
        "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def _cumulative(scores: DataFrame) -> DataFrame:
    """p, pos, neg, and rows below p: one row a different score. Equal scores are counted before the window sees them.

    The window over all scores is made in two levels, ranges of p and then within them, so that no task sorts all scores.
    """
    counts = scores.filter("p is not null and y is not null").groupBy("p").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    cut = counts.withColumn("cell", F.floor(F.col("p") * 1024))
    sums = cut.groupBy("cell").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    before = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell: at most 1,025 for probabilities
    base = sums.select(F.col("cell").alias("c_"), F.coalesce(F.sum("cp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("cn").over(before), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(base), F.col("cell") == F.col("c_")).select("p", "pos", "neg", (F.col("bp") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_below"), (F.col("bn") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_below"))


def auroc(scores: DataFrame) -> DataFrame:
    """Mann-Whitney, ties count half; null if a class is empty."""
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return _cumulative(scores).agg(F.when(pairs > 0, won / pairs).alias("auroc"))


def tpr_at_fpr(scores: DataFrame, fpr: float = 0.01) -> DataFrame:
    """tau: the linear 1 - fpr quantile of negatives; tpr: share of positives at tau or above."""
    human = scores.filter("y = 0").select(F.lit(None).cast("string").alias("g"), F.col("p").alias("v"))
    tau = selection.quantiles(human, [1 - fpr], Stage(scores.sparkSession, "fpr")).select(F.col("value").alias("tau"))
    tau = scores.sparkSession.range(1).select(F.lit(0)).join(tau, F.lit(True), "left").select("tau")  # one row, null without negatives
    return scores.join(F.broadcast(tau), F.lit(True)).groupBy("tau").agg(F.avg(F.when(F.col("y") == 1, (F.col("p") >= F.col("tau")).cast("double"))).alias("tpr"))


def ece(scores: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error of the likelier class's probability, in equal bins, the last one closed."""
    sure = F.greatest("p", 1 - F.col("p"))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    cell = F.least(F.floor(sure * bins), F.lit(bins - 1))
    by = scores.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.avg(right).alias("acc"), F.avg(sure).alias("conf"))
    return by.agg((F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n")) / F.sum("n")).alias("ece"))


def weighted_f1(pairs: DataFrame) -> DataFrame:
    """weighted_f1 and accuracy from rows of label and pred, any number of classes."""
    cells = pairs.groupBy("label", "pred").agg(F.count("*").alias("n"))
    each = cells.select(F.col("label").alias("k"), F.col("n").alias("support"), F.lit(0).alias("named"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")).unionByName(cells.select(F.col("pred").alias("k"), F.lit(0).alias("support"), F.col("n").alias("named"), F.lit(0).alias("tp")))
    by = each.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("support", "named", "tp")))
    return by.agg((F.sum(F.col("support") * 2 * F.col("tp") / (F.col("support") + F.col("named"))) / F.sum("support")).alias("weighted_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def fpr_by_group(scores: DataFrame, group: str, least: int = 10) -> DataFrame:
    """group, n_human, fpr, tpr of groups with at least so many human rows."""
    rate = lambda y: F.avg(F.when(F.col("y") == y, (F.col("pred") == 1).cast("double")))
    return scores.groupBy(group).agg(F.sum((F.col("y") == 0).cast("long")).alias("n_human"), rate(0).alias("fpr"), rate(1).alias("tpr")).filter(F.col("n_human") >= least)


def verdict_share(p: Column, tau: float) -> Column:
    return F.avg((p >= tau).cast("double"))
