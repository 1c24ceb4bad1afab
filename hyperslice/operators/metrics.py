"""Evaluation: confusion counts, macro metrics, ROC-AUC, average precision, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def confusion(preds: DataFrame) -> DataFrame:
    """A11 over preds(y, pred): counts and shares of each true class."""
    n = preds.groupBy("y", "pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def macro_metrics(counts: DataFrame) -> DataFrame:
    """A12 over counts(y, pred, n): accuracy, and precision, recall and F1 averaged over all classes seen."""
    tp = counts.groupBy(F.col("y").alias("c")).agg(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("pos"))
    by = tp.join(counts.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("said")), "c", "full").na.fill(0)
    p, r = F.coalesce(F.col("tp") / F.expr("nullif(said, 0)"), F.lit(0.0)), F.coalesce(F.col("tp") / F.expr("nullif(pos, 0)"), F.lit(0.0))
    by = by.withColumns({"p": p, "r": r}).withColumn("f", F.coalesce(2 * F.col("p") * F.col("r") / F.expr("nullif(p + r, 0)"), F.lit(0.0)))
    return by.agg((F.sum("tp") / F.sum("pos")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def _ranked(scores: DataFrame) -> DataFrame:
    """scores(label, score, hit) -> per label and distinct score: p, n, and the sums over higher or equal scores."""
    by = scores.groupBy("label", "score").agg(F.sum("hit").alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy("label").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumns({"cp": F.sum("p").over(down), "cn": F.sum("n").over(down)})


def roc_auc(scores: DataFrame) -> DataFrame:
    """(label, auc), NULL where a side is empty."""
    r = _ranked(scores).withColumn("neg", F.col("n") - F.col("p"))
    by = r.groupBy("label").agg(F.sum(F.col("neg") * (F.col("cp") - F.col("p") / 2)).alias("wins"), F.sum("p").alias("pos"), F.sum("neg").alias("neg"))
    return by.select("label", (F.col("wins") / F.expr("nullif(pos * neg, 0)")).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """(label, ap), step-wise, ties as one step."""
    r = _ranked(scores)
    by = r.groupBy("label").agg(F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("area"), F.sum("p").alias("pos"))
    return by.select("label", (F.col("area") / F.expr("nullif(pos, 0)")).alias("ap"))


def best_threshold(scores: DataFrame, grid: int = 1001) -> DataFrame:
    """G19 over scores(score, hit): the smallest grid threshold of the largest F1, from a histogram of grid indexes."""
    h = scores.groupBy(F.floor(F.col("score") * (grid - 1) + 1e-9).cast("int").alias("i")).agg(F.sum("hit").alias("p"), F.count("*").alias("n"))
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # at most `grid` rows
    c = h.withColumns({"tp": F.sum("p").over(up), "said": F.sum("n").over(up), "pos": F.sum("p").over(Window.partitionBy())})
    c = c.withColumn("f1", F.coalesce(2 * F.col("tp") / F.expr("nullif(said + pos, 0)"), F.lit(0.0)))
    return c.orderBy(F.desc("f1"), "i").limit(1).select((F.col("i") / (grid - 1)).alias("tau"), "f1")
