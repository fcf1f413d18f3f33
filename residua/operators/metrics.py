"""Evaluation of binary predictions: one pass for all counts, ranks in buckets for the area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.operators.ranks import running_total
from residua.scratch import materialize


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp; always all four."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(*(F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, precision, recall, f1 and support of either class, and their macro and weighted means."""
    m = confusion_matrix(df, label, prediction)
    c = {k: F.col(k) for k in ("tn", "fp", "fn", "tp")}
    sides = F.array(
        F.struct(F.lit("Non-adhesion").alias("class"), c["tn"].alias("hit"), (c["tn"] + c["fn"]).alias("said"), (c["tn"] + c["fp"]).alias("support")),
        F.struct(F.lit("Adhesion").alias("class"), c["tp"].alias("hit"), (c["tp"] + c["fp"]).alias("said"), (c["tp"] + c["fn"]).alias("support")),
    )
    by = m.select(F.explode(sides).alias("s")).select("s.class", "s.support", _ratio(F.col("s.hit"), F.col("s.said")).alias("precision"), _ratio(F.col("s.hit"), F.col("s.support")).alias("recall"))
    by = by.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    macro = by.agg(F.lit("macro avg").alias("class"), *(F.avg(n).alias(n) for n in names), F.sum("support").alias("support"))
    weighted = by.agg(F.lit("weighted avg").alias("class"), *(_ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names), F.sum("support").alias("support"))
    return by.select("class", *names, "support").unionByName(macro).unionByName(weighted)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve by mid-ranks, ties counted half; null where only one class occurs."""
    by = df.groupBy(score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg"))
    by = materialize(by, "scores")  # read for the cuts, the totals and the rows
    below = running_total(by, [], score, [], F.col("neg"), "below")
    return below.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def cv_summary(df: DataFrame, fold: str = "fold", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean accuracy over folds and twice its population deviation."""
    each = df.groupBy(fold).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("a"))
    return each.agg(F.avg("a").alias("mean_accuracy"), (2 * F.stddev_pop("a")).alias("two_std"))


def centroid(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Mean of each dimension by group."""
    parts = df.select(by, F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
