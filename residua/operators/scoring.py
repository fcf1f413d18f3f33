"""Scores of a linear model as column expressions, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "Adhesion", "Non-adhesion"


def linear_score(features: list[Column], weights: list[float], bias: float) -> Column:
    z = F.lit(bias)
    for f, w in zip(features, weights, strict=True):
        z = z + f * F.lit(w)
    return z


def probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def class_name(positive: Column) -> Column:
    return F.when(positive, POSITIVE).otherwise(NEGATIVE)


def predictions(scored: DataFrame, key: str, z: str, show_all: bool = False) -> DataFrame:
    """id, prediction and probability_adhesion; only positive ones unless ``show_all``."""
    rows = scored if show_all else scored.filter(F.col(z) > 0)
    return rows.select(F.col(key).cast("string").alias("id"), class_name(F.col(z) > 0).alias("prediction"), probability(F.col(z)).alias("probability_adhesion"))
