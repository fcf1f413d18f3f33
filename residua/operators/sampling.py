"""Seeded samples, hold-outs, folds and batches: exact sizes, independent of row order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.ranks import hash_order, row_numbers


def anti_join_ids(ids: DataFrame, ignored: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(ignored.select(key), key, "left_anti")


def subset_by_ids(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return records.join(ids.select(key), key, "left_semi")


def sample_per_source(df: DataFrame, source: str, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """``n`` rows of each source, or all that it has. The rank is cut off before it is shuffled."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(source).orderBy(order, key))).filter(F.col("rn") <= n).drop("rn")


def class_quotas(counts: dict[int, int], part: float) -> dict[int, int]:
    """How many rows of each class make up ceil(n * part): proportional, remainders to the largest fractions."""
    n = sum(counts.values())
    want = math.ceil(n * part)
    exact = {k: c * want / n for k, c in counts.items()}
    quota = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (quota[k] - exact[k], k))[: want - sum(quota.values())]:
        quota[k] += 1
    return quota


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: of each class its quota by hash order."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # a row for each class
    quotas = F.lit(0)
    for k, q in class_quotas(counts, test_size).items():
        quotas = F.when(F.col(label) == k, q).otherwise(quotas)
    ranked = row_numbers(df.withColumn("__h", hash_order(seed, key)), [label], "__h", [key], "__rn")
    return ranked.withColumn("is_test", F.col("__rn") <= quotas).drop("__h", "__rn")


def fold_sizes(counts: dict[int, int], folds: int) -> dict[int, list[int]]:
    """Rows of each class in each fold: with classes in order, the row at global place i counts for fold i mod folds."""
    sizes, place = {}, 0
    for k in sorted(counts):
        sizes[k] = [len(range(place + (f - place) % folds, place + counts[k], folds)) for f in range(folds)]
        place += counts[k]
    return sizes


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """Adds ``fold`` (from 0): consecutive blocks of each class in order of ``key``, of its hash where it is a string."""
    if dict(df.dtypes)[key] == "string":
        return stratified_folds(df.withColumn("__key", F.xxhash64(key)), label, "__key", folds).drop("__key")
    sizes = fold_sizes({r[0]: r[1] for r in df.groupBy(label).count().collect()}, folds)
    ranked = row_numbers(df, [label], key, [], "__rn")
    fold = F.lit(None).cast("int")
    for k, each in sizes.items():
        end, inner = sum(each), F.lit(folds - 1)
        for f in reversed(range(folds)):
            inner = F.when(F.col("__rn") <= end, f).otherwise(inner)
            end -= each[f]
        fold = F.when(F.col(label) == k, inner).otherwise(fold)
    return ranked.withColumn("fold", fold.cast("int")).drop("__rn")


def assign_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``batch`` (from 0): ``size`` rows each in order of ``key``."""
    return row_numbers(df, [], key, [], "__rn").withColumn("batch", F.floor((F.col("__rn") - 1) / size).cast("bigint")).drop("__rn")
