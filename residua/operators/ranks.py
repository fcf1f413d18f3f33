"""Exact running totals and ranks over whole tables without gathering a group in one task.

Rows are cut into buckets of their order column at approximate quantiles. Totals of the buckets give each
bucket what comes before it; a window ranks within a bucket only. The number of buckets follows the
number of rows, and where the cuts fall changes the work, never the result. Rows of one order value share
a bucket, so the order should be nearly unique: a key, a hash, or distinct values that were counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 500_000
MIN_BUCKETS, MAX_BUCKETS = 64, 20_000


def bucket_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are below the value, by halving: a step for each power of two of them."""
    table = F.lit(cuts)

    def step(a: Column, _: Column) -> Column:
        mid = F.shiftright(a.lo + a.hi, 1)
        below = (a.lo < a.hi) & (F.get(table, mid) < value)
        return F.struct(F.when(below, mid + 1).otherwise(a.lo).alias("lo"), F.when(below, a.hi).otherwise(F.least(mid, a.hi)).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, step).lo


def running_total(df: DataFrame, by: list[str], order: str, ties: list[str], amount: Column, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over earlier rows of the same ``by``, in order of ``order`` and ``ties``.

    ``df`` is computed three times (number and cuts, totals, rows): pass a scan or a written table. Rows
    without an order value come first.
    """
    n = df.agg(F.count("*")).first()[0]
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, n // bucket_rows))
    cuts = df.agg(F.approx_percentile(F.col(order), [k / buckets for k in range(1, buckets)], 8 * buckets).alias("c")).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.when(F.col(order).isNull(), -1).otherwise(bucket_of(F.col(order), cuts)) if cuts else F.lit(0)
    rows = df.withColumn("__bucket", bucket).withColumn("__amount", amount)
    keys = [*by, "__bucket"]
    totals = rows.groupBy(*keys).agg(F.sum("__amount").alias("__sum"))  # at most one row for each group and bucket
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inner", F.coalesce(F.sum("__amount").over(within), F.lit(0)))
    return rows.join(offsets, keys).withColumn(name, F.col("__before") + F.col("__inner")).drop("__bucket", "__amount", "__inner", "__before")


def row_numbers(df: DataFrame, by: list[str], order: str, ties: list[str], name: str = "rn") -> DataFrame:
    """Row numbers from 1 within ``by``."""
    return running_total(df, by, order, ties, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) + 1)


def hash_order(seed: int, key: str) -> Column:
    """A seeded order that doesn't depend on the rows' places: the first 15 hex digits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")
