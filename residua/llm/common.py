"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.scratch import discard, materialize, scratch_path

__all__ = ["Bitmap", "any_names", "bitmap_of", "discard", "document_key", "held", "join_counted", "join_skewed", "marked", "map_batches", "materialize", "parts_for", "scratch_path", "spare", "utf8"]

#: A key is hot where it has more than one in so many rows; so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Bits of a bitmap for each value, and the most that one has (32 MB).
BITS_EACH, MAX_BITS = 16, 28
#: Where the parts of a hash begin that are marked.
SHIFTS = (0, 18, 36)


def spare(columns: list[str], *names: str) -> list[str]:
    """Names that are none of ``columns``, made from ``names``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def any_names(*added: str) -> Callable:
    """For functions of documents that keep all columns: these may have names of any kind, with dots, blanks or doubled.

    Within the function ``doc_id`` and ``text`` have their names and all others plain ones, by place. Its result has
    those columns and the ones that it ``added``, which get spare names where the documents have theirs.
    """

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            plain = [c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)]
            out = fn(docs.toDF(*plain), *args, **kwargs)
            return out.select(*plain, *added).toDF(*docs.columns, *spare(docs.columns, *added))

        return run

    return wrap


def document_key(doc_id: str, digest: Column) -> list[Column]:
    """unnamed, known_id and digest: what tells documents apart, as columns that are never null."""
    return [F.col(doc_id).isNull().alias("unnamed"), F.coalesce(doc_id, F.lit(0)).alias("known_id"), digest.alias("digest")]


def join_counted(rows: DataFrame, facts: DataFrame, key: str | list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Joins many rows for a key with at most one fact for each key, exact whatever share of the rows a key has.

    ``facts`` tell in column ``n`` how many rows a key has of ``total``. Those of hot keys, fewer than
    HOT_SHARE of them, are broadcast and meet their rows in place; all others are joined by key (``how``
    inner or left). Null keys meet nothing. Tables are read more than once: pass written ones, or aggregates.
    """
    keys = [key] if isinstance(key, str) else key
    is_hot = F.col(n) * HOT_SHARE > total
    hot = F.broadcast(facts.filter(is_hot))
    rest = rows.join(F.broadcast(facts.filter(is_hot).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(facts.filter(~is_hot), keys, how))


def join_skewed(rows: DataFrame, facts: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner ``join_counted`` where the rows of each key must be counted first. Hot keys without a fact are not shuffled either."""
    keys = [key] if isinstance(key, str) else key
    (n,) = spare([*rows.columns, *facts.columns], "n")
    total = rows.count()
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(n))
    hot = materialize(counts.filter(F.col(n) * HOT_SHARE > total).select(*keys), "hot")
    met = rows.join(F.broadcast(facts.join(F.broadcast(hot), keys, "left_semi")), keys)
    return met.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(facts, keys))


class Bitmap:
    """Marks of 64-bit hashes, each by three parts of it: what has all its marks may still be another value, what lacks one is certain."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(64 * len(words) - 1)

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for shift in SHIFTS:
            at = hashes.view(np.uint64) >> np.uint64(shift) & self.mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bitmap_of(hashes: DataFrame, column: str) -> Bitmap:
    """A bitmap of a column of longs, sized by their number up to 32 MB; its words are made in the cluster, and only these come to the driver."""
    n = hashes.count()
    bits = min(MAX_BITS, max(16, (BITS_EACH * n - 1).bit_length()))
    parts = F.array(*(F.shiftrightunsigned(column, shift) for shift in SHIFTS))
    at = hashes.select(F.explode(parts).alias("at")).select(F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return Bitmap(out)


def marked(hash_: Column, bitmap: Bitmap) -> Column:
    """Whether a row's hash has a mark; only the hashes go to Python."""
    shared = SparkContext.getOrCreate().broadcast(bitmap)

    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.marked(h.to_numpy()))

    return F.pandas_udf(probe, "boolean")(hash_)


#: The one thing that a Python worker keeps between tasks.
_HELD: dict = {}


def held(key, make: Callable):
    """What ``make`` makes, kept by this worker until something else is: caches of several operators don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def map_batches(df: DataFrame, fn: Callable[[list[list]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """Arrow batches through ``fn``: it gets the columns as lists and yields dicts of output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn([c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def utf8(name: str) -> Column:
    """The column's bytes; null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))
