"""An index of byte offsets for sequence files, and fetches that read only what is asked for.

The index has a row for each record: file, place and size in bytes, letters, and the width of lines where they are
even. It is made in the cluster, stored in order of id, and pruned by the range of ids asked for. A fetch puts the
places that it needs in the list's order and reads those bytes alone; a region ``id:from-to`` of a record with even
lines is found by arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.scratch import materialize
from residua.sources import datasource, ranges

#: Places and bytes of a task, and files that it keeps open.
TASK_PLACES, TASK_BYTES, OPEN_FILES = 5000, 64 << 20, 32
#: A region as tools write it: counted from 1, both ends included, either may be left out.
REGION = r"^(.*):([0-9]*)-([0-9]*)$"
FETCHED = "ord bigint, id string, sequence string"


def build(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """An index row (``datasource.INDEX``) for each record of plain files; repeated ids have a row each."""
    return datasource.load(spark, path, "index", **options)


def save(index: DataFrame, folder: str) -> None:
    """Stored in order of id, so that the statistics of its files and row groups prune a read."""
    index.repartitionByRange("id", "offset").sortWithinPartitions("id", "offset").write.mode("overwrite").parquet(folder)


def regions(ids: DataFrame, place: str = "ord") -> DataFrame:
    """ord, asked, id, low and high of entries of ``id`` that may be regions; low and high are null for whole records.

    An entry that is itself an id of the index is that record, whatever its form: see ``wanted``.
    """
    part = lambda k: F.nullif(F.regexp_extract("id", REGION, k), F.lit(""))
    return ids.select(F.col(place).cast("bigint").alias("ord"), F.col("id").alias("asked"), part(1).alias("id"), part(2).try_cast("bigint").alias("low"), part(3).try_cast("bigint").alias("high"))


def wanted(index: DataFrame, ids: DataFrame, place: str = "ord") -> DataFrame:
    """The places to read: ord, id (as asked), file_path, start, size, and ``skip`` and ``take`` of letters read (take null: all).

    Of records that share an id the first in order of file and offset counts, as an index of names has one place.
    """
    some = index
    record = F.nullif(F.regexp_extract("id", REGION, 1), F.lit(""))
    named = [b for b in ids.agg(F.min("id"), F.max("id"), F.min(record), F.max(record)).first() if b is not None]
    if named:
        some = index.filter(F.col("id").between(min(named), max(named)))  # prunes row groups of a stored index
    entry = regions(ids, place)
    keys = entry.select("asked").union(entry.select("id").dropna()).toDF("id").distinct()
    first = F.min(F.struct("file_path", "offset", "bytes", "body", "letters", "line_letters", "line_bytes")).alias("at")
    known = some.join(keys, "id", "left_semi").groupBy("id").agg(first).select("id", "at.*")
    whole = entry.select("ord", F.col("asked").alias("id")).join(known, "id")
    whole = whole.select("ord", F.col("id").alias("asked"), "file_path", F.col("body").alias("start"), (F.col("offset") + F.col("bytes") - F.col("body")).alias("size"), F.lit(0).cast("bigint").alias("skip"), F.lit(None).cast("bigint").alias("take"))
    part = entry.join(known.select(F.col("id").alias("asked")), "asked", "left_anti").filter(F.col("low").isNotNull() | F.col("high").isNotNull()).join(known, "id")
    low = F.greatest(F.coalesce("low", F.lit(1)), F.lit(1))
    high = F.least(F.coalesce("high", F.col("letters")), F.col("letters"))
    part = part.withColumn("low", low).withColumn("high", high).withColumn("take", F.greatest(F.col("high") - F.col("low") + 1, F.lit(0)))
    even = F.col("line_letters") > 0
    at = lambda letter: F.expr(f"(({letter}) div line_letters) * line_bytes + ({letter}) % line_letters")
    start = F.when(even, at("low - 1")).otherwise(0)
    size = F.when(F.col("take") == 0, 0).when(even, at("high - 1") + 1 - at("low - 1")).otherwise(F.col("offset") + F.col("bytes") - F.col("body"))
    part = part.select("ord", "asked", "file_path", (F.col("body") + start).alias("start"), size.cast("bigint").alias("size"), F.when(even, 0).otherwise(F.col("low") - 1).cast("bigint").alias("skip"), "take")
    return whole.unionByName(part).withColumnRenamed("asked", "id")


class OpenFiles:
    """The files that a task reads last, open."""

    def __init__(self):
        self.open: dict = {}

    def read(self, path: str, start: int, size: int) -> bytes:
        f = self.open.pop(path, None)
        if f is None:
            system, inner = ranges.open_system(path)
            f = system.open_input_file(inner)
        self.open[path] = f
        if len(self.open) > OPEN_FILES:
            self.open.pop(next(iter(self.open))).close()
        f.seek(start)
        return f.read(size)


def read_places(places: DataFrame, bytes_read=None) -> DataFrame:
    """FETCHED of ``wanted`` places in order of ord; only their bytes are read, which the accumulator ``bytes_read`` counts.

    Places are put in order before anything is read, so that sequences never move.
    """
    places = materialize(places.select("ord", "id", "file_path", "start", "size", "skip", "take"), "places")
    n, size = places.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = OpenFiles()
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                text = files.read(row["file_path"], row["start"], row["size"])
                if bytes_read is not None:
                    bytes_read.add(len(text))
                if row["take"] is not None:  # letters as they are written
                    text = text.translate(None, b"\r\n")[row["skip"] : row["skip"] + row["take"]]
                out.append((row["ord"], row["id"], ranges.clean(text)))
                held += len(text)
                if held >= datasource.BATCH_BYTES or len(out) >= datasource.BATCH_RECORDS:
                    yield _fetched(out)
                    out, held = [], 0
        if out:
            yield _fetched(out)

    parts = max(1, math.ceil(n / TASK_PLACES), math.ceil(size / TASK_BYTES))
    return places.repartitionByRange(parts, "ord").sortWithinPartitions("ord").mapInArrow(run, FETCHED)


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["ord", "id", "sequence"])


def fetch(index: DataFrame, ids: DataFrame, place: str = "ord", bytes_read=None) -> DataFrame:
    """ord, id and cleaned sequence of a list of ids and regions, in the list's order, one for each entry that is found.

    Letters of regions count as they are written, stops and blanks too, before they are cleaned. Null ids and ids of
    no record are left out; a region beyond a record's end is cut there, one behind it is empty.
    """
    return read_places(wanted(index, ids.dropna(subset="id"), place), bytes_read)

