"""FASTA files, plain or gzip, as DataFrames.

A record is read as one row by its separator; plain files are split among tasks however large they
are. The key of a record is its file and its number there, as ids need not be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions.sequences import clean_body
from residua.scratch import hadoop_path

# The suffixes of sequence files.
SUFFIXES = (".aa", ".faa", ".pep", ".fa", ".fasta", ".aa.gz", ".faa.gz", ".pep.gz", ".fa.gz", ".fasta.gz")


#: Blocks of a scan up to which their table of places is broadcast (some 200 bytes each); beyond it is joined by file and block.
BROADCAST_BLOCKS = 100_000


def place() -> list[Column]:
    """Where a line was read: its file, the start of the block there, and a number that grows within the block."""
    return [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")]


def suffix_glob(upper: bool = True) -> str:
    """A glob of all suffixes, as they are and, with ``upper``, in upper case."""
    names = [s.removeprefix(".") for s in SUFFIXES]
    return "*.{" + ",".join(dict.fromkeys([*names, *(n.upper() for n in names)] if upper else names)) + "}"


def record_id(record: Column) -> Column:
    return F.regexp_extract(record, r"^[ \t]*(\S*)", 1)


def record_description(record: Column) -> Column:
    return F.trim(F.regexp_extract(record, r"^[ \t]*\S*[ \t]*([^\r\n]*)", 1))


def record_sequence(record: Column) -> Column:
    return clean_body(F.regexp_replace(record, r"^[^\n]*\n?", ""))


def parse_records(records: DataFrame, column: str = "value") -> DataFrame:
    """Adds id, description and cleaned sequence of a record text without its leading mark."""
    r = F.col(column)
    return records.withColumns({"id": record_id(r), "description": record_description(r), "sequence": record_sequence(r)})


def read_records(spark: SparkSession, path: str | list[str], upper: bool = True, on_error: str = "skip", glob: str | None = None) -> DataFrame:
    """file_path, record_no, value: the records of all files below ``path``, or of one file of any name.

    ``on_error`` skip leaves out files that can't be decoded; fail stops at them. Text before a file's
    first record is dropped and has no number. Records are numbered within the block that a task reads;
    a table with a row for each block tells how many come before it, so that records never move.
    """
    reader = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", True).option("ignoreCorruptFiles", on_error == "skip")
    paths = [path] if isinstance(path, str) else path
    if glob or not all(is_file(spark, p) for p in paths):
        reader = reader.option("pathGlobFilter", glob or suffix_glob(upper))
    rows = reader.text(paths).select("value", *place())
    head = F.min(F.struct("n", F.col("value").startswith(">").alias("marked")))
    blocks = rows.groupBy("file_path", "block").agg(F.min("n").alias("first"), F.count("*").alias("rows"), head.alias("head"))
    in_file = Window.partitionBy("file_path").orderBy("block")  # a row for each block of a file
    before = F.coalesce(F.sum("rows").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.when(F.first("head.marked").over(in_file), 1).otherwise(0) + before - F.col("first")
    shifts = blocks.select("file_path", "block", "first", shift.alias("shift"))
    if block_bound(rows) <= BROADCAST_BLOCKS:
        shifts = F.broadcast(shifts)
    opening = (F.col("block") == 0) & (F.col("n") == F.col("first"))
    value = F.when(opening, F.substring("value", 2, 2_000_000_000)).otherwise(F.col("value"))
    numbered = rows.join(shifts, ["file_path", "block"]).select("file_path", (F.col("n") + F.col("shift")).alias("record_no"), value.alias("value"))
    return numbered.filter("record_no > 0")


def block_bound(rows: DataFrame) -> int:
    """No fewer than the blocks of a scan: all but a file's last one fill a task of their own."""
    return len(rows.inputFiles()) + rows.rdd.getNumPartitions()


def _status(spark: SparkSession, path: str):
    p, files = hadoop_path(spark, path)
    found = files.globStatus(p)
    return list(found) if found is not None else []


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_status(spark, path))


def is_file(spark: SparkSession, path: str) -> bool:
    return any(s.isFile() for s in _status(spark, path))


def read_fasta(spark: SparkSession, path: str | list[str], upper: bool = True, on_error: str = "skip", glob: str | None = None) -> DataFrame:
    """file_path, record_no, id, description, sequence. Training reads with upper=False, on_error="fail"."""
    return parse_records(read_records(spark, path, upper, on_error, glob)).drop("value")


def read_headers(spark: SparkSession, path: str | list[str], glob: str = "*.fasta") -> DataFrame:
    """file_path, ord, id: ids of each file in order, the first of equal ones; headers without id are left out."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text([path] if isinstance(path, str) else path)
    ids = lines.filter(F.col("value").startswith(">")).select(*place(), F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("id")).filter("id <> ''")
    first = ids.groupBy("file_path", "id").agg(F.min(F.struct("block", "n")).alias("at")).select("file_path", "at.block", "at.n", "id")
    # numbered within a block; counts of blocks tell what comes before
    blocks = first.groupBy("file_path", "block").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file_path", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("file_path", "block").orderBy("n"))
    return first.withColumn("k", inner).join(before, ["file_path", "block"]).select("file_path", (F.col("before") + F.col("k")).alias("ord"), "id")


def fetch(records: DataFrame, ids: DataFrame, key: str = "id", place: str = "ord") -> DataFrame:
    """The records of a list of ids in the order of ``place``, one for each entry: a repeated id gives its record again."""
    return ids.select(key, place).join(records.drop(place), key).orderBy(place)


def labelled_union(positive: DataFrame, negative: DataFrame, require_both: bool = True) -> DataFrame:
    """Positives with label 1 and negatives with label 0, all kept; training needs some of either."""
    if require_both and (positive.isEmpty() or negative.isEmpty()):
        raise ValueError("both a positive and a negative set are needed")
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))


def format_record(id_: Column, description: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), F.concat_ws(" ", id_, description), F.lit("\n"), sequence)
