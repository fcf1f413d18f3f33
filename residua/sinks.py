"""Writers of predictions, id lists, hits and FASTA subsets."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.sequences import format_probability
from residua.scratch import hadoop_path
from residua.sources.fasta import format_record
from residua.sources.hits import hit_line


def write_predictions(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, probability to four decimals, in the order of ``df``: a folder of parts, or ``one_file``."""
    rows = df.select("id", "prediction", format_probability(F.col("probability_adhesion")).alias("probability_adhesion"))
    if not one_file:
        rows.write.mode("overwrite").option("header", True).csv(path)
        return
    parts = f"{path.rstrip('/')}.{uuid.uuid4().hex}.parts"
    try:
        rows.write.option("header", False).csv(parts)
        join_parts(df.sparkSession, parts, ",".join(rows.columns) + "\n", path)
    finally:
        p, files = hadoop_path(df.sparkSession, parts)
        files.delete(p, True)


def write_lines(df: DataFrame, path: str) -> None:
    """One text file of the lines in ``value``, in the order of ``df``."""
    parts = f"{path.rstrip('/')}.{uuid.uuid4().hex}.parts"
    try:
        df.select("value").write.text(parts)
        join_parts(df.sparkSession, parts, "", path)
    finally:
        p, files = hadoop_path(df.sparkSession, parts)
        files.delete(p, True)


def join_parts(spark: SparkSession, folder: str, opening: str, path: str) -> None:
    """Makes one file of ``opening`` and the parts in ``folder``, in their order, and puts it in the place of ``path`` when it is whole.

    The file system joins them where it can, without moving a byte. Where it can't they are copied one behind the
    other, a buffer at a time.
    """
    where, files = hadoop_path(spark, folder)
    joined = hadoop_path(spark, f"{folder}/joined")[0]
    found = sorted((s.getPath() for s in files.listStatus(where) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    jvm = spark.sparkContext._jvm
    out = files.create(joined, True)
    out.write(bytearray(opening.encode("utf-8")))
    try:
        if found and _joins(files, joined):
            out.close()
            array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(found))
            for k, p in enumerate(found):
                array[k] = p
            files.concat(joined, array)
        else:
            for p in found:
                source = files.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 22, False)
                source.close()
    finally:
        out.close()
    target = hadoop_path(spark, path)[0]
    files.delete(target, True)
    if not files.rename(joined, target):
        raise OSError(f"{path} could not be written")


def _joins(files, path) -> bool:
    try:
        return bool(files.hasPathCapability(path, "fs.capability.paths.concat"))
    except PySparkException:
        return False


def prediction_name(path: str, is_folder: bool) -> str:
    """Name of a prediction output: of the folder, or of the file without its last suffix."""
    name = os.path.basename(path.rstrip("/"))
    return f"{name if is_folder else os.path.splitext(name)[0]}_predictions.csv"


def write_sampled_ids(df: DataFrame, folder: str, source: str = "source_file", key: str = "id") -> None:
    """A folder of text files for each source."""
    df.select(F.col(source).alias("source_file"), F.col(key).cast("string").alias("value")).write.mode("overwrite").partitionBy("source_file").text(folder)


def write_hits(df: DataFrame, folder: str) -> None:
    df.select(hit_line().alias("value")).write.mode("overwrite").text(folder)


def write_fasta(df: DataFrame, folder: str, suffix: str = ".fasta") -> None:
    """Records of id, description and sequence in files that end in ``suffix``, in gzip where that does."""
    rows = df.select(format_record(F.col("id"), F.nullif(F.col("description"), F.lit("")), F.col("sequence")).alias("value"))
    packed = suffix.lower().endswith(".gz")
    rows.write.mode("overwrite").option("compression", "gzip" if packed else "none").text(folder)
    # Spark names text files itself; the readers look for suffixes of sequences
    p, files = hadoop_path(df.sparkSession, folder)
    for status in files.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), hadoop_path(df.sparkSession, f"{folder}/{name.split('.txt')[0]}{suffix}")[0])
