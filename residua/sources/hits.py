"""Tab-separated alignment hits and id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.sources.fasta import place

HIT_FIELDS = 11
#: What counts as blank at the ends of lines and numbers: all white space, not that of ASCII alone.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: What a number may look like: no type suffixes, which a cast would take.
NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$|^[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def number(text: Column) -> Column:
    """A double, or null where the text is no number."""
    t = strip(text)
    return F.when(t.rlike(NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def judge_hits(lines: DataFrame) -> DataFrame:
    """query, subject, pident_raw, evalue_raw, pident, evalue and ``problem`` of each line in ``value``; other columns stay.

    ``problem`` is null, or tells what is wrong: blank, short (fewer than eleven fields), or identity
    (no number). A line is split and its numbers are read once: generated columns keep later filters above.
    """
    f = F.split(strip(F.col("value")), "\t", -1)
    pident, names = number(F.get("__fields", F.lit(2))), ("query", "subject", "pident_raw", "evalue_raw")
    fields = [F.get("__fields", F.lit(k)).alias(n) for n, k in zip(names, (0, 1, 2, 10), strict=True)]
    problem = F.when(F.get("__fields", F.lit(0)) == "", F.when(F.size("__fields") == 1, "blank")).when(F.size("__fields") < HIT_FIELDS, "short")
    whole = F.struct(*fields, pident.alias("pident"), number(F.get("__fields", F.lit(10))).alias("evalue"), problem.alias("__shape"))
    rows = lines.withColumn("__fields", f).select(*[c for c in lines.columns if c != "value"], F.inline(F.array(whole)))
    shape = F.coalesce("__shape", F.when(F.col("pident").isNull(), "identity"))
    return rows.withColumn("problem", shape).drop("__shape")


def parse_hits(lines: DataFrame) -> DataFrame:
    """The lines of ``judge_hits`` that have no problem."""
    return judge_hits(lines).filter(F.col("problem").isNull()).drop("problem")


def read_hit_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value, file_path, file_no (the place in ``paths``), block and n, which order a file's lines."""
    each = [spark.read.text(p).select("value", F.lit(k).alias("file_no"), *place()) for k, p in enumerate(paths)]
    return reduce(DataFrame.union, each)


def read_hits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_hits(read_hit_lines(spark, [paths] if isinstance(paths, str) else paths)).drop("file_no", "block", "n")


def above_identity(hits: DataFrame, percent: float = 90.0) -> DataFrame:
    """Strictly above; not-a-number never passes."""
    return hits.filter((F.col("pident") > percent) & ~F.isnan("pident"))


def within_evalue(hits: DataFrame, most: float) -> DataFrame:
    return hits.filter((F.col("evalue") <= most) & ~F.isnan("evalue"))


def hit_line() -> Column:
    """The four output fields as they were read."""
    return F.concat_ws("\t", "query", "subject", "pident_raw", "evalue_raw")


def parse_ids(lines: DataFrame, column: int = 2) -> DataFrame:
    """Distinct ids of a column (from 1) of lines in ``value``; blank lines, comments and short lines go."""
    if column < 1:
        raise ValueError("columns count from 1")
    fields = F.split(strip(F.col("value")), "\t", -1)
    # generated, so that the filters don't split a line again
    rows = lines.select(fields.alias("__fields")).select(F.explode(F.array("__fields")).alias("f"))
    kept = rows.filter((F.size("f") >= column) & ~F.col("f")[0].startswith("#") & ((F.size("f") > 1) | (F.col("f")[0] != "")))
    return kept.select(F.element_at("f", column).alias("id")).distinct()


def read_ids(spark: SparkSession, path: str, glob: str = "*.tab", column: int = 2) -> DataFrame:
    return parse_ids(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path), column)
