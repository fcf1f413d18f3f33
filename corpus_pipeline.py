"""From documents to packed training sequences: each stage is one operator of the training-data subpackage.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of the
documents table; the last one returns the packed pieces. Between stages the rows are written and read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import decontamination, line_windows, packing, simhash, toxicity
from residua.llm.common import materialize
from residua.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go.

    Null and empty texts stay. Null ids, repeated rows, long texts and columns of any name change nothing; an
    empty table gives no rows.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_severity(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows leave the texts; n_chars follows.

    All rows stay: null texts as they are (n_chars becomes null), texts that are cut entirely as empty ones.
    Rows without doc_id come before all others; repeated rows (one doc_id and text) are one document. Texts may
    be of any length. Columns of any name stay, those named n_lines and n_cut too. An empty table gives no rows.
    """
    cut = line_windows.cut_lines(docs)
    cut = cut.drop(*cut.columns[len(docs.columns) :])
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null and empty texts are one group. Of repeated rows one stays; a row without doc_id only where its group
    has no other. Texts may be of any length. Columns of any name stay; an empty table gives no rows.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts stay; null ids, repeated rows, long texts and columns of any name change nothing; an
    empty table gives no rows.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut and packed: a row for each piece, with its sequence and place.

    Null and empty texts are packed as an end id, repeated rows each for itself; a null doc_id stays null. Texts
    may be of any length. Other columns are left out; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Model fitting and tokenising have no SQL form: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
