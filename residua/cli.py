"""Commands: predict, train, evaluate, search, filter-hits, fetch and sample-ids.

Results go to standard output, warnings and errors to standard error. A command ends with 0, with 1 where
its input or output fails it, and with 2 where an argument is out of range.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from residua import sinks
from residua.operators import embedding, metrics, model, sampling, similarity
from residua.operators.ranks import row_numbers
from residua.scratch import materialize
from residua.session import session, ship_package
from residua.sources import fasta, fasta_index, hits

Make = Callable[[], embedding.Embedder]
POSITIVE_DIR, NEGATIVE_DIR, MODELS_DIR = "data/positive", "data/negative", "models"


class CommandError(Exception):
    """Ends a command with a message and an exit code."""

    def __init__(self, message: str, code: int = 1):
        super().__init__(message)
        self.code = code


def warn(message: str) -> None:
    print(f"Warning: {message}", file=sys.stderr)


def default_model(name: str) -> str:
    return os.path.join(os.getcwd(), MODELS_DIR, f"classifier_{name}")


def embedded(df: DataFrame, make: Make, name: str) -> DataFrame:
    """Rows with ``key``, ``embedding`` and the same as double features; null where a sequence could not be embedded."""
    rows = embedding.embed(df, "sequence", make, name)
    return rows.withColumn("features", F.col("embedding").cast("array<double>")).withColumn("key", F.concat_ws(":", "file_path", "record_no"))


def with_features(rows: DataFrame) -> DataFrame:
    """The rows that have features, written once so that no lost executor costs their inference again; says how many have none, and fails where all do."""
    rows = materialize(rows, "embedded")
    n, failed = rows.agg(F.count("*"), F.count_if(F.col("features").isNull())).first()
    if not n:
        raise CommandError("no sequences found in the input")
    if failed:
        warn(f"{failed} of {n} sequences could not be embedded and are left out")
    if failed == n:
        raise CommandError("no embeddings extracted")
    return rows.filter(F.col("features").isNotNull())


def sequences(spark: SparkSession, path: str, **reading) -> DataFrame:
    """The records of a file or a folder; no such path, or no file with a sequence suffix there, is an error."""
    if not fasta.exists(spark, path):
        raise CommandError(f"{path} is neither a file nor a folder")
    rows = fasta.read_fasta(spark, path, **reading)
    if not rows.inputFiles():
        raise CommandError(f"no FASTA files found in {path}")
    return rows


def stored_model(spark: SparkSession, path: str):
    if not fasta.exists(spark, path):
        raise CommandError(f"no model at {path}: train one first")
    return model.load(path)


def run_predict(spark: SparkSession, path: str, model_path: str, out: str | None, show_all: bool, make: Make, name: str = embedding.DEFAULT_MODEL, silent: bool = True) -> str:
    """Writes the predictions in order of file and record, prints them unless ``silent``; where they are."""
    stored = stored_model(spark, model_path)
    rows = sequences(spark, path)
    scored = model.score(stored, with_features(embedded(rows, make, name)))
    if not show_all:
        scored = scored.filter(F.col("prediction") == 1)
    scored = scored.select("file_path", "record_no", "id", F.col("class_name").alias("prediction"), F.col("probability").alias("probability_adhesion"))
    out = out or sinks.prediction_name(path, not fasta.is_file(spark, path))
    ordered = scored.orderBy("file_path", "record_no")
    sinks.write_predictions(ordered, out, one_file=True)
    if not silent:
        for r in ordered.toLocalIterator():  # a part at a time
            print(f"{r.id}: {r.prediction} (p={r.probability_adhesion:.3f})")
    return out


def labelled(spark: SparkSession, positive: str, negative: str, require_both: bool) -> DataFrame:
    sides = [sequences(spark, p, upper=False, on_error="fail") for p in (positive, negative)]
    if require_both:
        for rows, path in zip(sides, (positive, negative), strict=True):
            if rows.isEmpty():
                raise CommandError(f"no sequences found in {path}")
    return fasta.labelled_union(*sides, require_both=False)


def run_train(spark: SparkSession, positive: str, negative: str, out: str, test_size: float, make: Make, name: str = embedding.DEFAULT_MODEL) -> model.Training:
    if not 0 < test_size < 1:
        raise CommandError("the test size must lie between 0 and 1", 2)
    rows = with_features(embedded(labelled(spark, positive, negative, True), make, name).select("key", "features", "label"))
    done = model.train(rows, "key", test_size=test_size)
    model.save(done.model, out)
    return done


def run_evaluate(spark: SparkSession, positive: str, negative: str, model_path: str, make: Make, name: str = embedding.DEFAULT_MODEL) -> dict[str, DataFrame]:
    stored = stored_model(spark, model_path)
    rows = with_features(embedded(labelled(spark, positive, negative, False), make, name).select("key", "features", "label"))
    rows = model.score(stored, rows).select("label", "prediction", "probability").persist()
    return {"confusion": metrics.confusion_matrix(rows), "report": metrics.class_report(rows), "auc": metrics.roc_auc(rows, score="probability"), "accuracy": metrics.accuracy(rows)}


def run_filter_hits(spark: SparkSession, paths: list[str], out: str, percent: float) -> int:
    """Filters the files that are there, in their order, and warns of lines that it skips; 1 where a file is missing."""
    there = [p for p in paths if fasta.exists(spark, p)]
    for p in paths:
        if p not in there:
            print(f"Error: {p} not found", file=sys.stderr)
    if there:
        said = Observation("skipped")  # counted as the lines pass, in the one scan of the files
        odd = {(k, p): f"{p}_{k}" for k in range(len(there)) for p in ("short", "identity")}
        judged = hits.judge_hits(hits.read_hit_lines(spark, there))
        judged = judged.observe(said, *(F.count_if((F.col("file_no") == k) & (F.col("problem") == p)).alias(name) for (k, p), name in odd.items()))
        kept = materialize(hits.above_identity(judged.filter("problem is null"), percent), "kept")
        for (k, p), name in odd.items():
            if n := said.get[name]:
                warn(f"{there[k]}: {n} lines skipped: {'fewer than 11 columns' if p == 'short' else 'no number for identity'}")
        sinks.write_hits(kept.orderBy("file_no", "file_path", "block", "n"), out)
    return int(len(there) < len(paths))


def by_id(rows: DataFrame) -> DataFrame:
    """id and sequence, of records that share an id the first by file and number."""
    first = F.min(F.struct("file_path", "record_no", "sequence")).alias("first")
    return rows.filter("id <> ''").groupBy("id").agg(first).select("id", "first.sequence")


def run_search(spark: SparkSession, query: str, subjects: str, out: str, evalue: float, min_score: int) -> None:
    """Writes one hit table of all queries' alignments with all subjects, by query and e-value."""
    if evalue < 0 or min_score < 1:
        raise CommandError("the e-value must not be negative, and the score must be 1 or more", 2)
    sides = [materialize(by_id(sequences(spark, p)), "sequences") for p in (query, subjects)]
    found = similarity.similar(*sides, similarity.Search(min_score=min_score)).filter(F.col("evalue") <= evalue)
    sinks.write_lines(similarity.as_hit_lines(found.orderBy("query", "evalue", "subject")), out)


def run_fetch(spark: SparkSession, path: str, ids: str, out: str, index: str) -> int:
    """Writes the records and regions that a list names, in its order, as one file; makes the index where there is none. 1 where some aren't found."""
    if not fasta.exists(spark, index):
        fasta_index.save(fasta_index.build(spark, path), index)
    lines = spark.read.text(ids).select("value", *fasta.place()).filter(F.trim("value") != "")
    asked = row_numbers(lines.select(F.trim("value").alias("id"), "n"), [], "n", [], "ord").select("ord", "id")
    asked = materialize(asked, "asked")
    found = materialize(fasta_index.fetch(spark.read.parquet(index), asked), "found")
    sinks.write_lines(found.orderBy("ord").select(fasta.format_record(F.col("id"), F.lit(None).cast("string"), F.col("sequence")).alias("value")), out)
    missing = asked.join(found.select("ord"), "ord", "left_anti").select("id").distinct()
    if n := missing.count():
        warn(f"{n} ids are in no record, among them {', '.join(r.id for r in missing.orderBy('id').limit(5).collect())}")
    return int(n > 0)


def run_sample_ids(spark: SparkSession, folder: str, out: str, tab_glob: str, fasta_glob: str, column: int, n: int, seed: int) -> None:
    if column < 1 or n < 1:
        raise CommandError("the column and the number of ids must be 1 or more", 2)
    lists = spark.read.option("recursiveFileLookup", True)
    files = lists.option("pathGlobFilter", fasta_glob).text(folder).inputFiles() if fasta.exists(spark, folder) else []
    if not files:
        raise CommandError("no FASTA files found")
    left = fasta.read_headers(spark, folder, fasta_glob)
    if lists.option("pathGlobFilter", tab_glob).text(folder).inputFiles():
        left = sampling.anti_join_ids(left, hits.read_ids(spark, folder, tab_glob, column))
    chosen = sampling.sample_per_source(left, "file_path", "id", n, seed)
    sinks.write_sampled_ids(chosen.withColumn("source_file", F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.fasta$", "")), out)
    plain = lambda f: re.sub("^file:/+", "/", f)
    found = {plain(r.file_path): r["count"] for r in chosen.groupBy("file_path").count().collect()}  # a row for each file
    for f in sorted(map(plain, files)):
        if found.get(f, 0) < n:
            warn(f"{f} has {found.get(f, 0)} ids after filtering: all are taken")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="residua")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, model_flag: str = "") -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if model_flag:
            c.add_argument(model_flag, dest="model_name", default=embedding.DEFAULT_MODEL, choices=list(embedding.MODELS), help="language model; prediction and evaluation must take the one of training")
            c.add_argument("--embedder", default="esm", help="esm (the language model), test (a stand-in without meaning) or module:callable")
        return c

    def sides(c: argparse.ArgumentParser) -> None:
        c.add_argument("--positive", default=POSITIVE_DIR)
        c.add_argument("--negative", default=NEGATIVE_DIR)

    c = command("predict", "--model-name")
    c.add_argument("--input", required=True, help="FASTA file, or folder of such files")
    c.add_argument("--model", help="trained model; by default named by --model-name")
    c.add_argument("--output")
    c.add_argument("--silent", action="store_true", help="print no predictions")
    c.add_argument("--show-all", action="store_true", help="negative predictions too")
    c.add_argument("--max-workers", type=int, help="cores, where the session is not a cluster's")
    c = command("train", "--model")
    sides(c)
    c.add_argument("--output")
    c.add_argument("--test-size", type=float, default=0.2)
    c = command("evaluate", "--model-name")
    sides(c)
    c.add_argument("--model")
    c = command("filter-hits")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--percent-id", type=float, default=90.0)
    c = command("search")
    c.add_argument("--query", required=True)
    c.add_argument("--subjects", required=True, help="FASTA file or folder")
    c.add_argument("--output", required=True)
    c.add_argument("--evalue", type=float, default=1e-5)
    c.add_argument("--min-score", type=int, default=similarity.Search().min_score)
    c = command("fetch")
    c.add_argument("--input", required=True, help="plain FASTA file or folder")
    c.add_argument("--ids", required=True, help="file with an id or a region (id:from-to) in each line")
    c.add_argument("--index", required=True, help="folder of the index; made where it isn't there")
    c.add_argument("--output", required=True)
    c = command("sample-ids")
    c.add_argument("--input-dir", default=".")
    c.add_argument("--output-dir", required=True)
    for flag, default in (("--tab-pattern", "*.tab"), ("--fasta-pattern", "*.fasta")):
        c.add_argument(flag, default=default)
    for flag, number in (("--tab-column", 2), ("--num-ids", 500), ("--seed", 42)):
        c.add_argument(flag, type=int, default=number)
    return p


def run(a: argparse.Namespace) -> int:
    workers = getattr(a, "max_workers", None)
    spark = session(f"local[{workers}]" if workers else None)
    ship_package(spark)
    if a.command == "filter-hits":
        return run_filter_hits(spark, a.inputs, a.output, a.percent_id)
    if a.command == "search":
        run_search(spark, a.query, a.subjects, a.output, a.evalue, a.min_score)
        return 0
    if a.command == "fetch":
        return run_fetch(spark, a.input, a.ids, a.output, a.index)
    if a.command == "sample-ids":
        run_sample_ids(spark, a.input_dir, a.output_dir, a.tab_pattern, a.fasta_pattern, a.tab_column, a.num_ids, a.seed)
        return 0
    make = embedding.factory(a.embedder, a.model_name)
    worker_name = f"{a.embedder} {a.model_name}"  # under which a worker keeps it
    if a.command == "predict":
        out = run_predict(spark, a.input, a.model or default_model(a.model_name), a.output, a.show_all, make, worker_name, a.silent)
        print(f"Predictions: {out}")
    elif a.command == "train":
        out = a.output or default_model(a.model_name)
        t = run_train(spark, a.positive, a.negative, out, a.test_size, make, worker_name)
        print(f"train {t.train_accuracy:.4f} test {t.test_accuracy:.4f} cv {t.cv_mean:.4f} +/- {t.cv_two_std:.4f}\nModel: {out}")
    else:
        for name, df in run_evaluate(spark, a.positive, a.negative, a.model or default_model(a.model_name), make, worker_name).items():
            print(name)
            df.show(truncate=False)
    return 0


def cause(error: Exception) -> str:
    """What went wrong in one line: of an error in a worker the one that was raised there, else the first line that says something."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    raised = [x for x in lines if re.match(r"[A-Za-z_][\w.]*(Error|Exception): \S", x) and not x.startswith(("org.", "java."))]
    return re.sub(r"^(\w+\.)*\w+: ", "", raised[0]) if raised else lines[0] if lines else type(error).__name__


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    except CommandError as e:
        print(f"Error: {e}", file=sys.stderr)
        return e.code
    except (PySparkException, ValueError) as e:
        print(f"Error: {cause(e)}", file=sys.stderr)
        return 1


def _one(name: str) -> Callable[[], int]:
    return lambda: main([name, *sys.argv[1:]])


predict, train, evaluate = _one("predict"), _one("train"), _one("evaluate")


if __name__ == "__main__":
    sys.exit(main())
