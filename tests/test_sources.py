import gzip

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import residua
from residua import cli, sinks
from residua.functions import sequences as fn
from residua.operators import embedding
from residua.sources import fasta, hits
from residua.streaming.fasta import score_stream, stream_fasta


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.fasta").write_text(">s1 first one\nMKJ*\nLLj\n>s2\n\n>s1 again\r\nAC D\r\n")
    (tmp_path / "sub" / "B.FAA").write_text("junk\n>t1 x\nACDEFG\n")
    (tmp_path / "c.pep.gz").write_bytes(gzip.compress(b">g1\nWWW\n"))
    (tmp_path / "d.fas").write_text(">no\nA\n")
    (tmp_path / "e.Fasta").write_text(">no\nA\n")
    return str(tmp_path)


def test_fasta(spark, folder):
    rows = {(r.file_path.rsplit("/", 1)[1], r.record_no): (r.id, r.description, r.sequence) for r in fasta.read_fasta(spark, folder).collect()}
    assert rows == {
        ("a.fasta", 1): ("s1", "first one", "MKLLLL"),
        ("a.fasta", 2): ("s2", "", ""),
        ("a.fasta", 3): ("s1", "again", "ACD"),
        ("B.FAA", 1): ("t1", "x", "ACDEFG"),
        ("c.pep.gz", 1): ("g1", "", "WWW"),
    }
    assert fasta.read_fasta(spark, folder, upper=False).count() == 4
    assert fasta.read_fasta(spark, f"{folder}/d.fas").count() == 1
    ids = [(r.ord, r.id) for r in fasta.read_headers(spark, folder, "a.fasta").orderBy("ord").collect()]
    assert ids == [(1, "s1"), (2, "s2")]


def test_one_file_in_many_splits(spark, tmp_path):
    """Records and ids are numbered by file, whatever tasks read it; texts are never shuffled."""
    want = [(f"r{k % 700}", "A" * (k % 90)) for k in range(2000)]
    (tmp_path / "big.fasta").write_text("junk\nmore\n" + "".join(f">{i} about {i}\n{s[:60]}\n{s[60:]}\n" for i, s in want))
    (tmp_path / "small.fasta").write_text(">a\nC\n")
    small = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = fasta.read_fasta(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        rows = sorted((r.record_no, r.id, r.sequence) for r in df.filter("file_path like '%big.fasta'").collect())
        ids = [(r.ord, r.id) for r in fasta.read_headers(spark, str(tmp_path), "big.fasta").orderBy("ord").collect()]
        for limit in (fasta.BROADCAST_BLOCKS, 0):
            fasta.BROADCAST_BLOCKS, kept = limit, fasta.BROADCAST_BLOCKS
            assert fasta.read_fasta(spark, str(tmp_path)).count() == 2001
            fasta.BROADCAST_BLOCKS = kept
        assert fasta.block_bound(spark.read.text(str(tmp_path))) >= df.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == [(k + 1, i, s) for k, (i, s) in enumerate(want)]
    assert ids == [(k + 1, f"r{k}") for k in range(700)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "value" in x]


def test_fetch_keeps_the_lists_order(spark):
    records = spark.createDataFrame([("a", "AA"), ("b", "BB"), ("c", "CC")], "id string, sequence string")
    ids = spark.createDataFrame([("c", 1), ("a", 2), ("none", 3), ("c", 4)], "id string, ord int")
    assert [(r.ord, r.sequence) for r in fasta.fetch(records, ids).collect()] == [(1, "CC"), (2, "AA"), (4, "CC")]


def test_composition(spark):
    df = spark.createDataFrame([("AXBJ",), ("",), ("acd",), (None,)], "s string")
    rows = fn.with_composition(df, "s").collect()
    assert rows[0].aa_A == 0.25 and rows[0].len_k == 0.004 and rows[0].aa_L == 0
    assert set(rows[1][1:]) == {0.0}
    assert abs(rows[2].aa_C - 1 / 3) < 1e-12
    assert set(rows[3][1:-1]) == {0.0} and rows[3].len_k is None
    counts = fn.with_residue_counts(df, "s").first()
    assert (counts.n_A, counts.n_C, counts.s) == (1, 0, "AXBJ")


def test_work_is_done_once(spark):
    """A filter above doesn't split lines or count residues again."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.range(10).selectExpr("cast(id as string) as value")
    text = plan(hits.within_evalue(hits.above_identity(hits.parse_hits(lines)), 1.0))
    assert text.count("split(") == 1 and text.count("RLIKE") == 2
    text = plan(fn.with_composition(lines, "value").filter("aa_A + aa_C > 0.1"))
    assert text.count("upper(") == 1 and text.startswith("Filter")  # above what generates the shares


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=50, max_size=300))
def test_format_probability(spark, values):
    values = [*values, 0.03125, 0.00005, 0.00015, 0.99995, 0.000149999999999, 1.0, 0.0, float("nan"), 12.34565, *[k / 4096 for k in range(0, 4096, 37)], *[(2 * k + 1) / 20000 for k in range(0, 10000, 61)]]
    rows = spark.createDataFrame([(v,) for v in values], "p double").select("p", fn.format_probability(F.col("p")).alias("t")).collect()
    assert all(r.t == f"{r.p:.4f}" for r in rows), [(r.p, r.t) for r in rows if r.t != f"{r.p:.4f}"][:5]


def test_hits(spark):
    line = lambda p: "\t".join(["q", "s", p, *"4567890", "1e-5"])
    df = spark.createDataFrame([(line(p),) for p in ("90.0", "90.01", "nan", "abc", "91d", "1_00", "inf")] + [("a\tb",), ("  ",), ("#",)], "value string")
    kept = [r.pident_raw for r in hits.above_identity(hits.parse_hits(df)).collect()]
    assert sorted(kept) == ["1_00", "90.01", "inf"]
    ids = spark.createDataFrame([("x\ty",), ("#c\td",), ("z",), ("",), ("k\ty",)], "value string")
    assert [r.id for r in hits.parse_ids(ids).collect()] == ["y"]


def test_bad_sequence_loses_only_itself(spark):
    class Fussy(embedding.TestEmbedder):
        def embed(self, sequences):
            if any("!" in s for s in sequences):
                raise ValueError
            return super().embed(sequences)

    df = spark.createDataFrame([(k, "AC!" if k == 3 else "ACD") for k in range(8)], "k int, s string").coalesce(1)
    out = embedding.embed(df, "s", Fussy, "fussy").filter("embedding is not null")
    assert [r.k for r in out.collect()] == [0, 1, 2, 4, 5, 6, 7]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_train_predict_and_evaluate(spark, tmp_path, capsys):
    for side, residues in (("pos", "STST"), ("neg", "GAVL")):
        (tmp_path / side).mkdir()
        for k in range(2):
            (tmp_path / side / f"x{k}.fasta").write_text("".join(f">{side}{k}_{j}\n{residues * (3 + j % 5)}\n" for j in range(10)))
    p = {k: str(tmp_path / k) for k in ("pos", "neg", "model", "out")}
    t = cli.run_train(spark, p["pos"], p["neg"], p["model"], 0.2, embedding.TestEmbedder)
    assert t.test_accuracy == 1 and t.cv_mean > 0.9
    cli.run_predict(spark, p["pos"], p["model"], p["out"], False, embedding.TestEmbedder, silent=False)
    rows = [(r.id, r.prediction) for r in spark.read.option("header", True).csv(p["out"]).collect()]
    assert rows == [(f"pos{k}_{j}", "Adhesion") for k in range(2) for j in range(10)]  # in order of file and record
    text = (tmp_path / "out").read_text().splitlines()  # one file, with one header
    assert text[0] == "id,prediction,probability_adhesion" and [x.split(",")[0] for x in text[1:]] == [r[0] for r in rows]
    assert [f.name for f in tmp_path.iterdir() if "out" in f.name and not f.name.endswith(".crc")] == ["out"]
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 20 and said[0].startswith("pos0_0: Adhesion (p=0.")
    m = cli.run_evaluate(spark, p["pos"], p["neg"], p["model"], embedding.TestEmbedder)["confusion"].first()
    assert tuple(m) == (20, 0, 0, 20)


def test_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "empty").mkdir()
    (tmp_path / "a.fasta").write_text(">a\nACD\n")
    t = str(tmp_path)
    assert cli.main(["predict", "--input", f"{t}/a.fasta", "--embedder", "test"]) == 1  # no model
    assert "train one first" in capsys.readouterr().err
    for size in ("0", "1", "-0.5", "2", "nan"):
        assert cli.main(["train", "--positive", f"{t}/a.fasta", "--negative", f"{t}/a.fasta", "--output", f"{t}/m", "--embedder", "test", "--test-size", size]) == 2
        assert "between 0 and 1" in capsys.readouterr().err
    assert cli.main(["train", "--positive", f"{t}/a.fasta", "--negative", f"{t}/a.fasta", "--output", f"{t}/m", "--embedder", "test"]) == 1
    assert "at least 5 rows of each" in capsys.readouterr().err
    assert cli.main(["train", "--positive", f"{t}/a.fasta", "--negative", f"{t}/a.fasta", "--output", f"{t}/m"]) == 1  # the default embedder isn't here
    assert "needs torch and esm on every worker; choose another with --embedder" in capsys.readouterr().err
    assert cli.main(["train", "--positive", f"{t}/empty", "--negative", f"{t}/none", "--output", f"{t}/m", "--embedder", "test"]) == 1
    assert cli.main(["train", "--positive", f"{t}/a.fasta", "--negative", f"{t}/none", "--output", f"{t}/m", "--embedder", "nocolon"]) == 1
    assert cli.main(["sample-ids", "--input-dir", t, "--output-dir", f"{t}/o", "--num-ids", "0"]) == 2
    assert cli.main(["sample-ids", "--input-dir", f"{t}/empty", "--output-dir", f"{t}/o"]) == 1
    assert cli.main(["sample-ids", "--input-dir", t, "--output-dir", f"{t}/o"]) == 0
    assert "1 ids after filtering" in capsys.readouterr().err
    good = "\t".join(["q", "s", "95", *"4567890", "1e-5"])
    (tmp_path / "h1").write_text(f"{good}x\nshort\n\n")
    (tmp_path / "h2").write_text(good.replace("95", "bad") + f"\n{good}\n")
    assert cli.main(["filter-hits", f"{t}/h2", f"{t}/missing", f"{t}/h1", "--output", f"{t}/hits"]) == 1
    assert [r.value for r in spark.read.text(f"{t}/hits").collect()] == ["q\ts\t95\t1e-5", "q\ts\t95\t1e-5x"]
    err = capsys.readouterr().err
    assert "missing not found" in err and "1 lines skipped: fewer than 11" in err and "1 lines skipped: no number" in err
    assert cli.parser().parse_args(["train"]).model_name == embedding.DEFAULT_MODEL
    with pytest.raises(RuntimeError, match="torch"):
        embedding.factory("esm")()
    assert isinstance(embedding.factory("residua.operators.embedding:TestEmbedder")(), embedding.TestEmbedder)
    assert residua.train_classifier and residua.read_fasta is fasta.read_fasta


def test_one_file_or_none(spark, tmp_path):
    """Parts in order behind one header; an older file stays where a run fails, and nothing else does."""
    out = tmp_path / "p.csv"
    df = spark.range(1000).select(F.concat(F.lit('i,"'), "id").alias("id"), F.lit("Adhesion").alias("prediction"), (F.col("id") / 1000).alias("probability_adhesion"))
    sinks.write_predictions(df.repartition(7).orderBy("probability_adhesion"), str(out), one_file=True)
    lines = out.read_text().splitlines()
    assert lines[0] == "id,prediction,probability_adhesion" and [float(x.rsplit(",", 1)[1]) for x in lines[1:]] == [k / 1000 for k in range(1000)]
    assert spark.read.option("header", True).csv(str(out)).count() == 1000
    sinks.write_predictions(df.limit(0), str(out), one_file=True)
    assert out.read_text() == "id,prediction,probability_adhesion\n"
    bad = df.withColumn("probability_adhesion", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_predictions(bad, str(out), one_file=True)
    assert out.read_text() == "id,prediction,probability_adhesion\n" and [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["p.csv"]


def records_read(sc, stage: int) -> int:
    """By all attempts of a stage; 0 for one that was skipped."""
    attempts = sc._jsc.sc().statusStore().stageData(stage, False, sc._jvm.java.util.ArrayList(), False, sc._gateway.new_array(sc._jvm.double, 0))
    return sum(attempts.apply(k).inputRecords() for k in range(attempts.size()))


def test_hits_are_scanned_once(spark, tmp_path, capsys):
    """The warnings' counts come with the rows, not from a scan of their own."""
    good = "\t".join(["q", "s", "95", *"4567890", "1e-5"])
    (tmp_path / "h").write_text(f"{good}\nshort\n" * 50)
    sc = spark.sparkContext
    sc.setJobGroup("hits", "hits")
    assert cli.run_filter_hits(spark, [str(tmp_path / "h")], str(tmp_path / "o"), 90.0) == 0
    read = [records_read(sc, s) for j in sc.statusTracker().getJobIdsForGroup("hits") for s in sc.statusTracker().getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [n for n in read if n > 50] == [100]
    assert "50 lines skipped" in capsys.readouterr().err


def test_search_filter_and_fetch(spark, tmp_path, capsys):
    """The chain of commands: hits of a query, those above an identity, and the records that they name."""
    t = str(tmp_path)
    seq = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVV"
    (tmp_path / "q.fa").write_text(f">q one\n{seq}\n")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.fasta").write_text(f">same\nWWWW{seq[:60]}\n{seq[60:]}WW\n>other\n{'GPGPNDNDWYWY' * 9}\n>near\n{seq[:30]}{seq[30:].replace('Q', 'W').replace('L', 'I')}\n>same\nAAAA\n")
    assert cli.main(["search", "--query", f"{t}/q.fa", "--subjects", f"{t}/s", "--output", f"{t}/h.tab", "--evalue", "1e-10"]) == 0
    lines = [x.split("\t") for x in (tmp_path / "h.tab").read_text().splitlines()]
    assert [x[:3] for x in lines] == [["q", "same", "100.00"], ["q", "near", lines[1][2]]] and 75 < float(lines[1][2]) <= 90 and len(lines[0]) == 12
    assert lines[0][6:10] == ["1", "70", "5", "74"]
    assert cli.main(["filter-hits", f"{t}/h.tab", "--output", f"{t}/kept"]) == 0
    (tmp_path / "ids").write_text("".join(f"{r.value.split(chr(9))[1]}\n" for r in spark.read.text(f"{t}/kept").collect()) + "near:2-6\n")
    for _ in range(2):  # the second time with the index that is there
        assert cli.main(["fetch", "--input", f"{t}/s", "--ids", f"{t}/ids", "--index", f"{t}/index", "--output", f"{t}/o.fa"]) == 0
        assert (tmp_path / "o.fa").read_text() == f">same\nWWWW{seq}WW\n>near:2-6\n{seq[1:6]}\n"
    (tmp_path / "ids").write_text("nobody\n\nnear:1-2\n")
    assert cli.main(["fetch", "--input", f"{t}/s", "--ids", f"{t}/ids", "--index", f"{t}/index", "--output", f"{t}/o.fa"]) == 1
    assert "1 ids are in no record, among them nobody" in capsys.readouterr().err and (tmp_path / "o.fa").read_text() == f">near:1-2\n{seq[:2]}\n"
    assert cli.main(["search", "--query", f"{t}/q.fa", "--subjects", f"{t}/s", "--output", f"{t}/h", "--evalue", "-1"]) == 2


def test_sample_ids(spark, tmp_path):
    (tmp_path / "o.fasta").write_text(">a\nA\n>b\nA\n>c\nA\n")
    (tmp_path / "o.tab").write_text("q\tb\n")
    cli.run_sample_ids(spark, str(tmp_path), str(tmp_path / "out"), "*.tab", "*.fasta", 2, 5, 42)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "c"]
    assert sinks.prediction_name("/x/y.fasta.gz", False) == "y.fasta_predictions.csv"


def test_stream(spark, folder, tmp_path):
    out, marks = str(tmp_path / "stream"), str(tmp_path / "marks")
    score_stream(stream_fasta(spark, folder), lambda df: df.select("id", "sequence"), out, marks).awaitTermination(60)
    assert {r.id for r in spark.read.parquet(out).collect()} >= {"s1", "s2", "g1"}
