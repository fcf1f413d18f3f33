import time

from pyspark.sql import functions as F

from residua.sources import fasta
from residua.streaming.fasta import first_seen_ids


def run(spark, source, out, marks, **options):
    rows = first_seen_ids(spark, source, splitBytes=300, **options)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(once=True).start().awaitTermination(120)
    return spark.read.schema("file_path string, id string, block bigint, n bigint").parquet(out)


def named(df, *order):
    """Ids of each file in order."""
    out: dict = {}
    for r in df.orderBy("file_path", *order).collect():
        out.setdefault(r.file_path.rsplit("/", 1)[1], []).append(r.id)
    return out


def test_batches_and_restarts_give_the_batch_answer(spark, tmp_path):
    """Two batches and a restart: each id once, with the places of the first headers, as one read of all gives them."""
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    (source / "a.fasta").write_text("".join(f">i{k % 30} about\nACD\n" for k in range(100)) + "> \nA\n")
    first = run(spark, str(source), out, marks)
    assert named(first, "block", "n") == {"a.fasta": [f"i{k}" for k in range(30)]}
    with open(source / "a.fasta", "a") as f:
        f.write(">i3\nA\n>new1\nA\n>new1 again\nA\n")
    (source / "b.fasta").write_text(">i3\nA\n>i4\nA\n>i3\nA\n")
    want = named(fasta.read_headers(spark, str(source)), "ord")
    for _ in range(2):  # the second time nothing is new
        got = run(spark, str(source), out, marks)
        assert got.groupBy("file_path", "id").count().filter(F.col("count") > 1).isEmpty()
    assert {f: sorted(v) for f, v in named(got, "block", "n").items()} == {f: sorted(v) for f, v in want.items()}
    assert named(got, "block", "n")["b.fasta"] == want["b.fasta"] and want["a.fasta"][-1] == "new1"


def test_state_expires(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    (source / "a.fasta").write_text(">x\nA\n>y\nA\n")
    day = 1 / 86_400  # a second
    assert run(spark, str(source), out, marks, kept_days=day).count() == 2
    time.sleep(2)
    with open(source / "a.fasta", "a") as f:
        f.write(">z\nA\n")
    assert run(spark, str(source), out, marks, kept_days=day).count() == 3  # x and y are forgotten
    with open(source / "a.fasta", "a") as f:
        f.write(">x\nA\n>z\nA\n")
    found = named(run(spark, str(source), out, marks, kept_days=day), "block", "n")
    assert found["a.fasta"].count("x") == 2
