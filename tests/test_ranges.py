import gzip
import io
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from residua import sinks
from residua.sources import datasource, fasta, fasta_index, ranges

LOCAL = fs.LocalFileSystem()


def blocks(data: bytes) -> bytes:
    out = io.BytesIO()
    out.close, end = lambda: None, out
    w = ranges.BlockGzip(out)
    w.write(data)
    w.close()
    return end.getvalue()


def slow(data: bytes) -> list[bytes]:
    """Records of a whole file; what comes before the first mark is none."""
    return [r.removesuffix(b"\n") if k < 0 else r for k, r in enumerate(re.split(rb"\n>", b"\n" + data)[1:])]


def drawn(n: int, seed: int) -> bytes:
    draw = random.Random(seed)
    body = lambda: "".join(draw.choice("ACDEFG\n>") for _ in range(draw.randint(0, 200))).replace("\n>", "\n")
    return "".join(f">r{k} about {k}\n{body()}\n" for k in range(n)).encode()


@settings(max_examples=60, deadline=None)
@given(st.text("A>\n", max_size=40), st.integers(1, 9), st.integers(1, 7))
def test_each_record_is_read_by_one_range(tmp_path_factory, text, split, chunk):
    """Marks and breaks anywhere, also on the edges of ranges and of chunks."""
    path = tmp_path_factory.mktemp("r") / "x.fa"
    path.write_bytes(text.encode())
    ranges.CHUNK, kept = chunk, ranges.CHUNK
    try:
        found = [x for r in ranges.ranges_of(LOCAL, str(path), len(text), split) for x in ranges.read_range(LOCAL, r)]
    finally:
        ranges.CHUNK = kept
    assert [t for _, t in found] == slow(text.encode())
    assert all(text[at] == ">" for at, _ in found)


@pytest.mark.parametrize("split", [700, 5_000, 40_000, 10**9])
def test_block_gzip_in_ranges(tmp_path, split):
    """Records cross blocks and ranges; other gzip members may stand for blocks nowhere."""
    data = b"junk\n" + drawn(4000, 1) + b">long\n" + b"ACDE\n" * 60_000 + b">last"
    packed = blocks(data)
    assert gzip.decompress(packed) == data and packed.endswith(ranges.LAST_BLOCK)
    path = tmp_path / "x.fa.gz"
    path.write_bytes(packed)
    parts = ranges.ranges_of(LOCAL, str(path), len(packed), split)
    assert {r.kind for r in parts} == {"blocks"} and (split > len(packed)) == (len(parts) == 1)
    assert [t for r in parts for _, t in ranges.read_range(LOCAL, r)] == slow(data)


def test_broken_blocks_and_plain_gzip(tmp_path):
    data = drawn(3000, 2)
    packed = bytearray(blocks(data))
    packed[len(packed) // 2] ^= 255
    path = tmp_path / "x.fa.gz"
    path.write_bytes(packed)
    with pytest.raises(OSError):
        list(ranges.read_range(LOCAL, ranges.Range(str(path), 0, len(packed), "blocks")))
    path.write_bytes(gzip.compress(data[:1000]) + gzip.compress(data[1000:]))
    (part,) = ranges.ranges_of(LOCAL, str(path), path.stat().st_size, 100)
    assert part.kind == "gzip" and [t for _, t in ranges.read_range(LOCAL, part)] == slow(data)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.fasta").write_text(">s1 first one\nMKJ*\nLLj\n>s2\n\n>s1 again\r\nAC D\r\n>\nX\n> s3  spaced  name \nW")
    (tmp_path / "sub" / "B.FAA").write_text("junk\n>t1 x\nACDEFG\n")
    (tmp_path / "c.pep.gz").write_bytes(gzip.compress(b">g1\nWWW\n"))
    (tmp_path / "d.fa.gz").write_bytes(blocks(drawn(900, 3)))
    (tmp_path / "big.fa").write_bytes(drawn(2000, 4))
    (tmp_path / "no.txt").write_text(">no\nA\n")
    return tmp_path


def rows_of(df):
    return sorted((r.file_path.rsplit("/", 1)[1], r.record_no, r.id, r.description, r.sequence) for r in df.collect())


def test_source_equals_the_reader(spark, folder):
    want = rows_of(fasta.read_fasta(spark, str(folder)))
    for split in (datasource.SPLIT_BYTES, 3000):
        assert rows_of(datasource.read_fasta(spark, str(folder), splitBytes=split)) == want
    assert len(want) > 2900 and {r.file_path for r in datasource.read_fasta(spark, str(folder)).select("file_path").collect()} == {r.file_path.replace("file:/", "file:///", 1) if not r.file_path.startswith("file:///") else r.file_path for r in fasta.read_fasta(spark, str(folder)).select("file_path").collect()}
    assert rows_of(datasource.read_fasta(spark, str(folder), upper=False)) == [r for r in want if r[0] != "B.FAA"]
    assert datasource.load(spark, str(folder), splitBytes=3000).rdd.getNumPartitions() > 30
    assert rows_of(datasource.read_fasta(spark, [str(folder / "a.fasta"), str(folder / "no.txt")])) == sorted([r for r in want if r[0] == "a.fasta"] + [("no.txt", 1, "no", "", "A")])


def test_hidden_and_broken_files(spark, folder):
    """The source reads hidden names, and keeps what comes before an error unless it must fail."""
    (folder / "_hidden.fa").write_text(">h\nA\n")
    data = drawn(3000, 5)
    whole, names = blocks(data), [ranges.parts_of(r)[0] for r in slow(data)]
    (folder / "cut.fa.gz").write_bytes(whole[: len(whole) // 2])
    got = rows_of(datasource.read_fasta(spark, str(folder), onError="skip"))
    assert [r[2] for r in got if r[0] == "_hidden.fa"] == ["h"]
    kept = [r[2] for r in got if r[0] == "cut.fa.gz"]
    assert 500 < len(kept) < len(names) and kept[:-1] == names[: len(kept) - 1]  # the last one may be cut
    with pytest.raises(Exception, match="without an end"):
        datasource.read_fasta(spark, str(folder), onError="fail").collect()
    with pytest.raises(Exception, match="nowhere"):
        datasource.load(spark, str(folder / "nowhere")).collect()


def test_filters_reach_the_source(spark, folder):
    some = datasource.load(spark, str(folder), splitBytes=3000)
    one = some.filter(F.col("id").isin("r7", "s2"))
    assert sorted({r.id for r in one.collect()}) == ["r7", "s2"]
    a = f"file://{folder}/a.fasta"
    file = some.filter(F.col("file_path") == a)
    assert file.rdd.getNumPartitions() == 1 and file.count() == 5
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in [x.split("(")[0].strip(" +-:*") for x in plan.splitlines()]
    numbered = datasource.read_fasta(spark, str(folder), splitBytes=3000)
    everything = [(r.record_no, r.sequence) for r in numbered.collect() if r.id == "r1500"]
    assert len(everything) == 1 and [(r.record_no, r.sequence) for r in numbered.filter("id = 'r1500'").collect()] == everything


def test_stream_takes_what_is_new(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    (source / "a.fa").write_bytes(drawn(50, 6))

    def run() -> list[str]:
        datasource.register(spark)
        rows = spark.readStream.format("fasta").option("splitBytes", "700").load(str(source))
        rows.select("id", "sequence").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(once=True).start().awaitTermination(60)
        return sorted(r.id for r in spark.read.schema("id string").parquet(out).collect())

    first = [ranges.parts_of(r)[0] for r in slow(drawn(50, 6))]
    assert run() == sorted(first)
    with open(source / "a.fa", "a") as f:
        f.write(">more\nACD\n>yet\nA\n")
    (source / "b.fa.gz").write_bytes(blocks(b">b1\nA\n"))
    want = sorted([*first, "more", "yet", "b1"])
    assert run() == want and run() == want


@pytest.mark.parametrize("kind", ["none", "gzip", "blocks"])
def test_writer(spark, tmp_path, kind):
    datasource.register(spark)
    rows = spark.range(500).select(F.concat(F.lit("w"), "id").alias("id"), F.when(F.col("id") % 3 > 0, "some words").alias("description"), F.repeat(F.lit("ACD"), F.col("id").cast("int")).alias("sequence"))
    path = str(tmp_path / "o")
    for mode in ("append", "overwrite"):
        rows.repartition(4).write.format("fasta").option("compression", kind).mode(mode).save(path)
    back = fasta.read_fasta(spark, path)
    assert sorted((r.id, r.description, r.sequence) for r in back.collect()) == sorted((r.id, r.description or "", r.sequence) for r in rows.collect())
    bad = rows.withColumn("sequence", F.when(F.col("id") == "w400", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("sequence")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("fasta").option("compression", kind).mode("append").save(path)
    assert fasta.read_fasta(spark, path).count() == 500


def test_joined_blocks_are_one_file(spark, tmp_path):
    """Parts joined make one file of more than ten ranges."""
    datasource.register(spark)
    draw = random.Random(8)
    rows = [(k, f"d{k}", "", "".join(draw.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(2000))) for k in range(900)]
    df = spark.createDataFrame(rows, "k int, id string, description string, sequence string").repartitionByRange(6, "k").sortWithinPartitions("k")
    df.drop("k").write.format("fasta").option("compression", "blocks").mode("append").save(str(tmp_path / "parts"))
    sinks.join_parts(spark, str(tmp_path / "parts"), "", str(tmp_path / "one.fa.gz"))
    back = datasource.load(spark, str(tmp_path / "one.fa.gz"), splitBytes=1 << 16)
    assert back.rdd.getNumPartitions() > 10
    tasks = back.groupBy("block").count().count()
    got = datasource.read_fasta(spark, str(tmp_path / "one.fa.gz"), splitBytes=1 << 16).orderBy("record_no").collect()
    assert tasks > 10 and [(r.record_no, r.id, r.sequence) for r in got] == [(k + 1, i, s) for k, i, _, s in rows]


def test_index_and_fetch(spark, tmp_path):
    draw = random.Random(11)
    text, bodies = "", {}
    for k in range(3000):
        seq = "".join(draw.choice("ACDEFGHIJ*") for _ in range(draw.randint(0, 300)))
        width, end = draw.choice([(60, "\n"), (70, "\r\n"), (1000, "\n")])
        lines = [seq[i : i + width] for i in range(0, len(seq), width)] or [""]
        if k % 50 == 0:
            lines = [seq[:7], seq[7:]]  # of no even width
        text += f">p{k} some {end}" + end.join(lines) + end
        bodies[f"p{k}"] = seq
    text += ">p5 again\nWWW\n>x:1-3\nMMMM\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(text, newline="")
    (tmp_path / "in" / "b.fa").write_text(">only\nACDEF\n")
    fasta_index.save(fasta_index.build(spark, str(tmp_path / "in"), splitBytes=20_000), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    raw = text.encode()
    for r in index.collect():
        if r.file_path.endswith("a.fa"):
            assert raw[r.offset : r.offset + 1] == b">" and raw[r.body - 1 : r.body] == b"\n" and raw[r.offset + 1 :].startswith(r.id.encode())
    cleaned = lambda s: s.replace("J", "L").replace("*", "")
    asked, want = [], []
    for _ in range(400):
        k = draw.randrange(3000)
        a, b = draw.randint(1, 320), draw.randint(1, 320)
        form = draw.choice([f"p{k}", f"p{k}:{a}-{b}", f"p{k}:{a}-", f"p{k}:-{b}"])
        s = bodies[f"p{k}"]
        asked.append(form)
        want.append(cleaned(s if ":" not in form else s[a - 1 : b] if form.endswith(f":{a}-{b}") else s[a - 1 :] if form.endswith("-") else s[:b]))
    asked += ["x:1-3", "x:1-3:2-3", "only", "p5", "none", "none:1-2"]
    want += ["MMMM", "MM", "ACDEF", cleaned(bodies["p5"])]
    ids = spark.createDataFrame(list(enumerate(asked)) + [(9999, None)], "ord int, id string")
    got = fasta_index.fetch(index, ids).collect()
    assert [(r.ord, r.id, r.sequence) for r in got] == [(k, asked[k], s) for k, s in enumerate(want)]


def test_fetch_reads_what_is_asked_for(spark, tmp_path):
    """Bytes read follow the ids, and the stored index is pruned by their range."""
    (tmp_path / "a.fa").write_text("".join(f">p{k:05d}\n" + ("A" * 60 + "\n") * 50 for k in range(3000)))
    fasta_index.save(fasta_index.build(spark, str(tmp_path / "a.fa")), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    count = spark.sparkContext.accumulator(0)
    ids = spark.createDataFrame([(0, "p00007"), (1, "p00009:61-70"), (2, "p00008:1-61"), (3, "p00003:-4")], "ord int, id string")
    got = fasta_index.fetch(index, ids, bytes_read=count)
    rows = got.collect()
    assert [len(r.sequence) for r in rows] == [3000, 10, 61, 4]
    reads = count.value
    assert reads == 3049 + 10 + 62 + 4 < (tmp_path / "a.fa").stat().st_size / 1000
    plan = fasta_index.wanted(index, ids)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(id,p00003\)", plan)
