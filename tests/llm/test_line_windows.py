import random

from pyspark.sql import functions as F

from residua.llm import common
from residua.llm import line_windows as lw
from residua.llm.queries import op9_line_windows


def slow(docs):
    """docs: (doc_id, text) in order; every document once."""
    seen, out = set(), {}
    for d, t in docs:
        if t is None:
            out[d, t] = (None, 0, 0)
            continue
        lines = t.split("\n")
        keys = [" ".join(x.lower().split()) for x in lines]
        cut = set()
        for k in range(len(lines) - 2):
            win = tuple(keys[k : k + 3])
            if any(win):
                cut |= {k, k + 1, k + 2} if win in seen else set()
                seen.add(win)
        out[d, t] = ("\n".join(x for k, x in enumerate(lines) if k not in cut), len(lines), len(cut))
    return out


def test_query(spark, sf):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = slow(docs)
    rows = op9_line_windows(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted((d, *v) for (d, _), v in want.items())
    assert any(r.n_cut for r in rows)


def test_made_texts(spark):
    rng = random.Random(9)
    docs = [(k, "\n".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 9)))) for k in range(60)]
    rows = lw.cut_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, rows)) == sorted((d, *v) for (d, _), v in slow(docs).items())


def test_odd_rows(odd_docs, no_docs):
    """The row without id comes first; rows that repeat are one document; those with one id go by text digest."""
    rows = lw.cut_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) < set(rows[0].asDict())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_cut == 4 and by[1][0].text.startswith("Hello there")
    assert [r.text for r in by[2]] == ["", ""] and by[3][0].text == ""
    assert by[5][0].text is None and by[5][0].n_lines == 0 and by[4][0].n_lines == 1
    assert by[6][0].n_cut == 0 and by[7][0].n_cut == 0
    assert lw.cut_lines(no_docs).count() == 0


def test_many_spans(spark):
    """A long text with a repeated passage every ten lines: spans and lines are each looked at once."""
    passage = ["this passage", "is found", "again and again"]
    lines = [x for k in range(8000) for x in [*passage, *(f"own line {k} {j}" for j in range(7))]]
    rows = lw.cut_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(passage))], "doc_id bigint, text string")).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_cut == 3 * 7999 and by[1].text.split("\n") == passage + [x for x in lines if x not in passage]
    assert by[2].text == "" and by[2].n_cut == 3


def test_names_that_clash(spark, odd_docs):
    """Columns named as the operator's own are kept, whatever their type."""
    docs = odd_docs
    for name in ("cuts", "own_digest", "touched", "other_id", "other_digest", "mark", "h1", "line", "first", "N_CUT"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id"), F.lit(-1))))
    rows = lw.cut_lines(docs).collect()
    plain = sorted(((r.doc_id, r.text, r.n_lines, r.n_cut) for r in lw.cut_lines(odd_docs).collect()), key=repr)
    assert sorted(((r.doc_id, r.text, r.n_lines, r["n_cut_"]) for r in rows), key=repr) == plain
    assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in rows for n in ("cuts", "own_digest", "touched", "other_id", "mark", "line", "N_CUT"))


def test_hot_windows(spark, monkeypatch):
    """One passage in most documents, with every window hot and with none."""
    rng = random.Random(2)
    docs = [(k, "\n".join([*(["p q", "r", "s t", "u"] if k % 4 else []), *(rng.choice("abcdefghij") * 3 for _ in range(rng.randrange(6)))])) for k in range(300)]
    want = sorted((d, *v) for (d, _), v in slow(docs).items())
    for share in (1000, 2):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert sorted(map(tuple, lw.cut_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())) == want


def test_odd_rows_by_brute_force(odd_docs):
    """Documents in the operator's order: without id first, then by id; of one id by the texts' digests."""
    rows = [(r.doc_id, r.text, r.digest) for r in odd_docs.select("doc_id", "text", lw.digest("text").alias("digest")).collect()]
    order = sorted({(d is not None, d or 0, g, t) for d, t, g in rows if t is not None}) + [(True, 0, 0, None)]
    want = slow([((a, d), t) for a, d, _, t in order])
    found = {(a, d, t): want[(a, d), t] for a, d, _, t in order}
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_cut) for r in lw.cut_lines(odd_docs).collect()), key=repr)
    assert got == sorted(((d, *(found[d is not None, d or 0, t] if t is not None else (None, 0, 0))) for d, t, _ in rows), key=repr)


def test_runs(spark, monkeypatch):
    """Runs of one text, of some and of all, over few and many partitions, find the same; so do rows that repeat within and between runs."""
    rng = random.Random(5)
    docs = [(k % 90 if k % 7 else None, "\n".join(rng.choice("abc ") for _ in range(rng.randrange(0, 12)))) for k in range(120)]
    docs += [docs[k] for k in (3, 3, 40, 70)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = []
    for size, parts in ((1, 7), (25, 3), (1 << 20, 1), (1 << 20, 11)):
        monkeypatch.setattr(lw, "RUN_WINDOWS", size)
        got.append(sorted(map(tuple, lw.cut_lines(table.repartition(parts)).collect()), key=repr))
    assert all(x == got[0] for x in got) and len(got[0]) == len(docs) and any(r[3] for r in got[0])


def test_a_window_has_a_row_for_each_run(spark):
    """However often a passage occurs, what has to meet is one place of each run; the rest is spread by number."""
    table = spark.createDataFrame([(k, "p\nq\nr\np\nq\nr") for k in range(2000)], "doc_id bigint, text string").repartition(5)
    found = lw.places(table)
    assert found.filter("repeat is null").groupBy("h1", "h2").count().agg(F.max("count")).first()[0] <= 5
    assert found.count() == 2000 * 4 and found.agg(F.sum("times")).first()[0] == 2000 * 4


def test_rows_of_a_document(spark):
    """``n`` counts a document's rows, in one run or several."""
    rows = [(1, "a\nb\nc"), *[(2, "a\nb\nc\nd")] * 5, (3, "x\ny\nz")]
    for parts in (1, 4):
        spans = lw.spans_to_cut(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect()
        assert [(r.doc_id, [tuple(c) for c in r.cuts], r.n) for r in spans] == [(2, [(0, 3)], 5)]
