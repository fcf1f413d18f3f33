import hashlib
import re

import pytest
from pyspark.sql import functions as F

from residua.llm import decontamination as d
from residua.llm.queries import op5_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def slow(docs, items):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for doc, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_query(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted(map(tuple, op5_benchmark_decontamination(spark, sf).collect()))
    assert got == sorted(slow(docs, items))
    assert any(r[5] for r in got)


ITEMS = [(1, "The FIRST line is here. The second line is there, yes"), (2, "second line"), (2, "second line"), (3, None), (4, ""), (None, "third line"), (10, "漢字 🙂"), (11, "word1 x1 word2 x2 word3 x3 word4 x4 word5 x5 word6 x6")]


@pytest.mark.parametrize("block", [100, 2])
def test_odd_rows_in_blocks(spark, odd_docs, no_docs, block):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    found = d.find_windows(odd_docs, items, block_items=block).collect()
    want = slow(docs, ITEMS)
    assert sorted(((r.doc_id, r.n_words, len(r.hits), len(r["items"])) for r in found), key=repr) == sorted((w[:4] for w in want), key=repr)
    assert d.decontaminate(no_docs, items).count() == 0
    assert not d.decontaminate(odd_docs, items.limit(0)).filter("contaminated").count()
    clean = d.clean_documents(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == sum(not w[5] for w in want)


def test_spans_lie_in_the_original(spark):
    docs = spark.createDataFrame([(1, "É, the «Second»  LINE; ends")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "second line")], "item_id bigint, text string")
    text = docs.first().text
    assert [text[r.start_at : r.end_at] for r in d.hit_spans(docs, items).collect()] == []  # the quotes are word characters
    items = spark.createDataFrame([(1, "«second» line")], "item_id bigint, text string")
    rows = d.hit_spans(docs, items).collect()
    assert [text[r.start_at : r.end_at] for r in rows] == ["«Second»  LINE"]


def slow_spans(text, items):
    """Runs of hit words as they stand in the text."""
    places = [m.span() for m in WORD.finditer(lower(text))]
    words, hit = [text[a:b] for a, b in places], set()
    for _, t in items:
        w = WORD.findall(lower(t))
        for win in {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}:
            for k in range(len(words) - len(win) + 1):
                if tuple(map(lower, words[k : k + len(win)])) == win:
                    hit |= set(range(k, k + len(win)))
    runs = [k for k in sorted(hit) if k - 1 not in hit]
    return [(places[k][0], places[next(e for e in range(k, len(words) + 1) if e not in hit) - 1][1]) for k in runs]


@pytest.mark.parametrize("block", [20_000, 2])
def test_spans_of_odd_rows(spark, odd_docs, no_docs, monkeypatch, block):
    """Null and repeated ids, with equal and with other texts; one block or several."""
    monkeypatch.setattr(d, "BLOCK_ITEMS", block)
    monkeypatch.setattr(d.find_windows, "__defaults__", (d.WINDOW_WORDS, block, d.BLOCK_BYTES, False))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    extra = spark.createDataFrame([(9, "Second line, é third LINE and\nsecond line"), (None, "the «third line» 漢字 🙂"), (9, "Second line, é third LINE and\nsecond line")], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text", "n_words").unionByName(extra.withColumn("n_words", F.lit("clash")))
    want = [(r.doc_id, a, b) for r in docs.collect() for a, b in slow_spans(r.text or "", ITEMS)]
    got = sorted(map(tuple, d.hit_spans(docs, items).collect()), key=repr)
    assert got == sorted(want, key=repr) and len(got) > 8
    assert d.hit_spans(no_docs, items).count() == 0 and d.hit_spans(docs, items.limit(0)).count() == 0
