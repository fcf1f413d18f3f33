import itertools
import re
from collections import Counter

import pytest

from residua.llm import filter_audit
from residua.llm.filter_audit import audit
from residua.llm.queries import op12_filter_audit, table

LABELS = "doc_id bigint, quality int, toxic int, note string"


def slow(docs, labels):
    """All rows by taking filters in turn."""
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    fails = []
    for doc_id, text, _ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        own["E"] = doc_id is not None and any(d is not None and d < doc_id and t == text for d, t, _ in docs)
        fails.append({f for f, v in own.items() if v})
    out, removed_by = [], Counter()
    for part in {d[2] for d in docs}:
        mine = [(d[0], f) for d, f in zip(docs, fails, strict=True) if d[2] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d, bad in left if f in bad]
                left = [(d, bad) for d, bad in left if f not in bad]
                removed_by[part, f] += len(gone)
                redundant = sum(f in bad for _, bad in mine) - len(gone)
                counts = (len(left), len(gone), redundant, sum(bad == {f} for _, bad in mine), sum(d in good for d in gone), sum(d in toxic for d in gone))
                out.append((part, order, step, *counts))
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark, sf):
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in table(spark, sf, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, sf, "labels").collect()]
    got = rows_of(op12_filter_audit(spark, sf))
    assert len(got) == 600 * len({d[2] for d in docs}) and got == slow(docs, labels)


@pytest.mark.parametrize("chunk", [filter_audit.CHUNK_ROWS, 3])
def test_odd_rows(spark, odd_docs, monkeypatch, chunk):
    monkeypatch.setattr(filter_audit, "CHUNK_ROWS", chunk)
    labels = [(2, 1, 0), (2, None, 1), (5, 1, 1), (None, 1, 1), (6, None, None), (99, 1, 1), (3, 0, 0)]
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in odd_docs.collect()]
    frame = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    known = [r for r in labels if r[0] is not None]
    assert rows_of(audit(odd_docs, frame)) == slow(docs, known)


def test_many_parts_and_a_hot_id(spark):
    """An id and a text that make up a third of all rows, and more parts than rows in most of them."""
    docs = [(k, f"text {k % 50}", f"part{k % 40}") for k in range(400)] + [(7, "hot text", "hot")] * 200 + [(None, "hot text", "hot")] * 50
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 400, 5)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert rows_of(audit(frame, spark.createDataFrame([(*r, "x") for r in labels], LABELS))) == slow(docs, labels)


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], LABELS)
    assert audit(no_docs, none).count() == 0
    assert audit(odd_docs, none).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)
