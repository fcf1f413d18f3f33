import random
import re
import zlib
from collections import Counter

import pytest

from residua.llm.common import materialize
from residua.llm.queries import op11_spelling_variants, table
from residua.llm.spelling import group_variants, near_pairs


def slow_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def slow_near(words):
    """Neighbours through all strings with one letter left out or held open."""
    seen = {}
    for w in words:
        for i in range(len(w)):
            seen.setdefault(w[:i] + "\0" + w[i + 1 :], set()).add(w)
        for v in {w[:i] + w[i + 1 :] for i in range(len(w))}:
            seen.setdefault("-" + v, set()).add(w)
        seen.setdefault("+" + w, set()).add(w)
    near = {w: set() for w in words}
    for k, group in seen.items():
        if "\0" in k:
            for w in group:
                near[w] |= group - {w}
        elif k[0] == "+":
            for w in seen.get("-" + k[1:], ()):
                near[w].add(k[1:])
                near[k[1:]].add(w)
    return near


def slow(docs):
    n = slow_counts(docs)
    near = slow_near(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = rows_of(op11_spelling_variants(spark, sf))
    assert len(got) > 1000 and got == slow(docs)


def drawn_words(n, letters, low, high, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(low, high))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = draw.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]}
    return sorted(w for w in words if len(w) >= 5)


@pytest.mark.parametrize("key_words", [200, 3, 1])
@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzàéßÿ"])
def test_near_pairs_lose_none(spark, key_words, letters):
    """With two letters bigrams repeat within a word and keys are hot; with one word a key all are cut by deletions."""
    words = drawn_words(500, letters, 5, 9, len(letters))
    frame = materialize(spark.createDataFrame([(w,) for w in words], "word string"), "words")
    got = {tuple(r) for r in near_pairs(frame, key_words).collect()}
    assert got == {(a, b) for a, near in slow_near(words).items() for b in near if a < b}


def test_chains_and_ties(spark):
    """Forms of forms, and two near words of one count."""
    times = {"letter": 40, "lettee": 20, "lettez": 20, "leteez": 9, "lxteez": 4, "leteex": 3, "other": 3, "fours": 2}
    docs = [(97 * k + 5, " ".join(w.capitalize() if k % 2 else w for w, n in times.items() if n > k)) for k in range(40)]
    assert rows_of(group_variants(spark.createDataFrame(docs, "doc_id bigint, text string"))) == slow(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    got = rows_of(group_variants(odd_docs.union(odd_docs)))
    assert got == slow([(r.doc_id, r.text) for r in odd_docs.union(odd_docs).collect()])
    assert group_variants(no_docs).count() == 0
