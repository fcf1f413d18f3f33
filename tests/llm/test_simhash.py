import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from residua.llm import simhash
from residua.llm.queries import op6_simhash_variants


def slow_print(text):
    words = [w.encode() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    grams = [words[k : k + 4] for k in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    """doc -> smallest doc reachable, by comparing all."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = root(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or least.get(r) is not None else None
    return [least[root(i)] for i in range(len(prints))]


def same(rows, docs):
    prints = [(d, slow_print(t)) for d, t in docs]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, slow_components(prints), strict=True)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(op6_simhash_variants(spark, sf).collect(), docs)


def test_odd_rows(odd_docs, no_docs):
    same(simhash.near_duplicates(odd_docs).collect(), [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text for r in odd_docs.select("text").collect()]
    assert kept.count() == len(set(slow_components([(k, slow_print(t)) for k, t in enumerate(texts)])))
    assert simhash.keep_first(no_docs).count() == 0


def test_keep_first_row_by_row(spark, odd_docs):
    """Columns with the operator's own names, copies in thousands, repeated rows: against comparing all."""
    names = ["own_digest", "mark", "touched", "other_id", "other_digest", "keep", "first", "n", "fp", "__own"]
    own = " || ' ' || ".join(f"md5(string(3 * id + {k}))" for k in range(9))
    more = spark.range(900).selectExpr("if(id % 3 = 0, 5000, 9000) + id as doc_id", f"if(id % 3 = 0, 'many copies of this one text here', {own}) as text")
    docs = odd_docs.select("doc_id", "text").unionByName(more).union(more.filter("doc_id < 5100"))
    docs = docs.select("*", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(n) for n in names))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    values = {}
    for d, t in rows:
        values.setdefault(slow_print(t), []).append((d is None, d if d is not None else 0, simhash_digest(spark, t), d, t))
    distinct = sorted(values)
    component = slow_components([(k, p) for k, p in enumerate(distinct)])
    least = {}
    for k, c in enumerate(component):
        least[c] = min([*values[distinct[k]], *([least[c]] if c in least else [])], key=lambda v: v[:3])
    got = simhash.keep_first(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((v[3], v[4]) for v in least.values()), key=repr)
    assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in got for n in names)


_DIGESTS = {}


def simhash_digest(spark, text):
    if text not in _DIGESTS:
        _DIGESTS[text] = xxhash.xxh64_intdigest((text or "").encode(), 42)
        _DIGESTS[text] -= (_DIGESTS[text] >> 63) << 64
    return _DIGESTS[text]


def test_one_component_of_most_rows(spark):
    """Stars and labels beyond the hot share, on the made fingerprints of one large family."""
    rng = random.Random(8)
    core = rng.getrandbits(64)
    near = [core ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    values = [core, *near, *(rng.getrandbits(64) for _ in range(300))]
    rows = [(k, k, int(np.uint64(v).astype(np.int64))) for k, v in enumerate(values)] * 2
    prints = spark.createDataFrame(rows, "doc_id bigint, digest bigint, fp bigint").repartition(4)
    for hot_rows in (simhash.HOT_ROWS, 100):
        got = {r.fp: (r["first"].doc_id, r.n) for r in simhash.classes(prints, hot_rows).collect()}
        assert all(got[r[2]] == (0 if r[0] <= len(near) else r[0], 2) for r in rows)


def test_forest_has_no_spare_edge():
    """Of a family that shares many keys, small or large, exactly the edges of a tree."""
    core = 0x0123456789ABCDEF
    fp = np.array([core ^ (1 << a) for a in range(40)] + [core], np.uint64).view(np.int64)
    keys, owners = simhash.wildcard_keys(fp)
    a, b = simhash.forest(keys, owners)
    assert len(a) == 40 and (a != b).all()
    for size in (5, 41):
        some = fp[:size]
        a, b = simhash.forest(np.repeat(np.arange(3), size), np.tile(some, 3))
        assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True))) == size - 1


def chain(rng, n, step):
    x, out = rng.getrandbits(64), []
    for _ in range(n):
        out.append(x)
        for b in rng.sample(range(64), step):
            x ^= 1 << b
    return out


def test_components_of_made_prints(spark):
    """Chains at the limit of four bits, dense families over a bucket's small size, and strangers."""
    rng = random.Random(5)
    values = [v for _ in range(6) for v in chain(rng, 12, 4)] + [v for _ in range(6) for v in chain(rng, 6, 5)]
    core = rng.getrandbits(64)
    values += [core ^ (1 << b) ^ (1 << c) for b in range(0, 30) for c in range(30, 40)] + [rng.getrandbits(64) for _ in range(200)]
    rows = [(k, k, int(np.uint64(v).astype(np.int64))) for k, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "doc_id bigint, digest bigint, fp bigint")
    want = slow_components([(k, v) for k, v in enumerate(values)])
    for hot_rows in (simhash.HOT_ROWS, 40, 0):  # no key, some keys and all keys cut further
        got = {r.fp: r["first"].doc_id for r in simhash.classes(prints, hot_rows).collect()}
        assert [got[r[2]] for r in rows] == want
