import numpy as np
from pyspark.sql import functions as F

from residua.llm import toxicity as t
from residua.llm.queries import op4_toxicity_ordinal


def test_query_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known, held = labels.filter("doc_id % 2 = 0"), {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    said = {r.doc_id: r for r in t.score_documents(docs, t.fit_severity(docs, known)).collect()}
    clean = [d for d, y in held.items() if not y]
    assert sum(said[d].toxic for d in clean) <= 0.003 * len(clean)
    toxic = [d for d, y in held.items() if y]
    assert sum(said[d].toxic for d in toxic) >= 0.88 * len(toxic)
    assert op4_toxicity_ordinal(spark, sf).count() == docs.count()


def slow_features(text):
    out = set()
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split():
        w = w.strip(t.EDGE.decode())
        if w:
            out |= {"=" + w} | {w[:n] for n in t.OPENINGS if len(w) >= n}
    return out


def test_sample_features_and_scores_by_brute_force(spark):
    """The rows taken, the features chosen and every document's figures, each from plain loops."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = {r.doc_id: (r.h, r.doc_id, r.toxic) for r in labels.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).collect()}
    taken = {}
    for y in (0, 1):
        taken |= {d: y for _, d, _ in sorted(v for v in order.values() if v[2] == y)[:100]}
    sample = t.materialize(t.labelled_sample(docs, labels, "toxic", 100), "sample")
    assert {r.doc_id: (r.label, r.text) for r in sample.collect()} == {d: (y, texts[d]) for d, y in taken.items()}
    seen = {d: slow_features(texts[d]) for d in taken}
    n0, n1, scored = sum(y == 0 for y in taken.values()), sum(taken.values()), []
    for f in set().union(*seen.values()):
        a, b = (sum(f in seen[d] for d, y in taken.items() if y == c) for c in (0, 1))
        if a + b >= t.MIN_DOCS:
            chi2 = (a * (n1 - b) - b * (n0 - a)) ** 2 * (n0 + n1) / max((a + b) * (n0 + n1 - a - b) * n0 * n1, 1)
            if chi2 >= t.MIN_CHI2:
                scored.append((-chi2, f))
    features = t.choose_features(sample)
    assert features == [f for _, f in sorted(scored)] and len(features) > 5
    model = t.OrdinalModel(tuple(features), np.linspace(-1, 2, len(features)), np.array([0.5, 2.0]))
    got = {r.doc_id: r for r in t.score_documents(docs, model).collect()}
    for d, text in texts.items():
        z = sum(model.weights[k] for k, f in enumerate(features) if f in slow_features(text))
        p1, p2 = (1 / (1 + np.exp(c - z)) for c in model.thresholds)
        want = [1 - p1, p1 - p2, p2]
        assert abs(got[d].p_toxic - p1) < 1e-9 and abs(got[d].expected_severity - (p1 + p2)) < 1e-9
        assert got[d].toxic == (p1 >= t.CUT) and abs(want[got[d].grade] - max(want)) < 1e-9
    kept = {r.doc_id for r in t.drop_toxic(docs, model).collect()}
    assert kept == {d for d in texts if not got[d].toxic}


def test_likelihood_is_at_its_top():
    """No small step from the fitted weights and thresholds does better."""
    rng = np.random.default_rng(2)
    x = (rng.random((600, 6)) < 0.4).astype(float)
    z = x @ np.array([2.0, -1, 0, 1, 0, 0.5]) + rng.logistic(size=600)
    grade = (z > 1).astype(int) + (z > 2.5)
    m = t.fit_ordinal(t.presence(x), grade, tuple("abcdef"))
    assert m.thresholds[0] < m.thresholds[1]

    def loss(w, theta):
        above = 1 / (1 + np.exp(theta[None] - (x @ w)[:, None]))
        full = np.concatenate([np.ones((600, 1)), above, np.zeros((600, 1))], axis=1)
        return -np.log(full[np.arange(600), grade] - full[np.arange(600), grade + 1]).mean() + t.PENALTY / 2 * (w**2).sum()

    best = loss(m.weights, m.thresholds)
    for k in range(8):
        for d in (-0.05, 0.05):
            w, theta = m.weights.copy(), m.thresholds.copy()
            (w if k < 6 else theta)[k % 6] += d
            assert loss(w, theta) >= best - 1e-6


def test_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(100 + k, f"a fine text number{k}") for k in range(40)] + [(200 + k, f"an awful grumblefoo text{k}") for k in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(100 + k, 0) for k in range(40)] + [(200 + k, 1) for k in range(20)] + [(200, 1), (None, 1), (101, None), (999, 1)], "doc_id bigint, toxic int")
    m = t.fit_severity(docs, labels)
    assert t.score_documents(docs, m).filter("toxic").count() == 20
    assert t.score_documents(odd_docs, m).count() == odd_docs.count() and not t.score_documents(odd_docs, m).filter("toxic").count()
    assert t.drop_toxic(docs, m).count() == 40 and t.drop_toxic(odd_docs, m).columns == odd_docs.columns
    assert t.score_documents(no_docs, m).count() == 0
    nothing = t.fit_severity(docs, labels.limit(0))
    assert not t.score_documents(docs, nothing).filter("toxic").count()


def test_grades_as_they_are(spark):
    rows = [(k, ["calm", "calm mildly", "calm mildly severely"][k % 3] + f" w{k}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    m = t.fit_severity(docs, spark.createDataFrame([(k, k % 3) for k in range(150)], "doc_id bigint, grade int"), "grade")
    assert all(r.grade == r.doc_id % 3 for r in t.score_documents(docs, m).collect())
