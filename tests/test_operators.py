import numpy as np
from pyspark.sql import functions as F

from residua.operators import metrics, model, sampling
from residua.operators.ranks import row_numbers, running_total


def test_row_numbers(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g", "cast((id * 37) % 50 as double) as x")
    got = {r.id: r.rn for r in row_numbers(df, ["g"], "x", ["id"]).collect()}
    for g in range(3):
        want = sorted((k for k in range(500) if k % 3 == g), key=lambda k: ((k * 37) % 50, k))
        assert [got[k] for k in want] == list(range(1, len(want) + 1))


def test_many_buckets(spark):
    """Buckets of few rows, repeated and missing order values, values of both signs."""
    df = spark.range(3000).selectExpr("id", "id % 2 as g", "if(id % 50 = 0, null, cast((id * 37) % 611 - 300 as bigint)) as x").repartition(5)
    got = {r.id: r.t for r in running_total(df, ["g"], "x", ["id"], F.col("id"), "t", bucket_rows=20).collect()}
    rows = sorted(((k % 2, -(10**6) if k % 50 == 0 else (k * 37) % 611 - 300, k) for k in range(3000)))
    want, sums = {}, [0, 0]
    for g, _, k in rows:
        want[k], sums[g] = sums[g], sums[g] + k
    assert got == want


def test_quotas_and_folds(spark):
    assert sampling.class_quotas({0: 58, 1: 341}, 0.2) == {0: 12, 1: 68}
    assert sampling.fold_sizes({0: 13, 1: 9}, 5) == {0: [3, 3, 3, 2, 2], 1: [2, 2, 1, 2, 2]}
    df = spark.range(22).selectExpr("id as k", "if(id < 13, 0, 1) as label")
    rows = sampling.stratified_folds(df, "label", "k").orderBy("k").collect()
    assert [r.fold for r in rows if r.label == 0] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2 + [4] * 2


def test_auc_and_one_class(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df).first()[0] - want) < 1e-12
    assert metrics.roc_auc(df.filter("label = 1")).first()[0] is None
    one = df.filter("label = 1").selectExpr("label", "1 as prediction")
    assert tuple(metrics.confusion_matrix(one).first()) == (0, 0, 0, one.count())


def test_fit_matches_newton(spark):
    """Half the squared weights plus the sum of losses, intercept free."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2, 0.5] + rng.logistic(size=200) > 0).astype(float)
    a = np.hstack([x, np.ones((200, 1))])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        reg = np.diag([1.0, 1, 1, 0])
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + reg, a.T @ (p - y) + reg @ w)
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y, strict=True)], "features array<double>, label int")
    m = model.fit(df)
    assert np.allclose([*m.coefficients.toArray(), m.intercept], w, atol=1e-4)
    rows = model.score(m, df.withColumn("k", F.monotonically_increasing_id())).orderBy("k").collect()
    p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    assert np.allclose([r.probability for r in rows], p) and [r.prediction for r in rows] == (p > 0.5).astype(int).tolist()
    assert [r.class_name for r in rows] == ["Adhesion" if v > 0.5 else "Non-adhesion" for v in p]


def test_train_against_numpy(spark, tmp_path):
    """Hold-out, folds and the final model of ``train`` from the same splits by Newton steps."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 2))
    y = (x @ [1.5, -1] + rng.logistic(size=150) > 0.3).astype(int)
    df = spark.createDataFrame([(k, r.tolist(), int(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "key bigint, features array<double>, label int")

    def newton(rows):
        a, t, w = np.hstack([x[rows], np.ones((len(rows), 1))]), y[rows], np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-a @ w))
            reg = np.diag([1.0, 1, 0])
            w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + reg, a.T @ (p - t) + reg @ w)
        return w

    def accuracy(w, rows):
        return ((np.hstack([x[rows], np.ones((len(rows), 1))]) @ w > 0) == y[rows]).mean()

    split = sampling.stratified_split(df, "label", "key")
    folds = {r.key: r.fold for r in sampling.stratified_folds(split.filter("not is_test"), "label", "key").collect()}
    fitted, held = sorted(folds), sorted(r.key for r in split.filter("is_test").collect())
    cv = [accuracy(newton([k for k in fitted if folds[k] != f]), [k for k in fitted if folds[k] == f]) for f in range(5)]
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("one", "seven fits in one set of passes")
    t = model.train(df, "key")
    spark.sparkContext.setJobGroup("each", "seven fits")
    single = [model.fit(split.filter("not is_test")), *(model.fit(split.filter("not is_test").filter(~F.col("key").isin([k for k in fitted if folds[k] == f]))) for f in range(5)), model.fit(split)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(type(v) is float for v in (t.train_accuracy, t.test_accuracy, t.cv_mean, t.cv_two_std))
    assert t.steps < 15 and 4 * jobs("one") <= jobs("each"), (jobs("one"), jobs("each"))
    assert np.allclose([*single[-1].coefficients.toArray(), single[-1].intercept], [*t.model.coefficients.toArray(), t.model.intercept], atol=1e-6)
    w = newton(fitted)
    want = (accuracy(w, fitted), accuracy(w, held), np.mean(cv), 2 * np.std(cv))
    assert np.allclose((t.train_accuracy, t.test_accuracy, t.cv_mean, t.cv_two_std), want)
    assert np.allclose([*t.model.coefficients.toArray(), t.model.intercept], newton(list(range(150))), atol=1e-9)
    model.save(t.model, str(tmp_path / "m"))
    assert model.load(str(tmp_path / "m")).coefficients == t.model.coefficients


def test_fits_at_once(spark, monkeypatch):
    """Every fit's weights are at its own minimum, also where sums pass through several stages and steps must be halved."""
    from residua.scratch import materialize

    monkeypatch.setattr(model, "TREE_PARTS", 2)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 4)) * 30, rng.normal(size=(300, 1))], axis=1)
    y = (x[:, 0] > 5).astype(int)  # apart by one feature
    fold = np.where(np.arange(300) % 6 == 0, -1, np.arange(300) % 3)
    rows = [(r.tolist(), int(v), bool(f < 0), int(f)) for r, v, f in zip(x, y, fold, strict=True)]
    df = materialize(spark.createDataFrame(rows, "features array<double>, label int, is_test boolean, fold int").repartition(9), "rows")
    weights, _ = model.fit_all(df, 3)
    a, reg = np.hstack([x, np.ones((300, 1))]), np.append(np.ones(5), 0)
    for k, taken in enumerate(model.members(fold < 0, fold, 3)):
        p = 1 / (1 + np.exp(-a[taken] @ weights[k]))
        assert np.abs(a[taken].T @ (p - y[taken]) + reg * weights[k]).max() < 1e-6


def test_train_eval_query(spark):
    from residua.plans.catalog import QUERIES, SF_SMALL

    (row,) = QUERIES["train_eval"](spark, SF_SMALL).collect()
    assert all(0.5 <= v <= 1 for v in row[:3]) and row.cv_two_std >= 0
