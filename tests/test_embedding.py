import numpy as np
from pyspark.sql import functions as F

from residua.operators import embedding as e

WIDTH = 16


def place(c: str) -> np.ndarray:
    return (ord(c) * (2 * np.arange(WIDTH) + 3)) % 17 - 8


def masked(s: str) -> np.ndarray:
    return np.mean([place(c) for c in s[:1022]], axis=0) if s else np.zeros(WIDTH)


def over_all_places(batch: list[str]) -> list[np.ndarray]:
    longest = max(len(s[:1022]) for s in batch)
    rows = []
    for s in batch:
        s = s[:1022]
        rows.append(np.mean([np.full(WIDTH, 3.0), *map(place, s), np.full(WIDTH, 5.0), *[np.full(WIDTH, 7.0)] * (longest - len(s))], axis=0))
    return rows


def some_rows(spark):
    rows = [(k, "ACDEFGHIKLMNPQRSTVWY"[k % 20] * (k * 37 % 90) + "MK" * (k % 3)) for k in range(58)] + [(58, "W" * 1500)]
    return rows, spark.createDataFrame(rows, "k bigint, s string").repartition(5)


def test_masked_and_all_places(spark):
    """By places and by whole sequences; means over all places depend on the batch, and batches follow the key."""
    rows, df = some_rows(spark)
    for make in (e.TestTokenEmbedder, e.TestEmbedder):
        got = {r.k: r.embedding for r in e.embed(df, "s", make, make.__name__).collect()}
        assert all(np.allclose(got[k], masked(s), atol=1e-5) for k, s in rows)
    got = {r.k: r.embedding for r in e.embed_batches(df, "s", "k", e.TestTokenEmbedder, "places", 4).collect()}
    want = [v for lo in range(0, len(rows), 4) for v in over_all_places([s for _, s in rows[lo : lo + 4]])]
    assert len(got) == len(rows) and all(np.allclose(got[k], want[k], atol=1e-5) for k, _ in rows)
    assert e.embed_batches(df, "s", "k", e.TestEmbedder, "no places").filter("embedding is null").count() == len(rows)


def test_groups_of_like_lengths_pad_little():
    draw = np.random.default_rng(5)
    lengths = draw.integers(0, 1023, 500).tolist()
    groups = e.length_groups(lengths, 4 * 1024)
    assert sorted(k for g in groups for k in g) == list(range(500))
    assert all(len(g) == 1 or len(g) * (max(lengths[k] for k in g) + 2) <= 4 * 1024 for g in groups)
    by_number = [list(range(lo, lo + 4)) for lo in range(0, 500, 4)]
    assert e.padding_share(lengths, groups) < 0.05 < 0.3 < e.padding_share(lengths, by_number)
    assert len(groups) < len(by_number) and e.length_groups([], 10) == [] and e.length_groups([50, 50], 10) == [[0], [1]]


def test_stage_and_its_profile(spark):
    """Without a profile the stage runs on CPUs; with one it is in the plan, where a cluster finds it."""
    rows, df = some_rows(spark)
    df = df.withColumn("meta.host", F.lit("x"))
    staged = e.embed_stage(df, "s", e.TestTokenEmbedder, "stage")
    got = {r.k: r for r in staged.collect()}
    assert all(np.allclose(got[k].embedding, masked(s), atol=1e-5) and got[k]["meta.host"] == "x" for k, s in rows)
    nulls = e.embed_stage(df.withColumn("s", F.lit(None).cast("string")), "s", e.TestTokenEmbedder, "stage")
    assert nulls.filter("embedding is null").count() == len(rows)
    profile = e.accelerator_profile(2, tasks_each=4)
    stage = lambda df: df._jdf.queryExecution().analyzed().children().apply(0)
    node = stage(e.embed_stage(df, "s", e.TestTokenEmbedder, "stage", profile))
    assert node.profile().isDefined() and node.profile().get().taskResources().apply("gpu").amount() == 0.25
    assert not stage(staged).profile().isDefined()
    assert e.device_address() is None


def test_batch_that_the_worker_reports(spark):
    """Groups follow the embedder's own batch, and one bad sequence loses only itself."""

    class Reports(e.TestEmbedder):
        batch = 2

        def embed(self, sequences):
            assert sum(map(len, sequences)) <= 2 * 1024
            if "!" in "".join(sequences):
                raise ValueError
            return super().embed(sequences)

    texts = ["A" * 900, "C" * 900, "D!", "E" * 10] * 5
    out = e.embed_all(Reports(), texts)
    assert [v is None for v in out] == ["!" in t for t in texts]
