"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector for all thresholds, thresholds in order.
Features are the presence of words and of word openings of four to six characters, so that inflected
and compounded forms count with their stem. The model is fitted on a bounded sample of labelled rows;
every document is scored where it lies, on its whole text, with nothing shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.common import any_names, held, map_batches, materialize, utf8

#: Labelled rows of each class that a fit uses at most, chosen by a hash of doc_id.
SAMPLE_PER_CLASS = 4000
#: What a feature must show to be taken into a model.
MIN_DOCS, MIN_CHI2 = 5, 25.0
PENALTY, STEPS, RATE = 1e-5, 800, 0.05
#: A document is toxic where a grade above 0 is at least this probable.
CUT = 0.5
OPENINGS = (4, 5, 6)
EDGE = b".,!?;:#*$%&|\"'()[]{}<>-_"
CACHE_WORDS = 500_000


def word_features(word: bytes) -> tuple[str, ...]:
    w = word.strip(EDGE).decode("utf-8")
    return (f"={w}", *(w[:n] for n in OPENINGS if len(w) >= n)) if w else ()


def text_words(text: bytes) -> set[bytes]:
    return set(text.lower().split())


@dataclass(frozen=True)
class OrdinalModel:
    features: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


@dataclass(frozen=True)
class Presence:
    """A matrix of 0 and 1 by the row and column of each 1."""

    rows: np.ndarray
    columns: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns], minlength=self.shape[0])

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Of the values of the rows that have a column."""
        return np.bincount(self.columns, weights=v[self.rows], minlength=self.shape[1])


def presence(x: np.ndarray) -> Presence:
    return Presence(*np.nonzero(x), x.shape)


def fit_ordinal(x: Presence, grade: np.ndarray, features: tuple[str, ...] = (), grades: int | None = None) -> OrdinalModel:
    """Penalised maximum likelihood by Adam steps. grade: 0 .. grades - 1."""
    n, width = x.shape
    cuts = (grades or int(grade.max(initial=1)) + 1) - 1
    w, theta0, gaps = np.zeros(width), 0.0, np.zeros(max(cuts - 1, 0))
    moments = [np.zeros(width + cuts), np.zeros(width + cuts)]
    rows = np.arange(n)
    for step in range(1, STEPS + 1):
        theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        below = 1 / (1 + np.exp(np.clip(x.times(w)[:, None] - theta[None, :], -60, 60)))  # P(grade <= k)
        full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        p = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-12)
        slope = full * (1 - full)
        high, low = slope[rows, grade + 1] / p, slope[rows, grade] / p
        g_w = x.sums(high - low) / n + PENALTY * w
        g_theta = np.array([(-(high * (grade == k)) + low * (grade == k + 1)).mean() for k in range(cuts)])
        g = np.concatenate([g_w, [g_theta.sum()], [g_theta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(cuts - 1)]])
        for m, power, keep in ((moments[0], 1, 0.9), (moments[1], 2, 0.999)):
            m *= keep
            m += (1 - keep) * g**power
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, theta0, gaps = w - move[:width], theta0 - move[width], gaps - move[width + 1 :]
    return OrdinalModel(features, w, theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, label and text of at most ``per_class`` labelled documents of each class.

    The rows with the least hashes of doc_id are taken; only those below a limit that follows from the
    class's size are ranked, so that no task holds a class. A doc_id labelled more than once counts with
    its highest label; rows without id or label don't count.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    one = materialize(one.withColumn("h", F.xxhash64("doc_id")), "labels")
    # hashes are even: those below the limit are about per_class rows of each class, with a margin of eight deviations
    sizes = one.groupBy("label").agg(F.count("*").alias("n"))
    limit = per_class + 8 * math.sqrt(per_class)
    low = one.join(F.broadcast(sizes), "label").filter((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= limit)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    chosen = low.withColumn("r", rank).filter(F.col("r") <= per_class).select("doc_id", "label")
    texts = docs.select("doc_id", F.col("text")).join(F.broadcast(chosen), "doc_id")  # at most per_class rows a class
    return texts.groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def choose_features(sample: DataFrame) -> list[str]:
    """The features that tell label 0 from the others, best first by chi-squared; bounded by the words of the sample."""

    def count(cols: list[list]) -> Iterator[dict[str, list]]:
        seen: dict[str, list[int]] = {}
        for label, text in zip(*cols, strict=True):
            for f in {f for w in text_words(text) for f in word_features(w)}:
                seen.setdefault(f, [0, 0])[label > 0] += 1
        yield {"feature": list(seen), "n0": [v[0] for v in seen.values()], "n1": [v[1] for v in seen.values()]}

    counted = map_batches(sample.select("label", utf8("text").alias("text")), count, "feature string, n0 bigint, n1 bigint")
    n0, n1 = (sample.filter(c).count() for c in ("label = 0", "label > 0"))
    by = counted.groupBy("feature").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).filter(F.col("a") + F.col("b") >= MIN_DOCS)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = (a * (n1 - b) - b * (n0 - a)) ** 2 * (n0 + n1) / F.greatest((a + b) * (n0 + n1 - a - b) * float(n0) * n1, F.lit(1.0))
    top = by.select("feature", chi2.alias("chi2")).filter(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "feature")
    return [r.feature for r in top.collect()]


def fit_severity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> OrdinalModel:
    """A model of severity from labels.

    Labels of more than two values are grades as they are. From 0 and 1 three grades are made: 0 stays;
    a positive row has grade 2 where it shows more of the chosen features than the median positive row.
    With no rows of one class, or no feature that tells, the model has no weights and calls nothing toxic.
    """
    sample = materialize(labelled_sample(docs, labels, label, per_class), "labelled")
    features = tuple(choose_features(sample))
    number = {f: k for k, f in enumerate(features)}

    def encode(cols: list[list]) -> Iterator[dict[str, list]]:
        yield {"label": cols[0], "x": [sorted({number[f] for w in text_words(t) for f in word_features(w) if f in number}) for t in cols[1]]}

    rows = map_batches(sample.select("label", utf8("text").alias("text")), encode, "label int, x array<int>").toArrow().combine_chunks()
    grade = rows.column("label").to_numpy().astype(np.int64)
    if not features or not len(grade) or grade.min() == grade.max():
        return OrdinalModel((), np.zeros(0), np.array([60.0, 61.0]))
    shown = rows.column("x").combine_chunks().value_lengths().to_numpy()
    columns = rows.column("x").combine_chunks().flatten().to_numpy()
    x = Presence(np.repeat(np.arange(len(grade)), shown), columns, (len(grade), len(features)))
    if grade.max() == 1:
        grade = grade + (grade * (shown > np.median(shown[grade == 1]))).astype(np.int64)
    return fit_ordinal(x, grade, features)


class WordIndex(dict):
    """Feature numbers by word; a bounded memory of each worker's task."""

    def __init__(self, features: tuple[str, ...]):
        super().__init__()
        self.number = {f: k for k, f in enumerate(features)}

    def __missing__(self, word: bytes) -> tuple[int, ...] | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = tuple(self.number[f] for f in word_features(word) if f in self.number) or None
        return found


def score_texts(texts: list[bytes], model: OrdinalModel, index: WordIndex) -> np.ndarray:
    w = model.weights
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        if hit := {i for ids in map(index.__getitem__, text_words(text)) if ids for i in ids}:
            out[k] = w[sorted(hit)].sum()
    return out


def score_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Per document row: expected_severity, p_toxic (a grade above 0), grade (most probable) and toxic.

    Null and empty texts have no features and score as such; repeated rows score alike; a null doc_id stays.
    Texts may be of any length. Other columns are left out, so that none can clash. An empty table gives no rows.
    """

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        index = _index(model)
        above = model.above(score_texts(cols[1], model, index))
        full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        yield {"doc_id": cols[0], "expected_severity": above.sum(axis=1).tolist(), "p_toxic": above[:, 0].tolist(), "grade": (full[:, :-1] - full[:, 1:]).argmax(axis=1).tolist(), "toxic": (above[:, 0] >= CUT).tolist()}

    return map_batches(docs.select("doc_id", utf8("text").alias("text")), run, "doc_id bigint, expected_severity double, p_toxic double, grade int, toxic boolean")


def _index(model: OrdinalModel) -> WordIndex:
    return held(("words", model.features), lambda: WordIndex(model.features))


@any_names()
def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't call toxic. Rows are dropped where they lie.

    Null and empty texts show no features and stay; null ids and repeated rows are judged by their text alone,
    which may be of any length. Columns of any name stay as they are. An empty table gives no rows.
    """
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8") for t in batch.column(at).to_pylist()]
            toxic = model.above(score_texts(texts, model, _index(model)))[:, 0] >= CUT
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(run, docs.schema)
