"""Groups of spelling variants: words one code point apart, found by a rare-first prefix filter on bigrams.

Bigrams are ordered by how many words hold them, rarest first, ties by the bigram. One edit touches at most two
bigrams of a word, so of two words one edit apart each has, among its three rarest places in that order, one
that the other has too, at most one place off: words meet at these three only. Where they meet, the edit lies
wholly on one side of the shared bigram and the other side is equal, so a word's key at a place is the bigram
with all before it, or with all after it; that makes the limit on positions part of an equality join.
Pairs that meet are verified. Keys of more than KEY_WORDS words are cut further, exactly: the side that may
differ is joined by its single deletions, where every group holds true neighbours only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import join_counted, map_batches, materialize, utf8

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TYPO_ROWS = 97
MIN_LETTERS, MIN_TIMES = 5, 3
#: Bigrams of a word that it is found by: two more than one edit can touch on either side, less one.
PREFIX = 3
#: Words of a key up to which they are compared with each other.
KEY_WORDS = 200
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 500_000


def typed_words(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts, after the rule that drops a letter from one of TYPO_ROWS words of a document."""
    opening = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word, n in Counter(RUN.findall(text.translate(LOWER))).items():
        h = zlib.crc32(word.encode("utf-8"), opening)
        if h % TYPO_ROWS == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= MIN_LETTERS:
            yield word, n


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words of at least five letters and three occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in typed_words(doc_id, text.as_py().decode("utf-8")):
                    seen[word] += n
                if len(seen) >= COUNTED_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counted = docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TIMES)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Each bigram's place in the global order; no more than 8,100, as words are of 90 letters."""
    grams = words.select(F.explode(F.expr("array_distinct(transform(sequence(1, length(word) - 1), i -> substring(word, i, 2)))")).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r.gram: k for k, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def rarest_places(word: str, order: dict[str, int]) -> list[int]:
    """Where the word's PREFIX rarest bigrams begin; equal ones from the left."""
    return [i for _, i in sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))[:PREFIX]]


def postings(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """word, key and ``start`` and ``stop`` of what may differ from other words of that key: two keys for each of its places."""

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        for lo in range(0, len(cols[0]), 5000):
            rows: dict[str, list] = {"word": [], "key": [], "start": [], "stop": []}
            for word in cols[0][lo : lo + 5000]:
                for i in rarest_places(word, order):
                    for side, same, start, stop in ((0, word[: i + 2], i + 2, len(word)), (1, word[i:], 0, i)):
                        rows["word"].append(word)
                        rows["key"].append(xxhash.xxh3_64_intdigest(same.encode("utf-8"), seed=side) - (1 << 63))
                        rows["start"].append(start)
                        rows["stop"].append(stop)
            yield rows

    return map_batches(words.select("word"), run, "word string, key bigint, start int, stop int")


def deletions(rows: DataFrame) -> DataFrame:
    """word, at, left and ``whole``: a word's open side with each of its letters left out, and as it is (at -1)."""

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        for lo in range(0, len(cols[0]), 1000):
            out: dict[str, list] = {"word": [], "at": [], "left": []}
            for word, key, start, stop in zip(*(c[lo : lo + 1000] for c in cols), strict=True):
                side = word[start:stop]
                for at in range(-1, len(side)):
                    left = side if at < 0 else side[:at] + side[at + 1 :]
                    out["word"].append(word)
                    out["at"].append(at)
                    out["left"].append(xxhash.xxh3_64_intdigest(left.encode("utf-8"), seed=key & (1 << 64) - 1) - (1 << 63))
            yield out

    return map_batches(rows.select("word", "key", "start", "stop"), run, "word string, at int, left bigint")


def near_pairs(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """a and b: all pairs of distinct ``word`` values, a before b, that differ by one inserted, deleted or replaced letter.

    ``words`` must be a written table of distinct words of two letters at least and five to be found surely.
    """
    order = bigram_order(words)
    found = materialize(postings(words, order), "postings")
    counts = materialize(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    rows = materialize(join_counted(found, counts, "key", "n", found.count()), "shared")
    small = rows.filter(F.col("n") <= key_words).select("key", "word")
    side = lambda df, name, *keys: df.select(*keys, F.col("word").alias(name))
    one_apart = F.levenshtein("a", "b", 1) == 1
    met = side(small, "a", "key").join(side(small, "b", "key"), "key").filter(F.col("a") < F.col("b"))
    cut = materialize(deletions(rows.filter(F.col("n") > key_words)), "deletions")
    replaced = side(cut.filter("at >= 0"), "a", "left", "at").join(side(cut.filter("at >= 0"), "b", "left", "at"), ["left", "at"]).filter(F.col("a") < F.col("b"))
    longer = side(cut.filter("at < 0"), "x", "left").join(side(cut.filter("at >= 0"), "y", "left"), "left")
    longer = longer.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = [p.select("a", "b").filter(one_apart) for p in (met, replaced, longer)]
    return pairs[0].union(pairs[1]).union(pairs[2]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all rows of ``forms`` (word, form): forms are followed to the one that has no form itself.

    Level by level from the roots, so that a join meets only the words near one word, never a whole tree. A form's
    n is at least twice its word's, so there are no circles and no more levels than bits of a count.
    """
    top = forms.select(F.col("form").alias("word")).distinct().join(forms.select("word"), "word", "left_anti")
    level = materialize(top.withColumn("root", F.col("word")), "level")
    waiting, done = forms, None
    while True:
        level = materialize(waiting.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "level")
        if level.isEmpty():
            return done if done is not None else level
        done = level if done is None else done.unionByName(level)
        waiting = materialize(waiting.join(level.select("word"), "word", "left_anti"), "waiting")


def group_variants(docs: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of five letters and three occurrences.

    Words are runs of ASCII and Latin-1 letters, ASCII capitals lowered; null and empty texts have none. Where
    TYPO_ROWS divides the CRC of doc_id (nothing for null) and word, that word lacks a letter in that row.
    Repeated rows count each for itself. A word's form is its near word of largest n, of equal ones the smallest
    by code points, if that has twice its own n. Texts may be of any length; other columns are left out. An empty
    table gives no rows.
    """
    words = materialize(word_counts(docs), "words")
    pairs = near_pairs(words, key_words)
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("word", "other")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # the smallest struct: of the largest n, the first word
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = materialize(both.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    near = words.join(near, "word", "left")
    taken = -F.col("best.less") >= 2 * F.col("n")
    rows = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(materialize(rows.filter("form is not null").select("word", "form"), "edges"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
