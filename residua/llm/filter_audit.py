"""How filters interact: what each removes at each place of each order, by a packed bitmap index.

One pass over the texts gives each row a few bits and a hash; texts are never shuffled. Rows of equal texts
and labels meet by key, hot ones in place. A task then packs its rows into NumPy bitsets: one for each
filter's failures, one for each label, one for each part, a part's cut to the bytes that it has bits in.
What stays after a set of filters doesn't depend on their order, so a chain of AND-NOTs over the 32 sets and
popcounts under each part's bitset say all; only these counts leave the task, and are summed.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import HOT_SHARE, join_counted, map_batches, materialize, utf8

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
MARKS = re.compile(rb"[#$%&*|]")
#: Rows that a task packs at once.
CHUNK_ROWS = 1 << 18
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself, A in the lowest."""
    words = text.split()  # of bytes: at the six ASCII blanks
    codes = np.frombuffer(text, np.uint8)
    points = len(codes) - np.count_nonzero((codes & 0xC0) == 0x80)
    capitals = np.count_nonzero((codes >= 65) & (codes <= 90))
    a, b = len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words)
    c, d = 100 * capitals > MAX_CAPITALS * points, MARKS.search(text) is not None
    return a | b << 1 | c << 2 | d << 3


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's 128-bit hash as h1 and h2, and the bits of A to D of each row."""

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        hashes = [xxhash.xxh3_128_intdigest(t) for t in cols[2]]
        h1, h2 = ([(h >> shift & (1 << 64) - 1) - (1 << 63) for h in hashes] for shift in (64, 0))
        yield {"doc_id": cols[0], "part": cols[1], "h1": h1, "h2": h2, "fails": [own_failures(t) for t in cols[2]]}

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), utf8("text").alias("text"))
    return map_batches(rows, run, "doc_id bigint, part string, h1 bigint, h2 bigint, fails int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E) and labels (1 good, 2 toxic) of each row."""
    rows = materialize(scan(docs), "scanned")
    total = rows.count()
    # a group without a second id has no row that fails E; null ids are neither smaller nor larger than others
    groups = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    copies = materialize(groups.filter(F.col("least") < F.col("most")).drop("most"), "copies")
    later = F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    rows = join_counted(rows, copies, ["h1", "h2"], "n", total, "left").select("doc_id", "part", (F.col("fails") + later).alias("fails"))
    rows = materialize(rows, "failures")
    # hot ids get a fact whether they have labels or not, so that none of their rows is shuffled
    hot = rows.dropna(subset="doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_SHARE > total)
    said = (F.max((F.col("quality") == 1).cast("int")), 2 * F.max((F.col("toxic") == 1).cast("int")))
    marks = labels.dropna(subset="doc_id").groupBy("doc_id").agg(sum(F.coalesce(c, F.lit(0)) for c in said).alias("labels"))
    facts = marks.join(hot, "doc_id", "full").select("doc_id", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("n", F.lit(0)).alias("n"))
    met = join_counted(rows.dropna(subset="doc_id"), materialize(facts, "marks"), "doc_id", "n", total, "left")
    met = met.select("part", "fails", F.coalesce("labels", F.lit(0)).alias("labels"))
    return met.union(rows.filter("doc_id is null").select("part", "fails", F.lit(0)))


def subset_counts(part: np.ndarray, fails: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """Part, set of filters before, filter and its COUNTS, for rows with ``part`` numbers in ascending order.

    Bitsets cover all rows; a part's own one is cut to the bytes that hold its rows, so that the work for many
    parts is that of the rows, not of parts times rows.
    """
    failing = [np.packbits((fails >> k) & 1 == 1) for k in range(len(FILTERS))]
    good, toxic = np.packbits(labels & 1 == 1), np.packbits(labels & 2 == 2)
    everything = np.packbits(np.ones(len(fails), bool))
    alive = [everything]  # what passes a set of filters, by the set's bits
    for members in range(1, 1 << len(FILTERS)):
        top = members.bit_length() - 1
        alive.append(alive[members ^ (1 << top)] & ~failing[top])
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    full = (1 << len(FILTERS)) - 1
    popcount = lambda bits: int(np.bitwise_count(bits).sum(dtype=np.int64))
    for start, end in itertools.pairwise(edges.tolist()):
        at = slice(start // 8, (end + 7) // 8)
        inside = np.zeros(8 * (at.stop - at.start), bool)
        inside[start - 8 * at.start : end - 8 * at.start] = True
        mine = np.packbits(inside)
        left = [bits[at] & mine for bits in alive]
        for k in range(len(FILTERS)):
            fail = failing[k][at] & mine
            alone = popcount(fail & left[full ^ (1 << k)])
            for before in range(full + 1):
                if before >> k & 1:
                    continue
                gone = fail & left[before]
                counts = (popcount(left[before | 1 << k]), popcount(gone), popcount(fail & ~left[before]), alone, popcount(gone & good[at]), popcount(gone & toxic[at]))
                yield int(part[start]), before, k, counts


def count_sets(rows: DataFrame) -> DataFrame:
    """part, before, filter_no and COUNTS summed over all rows of ``judged``."""
    schema = "part string, before int, filter_no int, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            coded = table.column("part").combine_chunks().dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            fails, labels = (table.column(c).to_numpy()[order] for c in ("fails", "labels"))
            names = coded.dictionary.to_pylist()
            found = list(subset_counts(codes[order].astype(np.int64), fails, labels))
            cols = {"part": [names[f[0]] for f in found], "before": [f[1] for f in found], "filter_no": [f[2] for f in found]}
            cols |= {c: [f[3][k] for f in found] for k, c in enumerate(COUNTS)}
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(COUNTS)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)], names=list(cols))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield from packed()
                waiting, n = [], 0
        if waiting:
            yield from packed()

    found = rows.select("part", "fails", "labels").mapInArrow(run, schema)
    return found.groupBy("part", "before", "filter_no").agg(*(F.sum(c).alias(c) for c in COUNTS))


def orders(spark) -> DataFrame:
    """A row for each step of each order of the filters: filter_order, step, before, filter_no. 600 rows for five."""
    rows = [
        ("".join(FILTERS[k] for k in order), step + 1, sum(1 << k for k in order[:step]), order[step])
        for order in itertools.permutations(range(len(FILTERS)))
        for step in range(len(FILTERS))
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter_no int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley for each part, order of the filters and step, zeros included.

    The filters fail a text of under 200 words (A), of under half as many distinct words (B), of over 3 % ASCII
    capitals (C), with one of ``#$%&*|`` (D), or equal to that of a smaller doc_id (E). Parts are the values
    of ``lang``, null as the empty string. Null texts count as empty ones; a row without doc_id has no labels,
    never fails E and makes no other fail it; equal rows don't fail E for each other. A doc_id labelled more
    than once is good or toxic where any of its labels says so. Texts may be of any length. Other columns of
    either table are left out. An empty table gives no rows.
    """
    sets = materialize(count_sets(judged(docs, labels)), "sets")
    weight = F.element_at(F.array(*(F.lit(math.factorial(n) * math.factorial(len(FILTERS) - 1 - n)) for n in range(len(FILTERS)))), F.bit_count("before") + 1)
    shares = sets.groupBy("part", "filter_no").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    steps = sets.join(F.broadcast(orders(docs.sparkSession)), ["before", "filter_no"]).join(shares, ["part", "filter_no"])
    return steps.select("part", "filter_order", "step", *COUNTS, "shapley")
