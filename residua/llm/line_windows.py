"""Line dedup by overlapping windows of three lines.

Every three consecutive lines are hashed. Windows that occur more than once in the corpus stay where
they occur first, in order of doc_id and line; the lines that later occurrences cover are removed,
overlapping occurrences as one span.

A task looks at its texts in runs. What isn't the first place of a window within its run can't be the first in
the corpus, so only one place for each window of a run has to meet those of other runs: one shuffle of hashes and
positions, in which a window has at most as many rows as there are runs, however often it occurs. Texts that a
bounded bitmap tells to have nothing to cut stay where they lie; the others move once, to meet their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.common import any_names, bitmap_of, document_key, join_counted, marked, materialize

WINDOW_LINES = 3
#: Windows that a run holds before it is sorted (some 50 MB); a longer text is a run of its own.
RUN_WINDOWS = 1 << 20

PLACES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("repeat", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("line", pa.int32()), ("times", pa.int32())])


def line_key(line: str) -> bytes:
    """Lines are compared without case and without blanks at their ends, or more than one between words."""
    return " ".join(line.lower().split()).encode("utf-8")


def window_hashes(text: str, window: int = WINDOW_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Start lines of all windows in order, and their 128-bit hashes as two columns; windows of blank lines are left out."""
    keys = [line_key(x) for x in text.split("\n")]
    starts = [k for k in range(len(keys) - window + 1) if any(keys[k : k + window])]
    hashes = b"".join(xxhash.xxh3_128_digest(b"\n".join(keys[k : k + window])) for k in starts)
    return np.array(starts, np.int32), np.frombuffer(hashes, np.int64).reshape(-1, 2)


def first_places(doc_id: np.ndarray, named: np.ndarray, digest: np.ndarray, line: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """The places of a run, each once with its ``times``; those behind the first one of their window are numbered in ``repeat``."""
    order = np.lexsort((line, digest, doc_id, named, hashes[:, 1], hashes[:, 0]))
    doc_id, named, digest, line, hashes = doc_id[order], named[order], digest[order], line[order], hashes[order]
    new_window = np.ones(len(order), bool)
    new_window[1:] = (hashes[1:] != hashes[:-1]).any(axis=1)
    new_place = new_window.copy()
    for column in (named, doc_id, digest, line):
        new_place[1:] |= column[1:] != column[:-1]
    at = np.flatnonzero(new_place)
    times = np.diff(np.append(at, len(order))).astype(np.int32)
    first = new_window[at]
    columns = [
        pa.array(hashes[at, 0]), pa.array(hashes[at, 1]), pa.array(np.arange(len(at), dtype=np.int32), mask=first),
        pa.array(doc_id[at], mask=~named[at]), pa.array(digest[at]), pa.array(line[at]), pa.array(times),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=PLACES)


def places(docs: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """The places of all windows by runs: h1, h2 (the window's hash), repeat (null for the run's first place of it),
    doc_id, digest (of the text), line (of the window's start, from 0) and times (rows of the run that have this place)."""
    size = RUN_WINDOWS

    def flushed(run: list[tuple]) -> Iterator[pa.RecordBatch]:
        if run:
            lengths = [len(lines) for _, _, lines, _ in run]
            ids = np.repeat(np.array([0 if d is None else d for d, *_ in run], np.int64), lengths)
            named = np.repeat(np.array([d is not None for d, *_ in run]), lengths)
            digests = np.repeat(np.array([g for _, g, *_ in run], np.int64), lengths)
            found = first_places(ids, named, digests, np.concatenate([x for _, _, x, _ in run]), np.concatenate([h for *_, h in run]))
            for lo in range(0, len(found), 100_000):
                yield found.slice(lo, 100_000)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, n = [], 0
        for batch in batches:
            for doc_id, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, hashes = window_hashes(text, window)
                if len(lines):
                    run.append((doc_id, digest, lines, hashes))
                    n += len(lines)
                if n >= size:
                    yield from flushed(run)
                    run, n = [], 0
        yield from flushed(run)

    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text", digest("text").alias("digest"))
    return rows.mapInArrow(find, "h1 bigint, h2 bigint, repeat int, doc_id bigint, digest bigint, line int, times int")


def digest(name: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def spans_to_cut(docs: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """doc_id, digest, ``cuts``: merged spans [start, end) of lines that later occurrences cover, and ``n``: rows of that document."""
    # repeats within a run are later ones whatever else there is: their numbers spread them over the partitions
    of_window = Window.partitionBy("h1", "h2", "repeat").orderBy("doc_id", "digest", "line")
    later = places(docs, window).withColumn("rank", F.rank().over(of_window)).filter("repeat is not null or rank > 1")
    starts = later.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("line")).alias("starts"), F.sum("times").alias("places"))
    # a document's repeated rows have all places alike
    return starts.select("doc_id", "digest", merge_spans("starts", window).alias("cuts"), F.expr("places div size(starts)").alias("n"))


def merge_spans(name: str, window: int) -> Column:
    """Sorted starts of windows to disjoint spans of lines: starts and ends, each found beside its neighbour."""
    first = f"filter({name}, (x, i) -> i = 0 or x > {name}[i - 1] + {window})"
    last = f"transform(filter({name}, (x, i) -> i = size({name}) - 1 or {name}[i + 1] > x + {window}), x -> x + {window})"
    return F.expr(f"zip_with({first}, {last}, (s, e) -> named_struct('s', s, 'e', e))")


def without_spans(lines: str, cuts: str) -> Column:
    """A column of lines joined again without its spans, each line looked at once."""
    zero = F.array(F.lit(0))
    before, after = F.concat(zero, F.transform(cuts, lambda c: c.e)), F.concat(F.transform(cuts, lambda c: c.s), F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")


@any_names("n_lines", "n_cut")
def cut_lines(docs: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """All columns of ``docs``, ``text`` without the cut lines, and then ``n_lines`` and ``n_cut`` (long).

    Null texts stay null with no lines; a text of fewer lines than a window is never cut. Rows with
    the same doc_id and text are one document: they neither repeat each other nor differ in result.
    Rows with no doc_id come before all others. A text that is cut entirely becomes empty. Texts may be of
    any length. Columns of any name stay; where ``docs`` has an n_lines or n_cut, the new one has an underscore
    behind its name. An empty table gives no rows.
    """
    names = docs.columns
    key = ["unnamed", "known_id", "digest"]
    spans = spans_to_cut(docs, window).select(*document_key("doc_id", F.col("digest")), "cuts", "n")
    spans = materialize(spans.withColumn("mark", F.xxhash64(*key)), "cuts")
    rows = docs.select("*", *document_key("doc_id", digest("text")))
    rows = rows.withColumn("touched", marked(F.xxhash64(*key), bitmap_of(spans, "mark")))
    zero = F.lit(0).cast("bigint")
    split = F.split("text", "\n", -1)
    n_lines = lambda lines: F.when(F.col("text").isNull(), zero).otherwise(F.size(lines).cast("bigint")).alias("n_lines")
    whole = rows.filter("not touched").select(*names, n_lines(split), zero.alias("n_cut"))
    # a document's cuts are one row; a mark may also be another's, so that some rows meet none
    met = join_counted(rows.filter("touched"), spans.drop("mark"), key, "n", docs.count(), "left").withColumn("lines", split)
    text = F.when(F.col("cuts").isNull() | F.col("text").isNull(), F.col("text")).otherwise(without_spans("lines", "cuts")).alias("text")
    n_cut = F.coalesce(F.aggregate("cuts", zero, lambda a, c: a + c.e - c.s), zero).alias("n_cut")
    return whole.unionByName(met.select(*[text if c == "text" else F.col(c) for c in names], n_lines(F.col("lines")), n_cut))
