"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Words are runs of ASCII letters (case folded), digits and non-ASCII characters. A pattern is ten
consecutive words of an item, or all words of a shorter one. Each text is scanned once per automaton;
hits are mapped back to word numbers and, on request, to character offsets of the original text.

The benchmark is a query set against all rows: it is read in blocks of at most ``block_items`` items
and ``block_bytes`` bytes, each block a separate automaton that the workers build from a broadcast of
that size. More items than a block holds mean more blocks, never a larger broadcast or dropped items.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import any_names, held, map_batches, utf8

WINDOW_WORDS = 10
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8_000_000

#: ASCII letters folded, other ASCII characters to blanks; bytes of non-ASCII characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: ``places`` are the hit words' characters in the original text, start and end; null unless asked for.
FOUND = "doc_id bigint, digest bigint, n_words bigint, hits array<int>, items array<bigint>, places array<struct<w: int, s: int, e: int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_windows(text: bytes, window: int = WINDOW_WORDS) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else set()


class WindowScanner:
    """All windows of a block of items in one automaton; texts are matched on whole words."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW_WORDS):
        import ahocorasick

        owners: dict[bytes, set] = {}
        for item_id, text in items:
            for w in item_windows(text, window):
                owners.setdefault(w, set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, len(w) + 1, tuple(i for i in ids if i is not None)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Numbers of the hit words, and the items found."""
        if self.empty or not words:
            return np.zeros(0, np.int64), set()
        line = f" {b' '.join(words).decode('latin-1')} "
        ends, sizes, items = [], [], set()
        for end, (n, _, ids) in self.automaton.iter(line):
            ends.append(end)
            sizes.append(n)
            items.update(ids)
        if not ends:
            return np.zeros(0, np.int64), items
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(blanks, np.asarray(ends))  # the blank that closes word number last - 1
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, last - np.asarray(sizes), 1)
        np.add.at(edge, last, -1)
        return np.flatnonzero(np.cumsum(edge)[:-1]), items


def word_places(text: bytes, hits: list[int]) -> list[tuple[int, int, int]]:
    """Number, first character and end in the original text of each hit word."""
    flags = np.frombuffer(text, np.uint8)
    word = np.frombuffer(FOLD, np.uint8)[flags] != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    chars = np.concatenate([[0], np.cumsum((flags & 0xC0) != 0x80)])  # bytes before -> characters before
    return list(zip(hits, chars[starts[hits]].tolist(), chars[ends[hits]].tolist(), strict=True))


def runs_of(places: list) -> list[tuple[int, int]]:
    """Character spans [start, end) of runs of consecutive words."""
    spans: list[tuple[int, int]] = []
    before = None
    for p in sorted(places, key=lambda p: p["w"]):
        if before == p["w"] - 1:
            spans[-1] = (spans[-1][0], p["e"])
        else:
            spans.append((p["s"], p["e"]))
        before = p["w"]
    return spans


def item_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark in blocks of bounded size; one partition at a time comes to the driver."""
    block, held = [], 0
    for item_id, text in benchmark.select("item_id", utf8("text")).toLocalIterator():
        if block and (len(block) >= block_items or held + len(text) > block_bytes):
            yield block
            block, held = [], 0
        block.append((item_id, bytes(text)))
        held += len(text)
    if block:
        yield block


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, with_places: bool = False) -> DataFrame:
    """Per document row: ``n_words``, the numbers of hit words, the ids of items found, and ``places`` if asked for.

    Null texts have no words. An item without an id counts for hits, but is not listed. Items or
    documents that repeat change nothing; a repeated document row is answered each time, rows that share a
    doc_id are told apart by their text. Texts may be of any length. Other columns are left out, so that
    none can clash. With an empty benchmark nothing is hit; an empty table gives no rows.
    """
    rows = docs.select("doc_id", utf8("text").alias("text")).withColumn("digest", F.xxhash64("text"))
    scan = lambda block: _scan_block(rows, block, window, with_places)
    blocks = [scan(block) for block in item_blocks(benchmark, block_items, block_bytes)] or [scan([])]
    found = blocks[0]
    if len(blocks) > 1:
        more = reduce(DataFrame.union, blocks[1:]).filter(F.size("hits") > 0)
        key, lists = ["doc_id", "digest"], ["hits", "items", *["places"] * with_places]
        # repeated rows are equal sets of a block, so that a group has at most a row for each block
        more = more.groupBy(*key).agg(*(F.array_distinct(F.flatten(F.collect_set(c))).alias(f"more_{c}") for c in lists))
        both = found.alias("a").join(more.alias("b"), (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a.digest") == F.col("b.digest")), "left")
        kinds = dict(found.dtypes)
        merged = [F.sort_array(F.array_union(F.col(f"a.{c}"), F.coalesce(F.col(f"b.more_{c}"), F.array().cast(kinds[c])))).alias(c) for c in lists]
        found = both.select("a.doc_id", "a.n_words", *merged)
    return found.select("doc_id", "n_words", "hits", "items", *["places"] * with_places)


def _scan_block(rows: DataFrame, block: list[tuple[int | None, bytes]], window: int, with_places: bool = False) -> DataFrame:
    shared, key = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        scanner = held(key, lambda: WindowScanner(shared.value, window))
        for lo in range(0, len(cols[0]), 500):
            doc_ids, texts, digests = (c[lo : lo + 500] for c in cols)
            found = [(len(words), *scanner.scan(words)) for words in map(words_of, texts)]
            hits = [x[1].tolist() for x in found]
            places = [[dict(zip("wse", p, strict=True)) for p in word_places(t, h)] if h else [] for t, h in zip(texts, hits, strict=True)] if with_places else [None] * len(hits)
            yield {"doc_id": doc_ids, "digest": digests, "n_words": [x[0] for x in found], "hits": hits, "items": [sorted(x[2]) for x in found], "places": places}

    return map_batches(rows, run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Per document row: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    ``items_sha256`` is the digest of the found ids, sorted as strings and joined with commas; of the
    empty string where none is found.
    """
    listed = F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",")
    return find_windows(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@any_names()
def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window occurs. The scan drops rows where they lie.

    With a benchmark of several blocks each block scans what the ones before it have kept. Null and empty
    texts hold none and stay, as do null ids, repeated rows and columns of any name; texts may be of any
    length. An empty benchmark drops nothing; an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def drop(rows: DataFrame, block: list[tuple[int | None, bytes]]) -> DataFrame:
        shared, key = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scan = held(key, lambda: WindowScanner(shared.value, window)).scan
                keep = [t is None or not len(scan(words_of(t.encode("utf-8")))[0]) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for block in item_blocks(benchmark):
        docs = drop(docs, block)
    return docs


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Character spans of the hit words in the original texts: doc_id, start_at, end_at.

    The scan that finds the words maps them, so that rows need no key: each row with hits gives its own
    spans, also where a doc_id is null, or repeated with the same or another text. Documents without hits, null and
    empty ones give no rows. Other columns are left out, so that none can clash.
    """
    found = find_windows(docs, benchmark, window, with_places=True).filter(F.size("hits") > 0)

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        rows = [(d, a, b) for d, places in zip(*cols, strict=True) for a, b in runs_of(places)]
        yield {"doc_id": [x[0] for x in rows], "start_at": [x[1] for x in rows], "end_at": [x[2] for x in rows]}

    return map_batches(found.select("doc_id", "places"), run, "doc_id bigint, start_at int, end_at int")
