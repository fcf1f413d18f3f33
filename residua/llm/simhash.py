"""SimHash near-duplicates found with deletion-variant signatures.

Fingerprints of 64 bits link where at most ``MAX_BITS`` = 4 bits differ. Cut into three segments, two
linked fingerprints have a segment in which at most one bit differs. Each segment is therefore
indexed under its one-wildcard variants: for every bit, the segment without it. Segments that differ
by at most one bit share a variant, so equality of keys finds every link, and each candidate is
verified on the whole fingerprint.

Only distinct fingerprints are indexed. A key that very many of them share is cut further: the bits
outside its segment also differ by 4 at most, so that of five parts of them one is equal, and each
part in turn is added to the key. Within a key's rows links are followed as a search that
drops what it has reached, and only the edges of a spanning forest of all that a task has seen leave it: a
family of close copies costs about its size, not its square. Components come from the edges by alternating
large and small stars. Labels of stars and components with very many members are broadcast, as these are few;
everything about documents stays distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.common import any_names, bitmap_of, discard, document_key, join_counted, map_batches, marked, materialize, parts_for, utf8

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Three segments: 4 differing bits leave one of them with one at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
KEYS_PER_PART = 1_000_000
#: A key that more fingerprints than this may share is cut further.
HOT_ROWS = 8_000
#: Rows of a key that are compared side by side with all other keys' rows; larger ones are searched one by one.
SMALL_ROWS = 24


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """Bit b is set where over half of the shingles' hashes have it; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = starts + sizes
    n = max(1, len(words) - words_each + 1)
    last = ends[words_each - 1 :] if len(words) >= words_each else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    starts_l, last_l = starts[:n].tolist(), last.tolist()
    for lo in range(0, n, 65_536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts_l[lo : lo + 65_536], last_l[lo : lo + 65_536], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and fp (64 bits as a signed long) of each row. Null and empty texts have zero."""

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        found = np.array([fingerprint(t) for t in cols[1]], np.uint64).view(np.int64)
        yield {"doc_id": cols[0], "digest": cols[2], "fp": found.tolist()}

    return map_batches(docs.select("doc_id", utf8("text").alias("text"), digest("text").alias("digest")), run, "doc_id bigint, digest bigint, fp bigint")


def digest(name: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def segment_of(fp: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def wildcard_keys(fp: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Every fingerprint's variants: a key for each bit, and the fingerprint beside each key.

    The bits of a key are the segment with one bit cleared, and above them the number of that bit in
    the fingerprint, which also tells the segment. Where one of the two values of the segment that
    the key stands for is ``hot`` (a flag for each value of each segment), five keys take its place:
    each adds the number and the bits of one part of what lies outside the segment.
    """
    fp = fp.view(np.uint64)
    keys, owners = [], []
    base = 0
    for shift, width in SEGMENTS:
        segment = segment_of(fp, shift, width)
        for bit in range(width):
            key = (segment & ~np.uint64(1 << bit)) | np.uint64((shift + bit) << 32)
            if hot is None:
                keys.append(key)
                owners.append(fp)
                continue
            many = hot[base + segment.astype(np.int64)] | hot[base + (segment ^ np.uint64(1 << bit)).astype(np.int64)]
            keys.append(key[~many])
            owners.append(fp[~many])
            if many.any():
                some, rest = fp[many], outside(fp[many], shift, width)
                for part in range(MAX_BITS + 1):
                    lo, hi = ((64 - width) * k // (MAX_BITS + 1) for k in (part, part + 1))
                    keys.append(key[many] | np.uint64((part + 1) << 38) | segment_of(rest, lo, hi - lo) << np.uint64(41))
                    owners.append(some)
        base += 1 << width
    return np.concatenate(keys).view(np.int64), np.concatenate(owners).view(np.int64)


def outside(fp: np.ndarray, shift: int, width: int) -> np.ndarray:
    """The bits of a fingerprint but those of one segment, side by side."""
    low = fp & np.uint64((1 << shift) - 1)
    return low if shift + width == 64 else low | fp >> np.uint64(shift + width) << np.uint64(shift)


def hot_segments(distinct_fp: DataFrame, hot_rows: int) -> np.ndarray | None:
    """A flag for each value of each segment that over half of ``hot_rows`` fingerprints have; null where none has.

    The flags' number is fixed by the segments' widths (8 million), whatever the input.
    """
    values = []
    base = 0
    for shift, width in SEGMENTS:
        values.append(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(base))
        base += 1 << width
    counts = distinct_fp.select(F.explode(F.array(*values)).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    flags = np.zeros(base, bool)
    for (at,) in counts.filter(F.col("n") > hot_rows // 2).select("at").toLocalIterator():
        flags[at] = True
    return flags if flags.any() else None


def forest(key: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within each key's rows; no edge joins what others join already, by whatever key.

    Large groups are searched from a fingerprint outwards; what is reached leaves the group. Small
    ones are compared side by side, all groups at once.
    """
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order].view(np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(cuts)
    names, node = np.unique(fp, return_inverse=True)
    parent, out_a, out_b = list(range(len(names))), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
                out_a.append(i)
                out_b.append(j)

    small = np.repeat(sizes <= SMALL_ROWS, sizes)
    k, f, at = key[small], fp[small], node[small]
    for lag in range(1, SMALL_ROWS):
        if len(k) <= lag or not len(same := np.flatnonzero(k[lag:] == k[:-lag])):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + lag]) <= max_bits]
        link(at[near], at[near + lag])
    for g in np.flatnonzero(sizes > SMALL_ROWS).tolist():
        left = np.unique(node[cuts[g] : cuts[g + 1]])
        values = names[left]
        while len(left):
            edge, left, values = [left[0]], left[1:], values[1:]
            while edge and len(left):
                here = edge.pop()
                near = np.bitwise_count(values ^ names[here]) <= max_bits
                if near.any():
                    reached = left[near]
                    link(np.full(len(reached), here), reached)
                    edge.extend(reached)
                    left, values = left[~near], values[~near]
    a, b = names[np.array(out_a, np.int64)], names[np.array(out_b, np.int64)]
    return np.minimum(a, b).view(np.int64), np.maximum(a, b).view(np.int64)


def near_edges(distinct_fp: DataFrame, rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links between different fingerprints, enough to join each component: a, b."""
    flags = hot_segments(distinct_fp, hot_rows) if rows > hot_rows // 2 else None
    shared = None if flags is None else distinct_fp.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = None if shared is None else np.unpackbits(shared.value).view(bool)
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(all_fp), 4096):
                key, fp = wildcard_keys(all_fp[lo : lo + 4096].copy(), hot)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            key, fp = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in (0, 1))
            a, b = forest(key, fp)
            for lo in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])], names=["a", "b"])

    keys = distinct_fp.mapInArrow(expand, "key bigint, fp bigint")
    each = 64 if flags is None else 64 * (MAX_BITS + 1)  # keys of a fingerprint at most
    parts = max(2 * distinct_fp.sparkSession.sparkContext.defaultParallelism, parts_for(each * rows, KEYS_PER_PART))
    return keys.repartition(parts, "key").mapInArrow(link, "a bigint, b bigint").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """Component label of each node that has an edge: node, label (the smallest node as a signed long).

    Alternates large stars and small stars until nothing changes. Each round is written to the shared
    folder, so that no lineage grows and a lost executor costs a round at most; the one before it goes.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    before = (edges.count(), None)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"), F.count("*").alias("n"))
        large = join_counted(both, low, "a", "n", 2 * before[0]).filter(F.col("b") > F.col("a"))
        down = materialize(large.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct(), "stars")  # each b is below its a
        low = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = join_counted(down, low, "a", "n", 2 * before[0]).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        old, edges = edges, materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(old)
        discard(down)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def classes(prints: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """fp, its number of rows ``n``, and ``first``: the least (doc_id, digest) of its component, rows without doc_id last."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    known = materialize(prints.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")), "distinct")
    rows = known.count()
    edges = near_edges(known.select("fp"), rows, hot_rows)
    labels = materialize(star_components(edges).join(known, F.col("node") == F.col("fp")).select("fp", "label", "first"), "labels")
    least = labels.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("members"))
    linked = join_counted(labels.select("fp", "label"), least, "label", "members", rows).select("fp", "least")
    return known.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, fingerprint (hex) and component_id.

    ``component_id`` is the smallest doc_id that links lead to, its own included. Null and empty
    texts have fingerprint zero and link like any other. Rows without doc_id link others, but only
    name a component where no row of it has one (then null). Repeated rows are each returned. Texts may
    be of any length. Other columns are left out, so that none can clash; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    found = materialize(classes(prints), "classes")
    rows = join_counted(prints, found, "fp", "n", prints.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


@any_names()
def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps one: the document of its smallest doc_id.

    Rows without doc_id are kept where a component has no other. Of repeated rows (one doc_id and text)
    one is kept, of rows that share a doc_id but not a text each is its own document. Null and empty texts
    are one component. Columns of any name stay as they are; an empty table gives no rows.

    What is dropped is decided on ids. Rows that no mark of a bounded bitmap tells to be dropped or repeated
    stay where they lie; only the others are shuffled, to be compared with the exact list.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    found = materialize(classes(prints), "classes")
    rows = join_counted(prints, found, "fp", "n", prints.count())
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    # a row for each document with copies of itself, and for each one to drop
    fate = rows.groupBy("doc_id", "digest").agg(F.first(own).alias("keep"), F.count("*").alias("n")).filter("n > 1 or not keep")
    fate = materialize(fate.withColumn("mark", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "digest")), "fate")
    own, key = document_key("doc_id", digest("text")), ["unnamed", "known_id", "digest"]
    named = docs.select("*", *own)
    named = named.withColumn("touched", marked(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "digest"), bitmap_of(fate, "mark")))
    facts = fate.select(*document_key("doc_id", F.col("digest")), "keep", "n")
    met = join_counted(named.filter("touched"), facts, key, "n", docs.count(), "left").filter(F.coalesce("keep", F.lit(True)))
    return named.filter("not touched").select(*docs.columns).unionByName(met.dropDuplicates(key).select(*docs.columns))
