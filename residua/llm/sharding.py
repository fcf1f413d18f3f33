"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``VIRTUAL_NODES`` points on a ring of 64-bit hashes; a document belongs to the first
point clockwise of its own hash. A shard takes no more than its capacity: what a full shard can't take
continues clockwise to the next point whose shard has room. Capacities add up to the number of rows
and differ by one at most, so counts are equal to within one (law ``rows``), while most documents stay
where a plain ring puts them and a change of the shard count moves few others.

Only counts of ring arcs reach the driver. Their number is fixed by the shards, times a split that
follows the input so that no ranking group outgrows ``RANK_ROWS`` on average.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.common import materialize, parts_for

VIRTUAL_NODES = 64
RANK_ROWS = 200_000
#: Equal rows are laid out in runs of this many.
RUN_ROWS = 10_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Points in clockwise order and their shards."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}:{v}") - (1 << 63), s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int]]:
    """How arcs in clockwise order fill the shards: (arc, rows, shard), each arc's rows in their order.

    An arc's own shard comes first. What is left over moves clockwise, first come first served.
    """
    room, segments = list(room), []
    carried: deque[list[int]] = deque()
    over = []
    for arc, n in enumerate(counts):
        took = min(n, room[owners[arc]])
        room[owners[arc]] -= took
        if took:
            segments.append((arc, took, owners[arc]))
        over.append(n - took)
    for turn in range(2 * len(counts)):
        arc = turn % len(counts)
        while carried and room[owners[arc]]:
            took = min(carried[0][1], room[owners[arc]])
            room[owners[arc]] -= took
            segments.append((carried[0][0], took, owners[arc]))
            carried[0][1] -= took
            if not carried[0][1]:
                carried.popleft()
        if turn < len(counts) and over[arc]:
            carried.append([arc, over[arc]])
    if carried:
        raise ValueError("the shards have too little room")
    return segments


def assign_shards(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, rank_rows: int = RANK_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16; a null text has none (its checksum is that of the empty
    text). ``slot`` numbers each shard's rows from 0 without gaps. Rows are placed by the hash of
    doc_id, checksum and size; equal rows are counted first and laid out in runs, so that neither a
    null doc_id nor a repeated row gathers in one task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    points, owners = ring(shards, virtual_nodes)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = materialize(rows.withColumn("at", F.xxhash64("doc_id", "text_crc32", "size")), "rows")
    split = parts_for(rows.count(), rank_rows * len(points))

    # a place on the ring: the arc that ends at the next point, and there one of ``split`` equal parts
    @F.pandas_udf("bigint")
    def place(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        arc = np.searchsorted(points, x)
        low = np.concatenate([[-(2.0**63)], points.astype(float), [2.0**63]])
        part = np.clip((x - low[arc]) / np.maximum(low[arc + 1] - low[arc], 1) * split, 0, split - 1).astype(np.int64)
        return pd.Series(arc.astype(np.int64) * split + part)

    placed = materialize(rows.withColumn("part", place("at")), "placed")
    total_arcs = len(points) + 1  # the last one, after the last point, goes on to the first
    by_part = np.zeros(total_arcs * split, np.int64)
    longest = 1
    for part, n, most in placed.groupBy("part").agg(F.sum("n"), F.max("n")).toLocalIterator():
        by_part[part], longest = n, max(longest, most)
    total = int(by_part.sum())
    before_part = np.concatenate([[0], np.cumsum(by_part)])
    counts = by_part.reshape(total_arcs, split).sum(axis=1).tolist()
    segments = flow(counts, [*owners.tolist(), int(owners[0])], capacities(total, shards))

    # segments in order of (arc, rows there) give each row's shard by its rank over all arcs
    segments.sort(key=lambda s: s[0])
    lengths = np.array([s[1] for s in segments], np.int64)
    to_shard = np.array([s[2] for s in segments], np.int64)
    ends = np.cumsum(lengths)
    base, used = np.zeros(len(segments), np.int64), [0] * shards
    for k, (_, n, s) in enumerate(segments):
        base[k], used[s] = used[s], used[s] + n

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rank = before_part[x["part"].to_numpy()] + x["rank"].to_numpy()
            k = np.searchsorted(ends, rank, side="right")
            yield x.drop(columns=["part", "rank"]).assign(shard=to_shard[k], slot=base[k] + rank - (ends[k] - lengths[k]))

    within = Window.partitionBy("part").orderBy("at", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("rank", F.sum("n").over(within) - F.col("n"))
    runs = ranked.select("doc_id", "size", "text_crc32", "part", "rank", "n", F.explode(F.expr(f"sequence(0L, n - 1, {RUN_ROWS}L)")).alias("lo"))
    if longest > RUN_ROWS:
        runs = runs.repartition(max(spark.sparkContext.defaultParallelism, parts_for(total, 1_000_000)))
    rows = runs.select("doc_id", "size", "text_crc32", "part", "rank", F.explode(F.expr(f"sequence(lo, least(lo + {RUN_ROWS}, n) - 1)")).alias("k"))
    rows = rows.select(F.col("doc_id"), "size", "text_crc32", "part", (F.col("rank") + F.col("k")).alias("rank"))
    # doc_id travels as text: pandas has no null among integers
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = rows.mapInPandas(settle, "doc_id string, size bigint, text_crc32 bigint, shard bigint, slot bigint")
    return done.select(F.col("doc_id").cast("bigint").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
