"""New FASTA files as a stream: parsed and scored as they arrive, and ids that were not seen before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from residua.sources import datasource
from residua.sources.fasta import parse_records, suffix_glob

#: How long an id is remembered after it was last met.
KEPT_DAYS = 30
FIRST_SEEN = "file_path string, id string, block bigint, n bigint"


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """file_path, id, description, sequence of records of files that come to ``folder``.

    A stream has no record numbers; the mark of a file's first record is taken off where it is.
    """
    rows = spark.readStream.option("lineSep", "\n>").option("recursiveFileLookup", True).option("pathGlobFilter", suffix_glob()).text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace("value", "^>", "").alias("value"))
    return parse_records(rows).drop("value")


def score_stream(sequences: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there through ``score`` to Parquet files, then stops; run again, it takes what is new."""
    return score(sequences).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen_ids(spark: SparkSession, folder: str, kept_days: float = KEPT_DAYS, **options) -> DataFrame:
    """file_path, id, block and n of the first header of each id of a file, as files come to ``folder`` or grow.

    An id has a state of its own below the query's checkpoint, so that no later batch and no restart gives it again;
    one that isn't met for ``kept_days`` is forgotten. ``block`` and ``n`` order a file's ids. Headers without an id
    are left out. ``options`` are the data source's.
    """
    datasource.register(spark)
    reader = spark.readStream.format("fasta").option("what", "headers")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    keep = int(kept_days * 86_400_000)

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        places = [min(zip(p.block.tolist(), p.n.tolist(), strict=True)) for p in parts if len(p)]
        if not state.exists and places:
            block, n = min(places)
            yield pd.DataFrame({"file_path": [key[0]], "id": [key[1]], "block": [block], "n": [n]})
        state.update((1,))
        state.setTimeoutDuration(keep)

    rows = reader.load(folder).filter("id <> ''")
    return rows.groupBy("file_path", "id").applyInPandasWithState(first, FIRST_SEEN, "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)
