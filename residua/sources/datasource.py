"""FASTA as a Spark data source: ``spark.read.format("fasta")``, ``readStream`` and ``write``.

Files are read by ranges of bytes, block-gzip files too (``ranges.py``). Filters on file_path leave out ranges, those
on id leave out records before their sequences are made. Unlike Spark's own readers this one reads files whose
names begin with ``_`` or ``.``, and keeps the records before an error unless told to fail.
"""

from __future__ import annotations

import gzip
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from residua.sources import ranges
from residua.sources.fasta import BROADCAST_BLOCKS, SUFFIXES

SPLIT_BYTES = 64 << 20
BATCH_RECORDS, BATCH_BYTES = 2000, 8 << 20
#: ``block`` is where a record's range begins, ``n`` its number there; ``offset`` the place of its mark, null in compressed files.
RECORD = "file_path string, block bigint, n bigint, offset bigint, id string, description string, sequence string"
COUNT = "file_path string, block bigint, records bigint"
INDEX = "file_path string, id string, offset bigint, bytes bigint, body bigint, letters bigint, line_letters int, line_bytes int"
HEADER = "file_path string, block bigint, n bigint, id string"
SCHEMAS = {"records": RECORD, "headers": HEADER, "counts": COUNT, "index": INDEX}


def matches(name: str, upper: bool) -> bool:
    return name.endswith(SUFFIXES) or upper and any(name.endswith(s.upper()) for s in SUFFIXES)


def public_path(path: str) -> str:
    """As Spark names files."""
    return "file://" + path if path.startswith("/") else path


def files_of(options: dict) -> list[tuple[str, int]]:
    """Paths and sizes of all files below ``path`` that have a sequence suffix (``suffixes`` names others, ``upper`` false is strict), or of one file."""
    out = []
    own = tuple(s for s in options.get("suffixes", "").split(",") if s)
    upper = options.get("upper", "true").lower() == "true"
    for path in json.loads(options["path"]) if options["path"].startswith("[") else [options["path"]]:
        system, inner = ranges.open_system(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            out.append((path, info.size))
        elif info.type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(inner, recursive=True)):
                if f.type == fs.FileType.File and (f.base_name.endswith(own) if own else matches(f.base_name, upper)):
                    out.append((f.path if isinstance(system, fs.LocalFileSystem) else f"{path.split('://')[0]}://{f.path}", f.size))
        else:
            raise FileNotFoundError(path)
    return sorted(set(out))


@dataclass
class RangePartition(InputPartition):
    range: ranges.Range


def batches(rows: Iterator[tuple], schema: str, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded number and of bounded size of column ``weight``."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])
    waiting, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), fields, strict=True)], schema=fields)

    for row in rows:
        waiting.append(row)
        size += len(row[weight] or "") if weight >= 0 else 0
        if len(waiting) >= BATCH_RECORDS or size >= BATCH_BYTES:
            yield out()
            waiting, size = [], 0
    if waiting:
        yield out()


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.what = self.options.get("what", "records")
        self.ids: set | None = None
        self.paths: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo | EqualNullSafe) else set(f.value) if isinstance(f, In) else None
            if self.what != "counts" and values is not None and f.attribute == ("id",):
                self.ids = values if self.ids is None else self.ids & values
            elif f.attribute == ("file_path",) and isinstance(f, EqualTo | EqualNullSafe | In | StringStartsWith):
                self.paths.append(f)
            else:
                yield f

    def taken(self, path: str) -> bool:
        p = public_path(path)
        return all(p.startswith(f.value) if isinstance(f, StringStartsWith) else p in (f.value if isinstance(f, In) else (f.value,)) for f in self.paths)

    def partitions(self) -> list[RangePartition]:
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        out = []
        for path, size in files_of(self.options):
            if self.taken(path):
                system, inner = ranges.open_system(path)
                out += [RangePartition(ranges.Range(path, r.start, r.end, r.kind)) for r in ranges.ranges_of(system, inner, size, split)]
        return out

    def found(self, r: ranges.Range) -> Iterator[tuple[int | None, bytes]]:
        system, inner = ranges.open_system(r.path)
        try:
            yield from ranges.read_range(system, ranges.Range(inner, r.start, r.end, r.kind))
        except (OSError, EOFError, ranges.zlib.error) as e:
            if self.options.get("onerror", "skip") == "fail":
                raise
            print(f"Warning: {r.path} from byte {r.start}: {e}", file=sys.stderr)

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        r = partition.range
        path = public_path(r.path)
        if self.what == "counts":
            return batches(iter([(path, r.start, sum(1 for _ in self.found(r)))]), COUNT, -1)
        if self.what == "headers":
            named = ((n, ranges.parts_of(text)[0]) for n, (_, text) in enumerate(self.found(r)))
            return batches(((path, r.start, n, i) for n, i in named if self.ids is None or i in self.ids), HEADER, -1)
        if self.what == "index":
            return batches(self.places(r, path), INDEX, -1)
        return batches(self.rows(r, path), RECORD, 6)

    def rows(self, r: ranges.Range, path: str) -> Iterator[tuple]:
        for n, (offset, text) in enumerate(self.found(r)):
            id_, description, body = ranges.parts_of(text)
            if self.ids is None or id_ in self.ids:
                yield path, r.start, n, offset, id_, description, ranges.clean(body)

    def places(self, r: ranges.Range, path: str) -> Iterator[tuple]:
        if r.kind != "plain":
            raise OSError(f"{r.path}: only plain files have an index")
        for offset, text in self.found(r):
            id_, _, body = ranges.parts_of(text)
            if self.ids is None or id_ in self.ids:
                yield path, id_, offset, len(text) + 1, offset + 1 + len(text) - len(body), *ranges.layout(body)


class FastaStream(DataSourceStreamReader):
    """Files that come, and what is appended to plain ones; an offset is the sizes of the files that were read."""

    def __init__(self, options: dict):
        self.reader = FastaReader({**options, "onerror": "fail"})
        if self.reader.what not in ("records", "headers"):
            raise ValueError("a stream has records or headers")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(files_of(self.reader.options))

    def partitions(self, start: dict, end: dict) -> list[RangePartition]:
        split = int(self.reader.options.get("splitbytes", SPLIT_BYTES))
        out = []
        for path, size in sorted(end.items()):
            system, inner = ranges.open_system(path)
            done = start.get(path, 0)
            for r in ranges.ranges_of(system, inner, size, split) if size > done else []:
                if done and r.kind != "plain":
                    raise OSError(f"{path} is compressed and has grown")
                # what is appended begins with a mark; the line break before it is the last byte read before
                if r.end > done:
                    out.append(RangePartition(ranges.Range(path, max(r.start, done - 1, 0), r.end, r.kind)))
        return out

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    path: str


class FastaWriter(DataSourceArrowWriter):
    """A file for each partition, hidden until all are whole. ``compression`` is none, gzip or blocks."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.kind = options.get("compression", "none")
        if self.kind not in ("none", "gzip", "blocks"):
            raise ValueError(f"compression {self.kind} is none of none, gzip and blocks")
        self.suffix = options.get("suffix", ".fasta")
        self.token = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = ranges.open_system(self.folder)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.token}{self.suffix}{'' if self.kind == 'none' else '.gz'}"
        hidden = f"{folder}/_{name}.{task.taskAttemptId()}"
        raw = system.open_output_stream(hidden, compression=None)
        out = ranges.BlockGzip(raw) if self.kind == "blocks" else gzip.GzipFile(fileobj=raw, mode="wb") if self.kind == "gzip" else raw
        for batch in iterator:
            for row in batch.to_pylist():
                head = " ".join(x for x in (row["id"], row.get("description")) if x)
                out.write(f">{head}\n{row['sequence'] or ''}\n".encode())
        out.close()
        if not raw.closed:
            raw.close()
        return Written(hidden, f"{folder}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = ranges.open_system(self.folder)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.type == fs.FileType.File and self.token not in f.base_name:
                    system.delete_file(f.path)
        for m in messages:
            if m:
                system.move(m.hidden, m.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = ranges.open_system(self.folder)
        for m in messages:
            if m:
                system.delete_file(m.hidden)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "records")]

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)

    def streamReader(self, schema) -> FastaStream:
        return FastaStream(self.options)

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.dataSource.register(FastaSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str | list[str], what: str = "records", **options) -> DataFrame:
    register(spark)
    reader = spark.read.format("fasta").option("what", what)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(path if isinstance(path, str) else json.dumps(path))


def read_fasta(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """file_path, record_no, id, description, sequence, as ``fasta.read_fasta`` gives them; ``options`` are the source's.

    A first pass counts the records of each range; the sums before a range make its numbers those of the file.
    """
    counts = load(spark, path, "counts", **options)
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.select("file_path", "block", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("before"))
    if counts.rdd.getNumPartitions() <= BROADCAST_BLOCKS:
        before = F.broadcast(before)
    rows = load(spark, path, "records", **options).join(before, ["file_path", "block"])
    return rows.select("file_path", (F.col("before") + F.col("n") + 1).alias("record_no"), "id", "description", "sequence")
