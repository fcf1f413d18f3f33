"""WARC archives and their capture index, merged externally.

Pages are written as gzip WARC archives of bounded size, one record each; of pages with equal
payloads the one with the largest id is a response and the others are revisits of it. Reading an
archive back gives a locally sorted run of captures. The index over all archives is an external
merge: each run is cut at boundaries taken from a regular sample of all runs, the cuts of one key range
meet in one task, and a loser tree merges them by URL key, time and page. Ranges follow each other, so
the histories are in global order; boundaries are captures' whole places in that order, down to archive and
offset, so that a URL, or a single capture repeated, with a third of all rows is spread over as many ranges
as it needs. The sample is sorted in the cluster; one boundary for each range comes to the driver, as does
one for each task of a sort by Spark itself.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import bitmap_of, join_counted, marked, materialize, parts_for, scratch_path, utf8

ARCHIVE_BYTES = 64_000_000
ARCHIVE_ROWS = 4000
RANGE_ROWS = 50_000
#: Sampled keys for each range of the merge.
SAMPLES = 32
GZIP_LEVEL = 4

CAPTURE = "page_id bigint, url_key string, captured_at bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, at bigint"
FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]
#: What orders captures.
PLACE = ["url_key", "captured_at", "page_id", "archive", "at"]


def url_key(url: str | None) -> str:
    """Sort key of an address: host labels from the last, then path and query, in lower case."""
    u = (url or "").strip().lower().split("#", 1)[0]
    rest = u.split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].split(":", 1)[0], rest[cut:] or "/"
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + path


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


#: What a date of an archive can tell: years 1 to 9999.
EPOCH, FIRST, LAST = datetime(1970, 1, 1), -62_135_596_800, 253_402_300_799


def date_of(when: int) -> str:
    t = EPOCH + timedelta(seconds=min(LAST, max(FIRST, when)))
    return f"{t.year:04d}-{t:%m-%dT%H:%M:%S}Z"


def time_of(date: str) -> int:
    return int((datetime.fromisoformat(date.removesuffix("Z")) - EPOCH).total_seconds())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, when: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, but tells its length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date_of(when)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records(stream: io.RawIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each gzip member of an archive, one at a time."""
    at, data = 0, b""
    while True:
        if not data:
            data = stream.read(1 << 20)
        if not data:
            return
        begun, member, out = at, zlib.decompressobj(31), []
        while not member.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    raise ValueError("an archive ends within a record")
            out.append(member.decompress(data))
            at += len(data) - len(member.unused_data)
            data = member.unused_data
        head, _, body = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield begun, headers, body[: int(headers["Content-Length"])]


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_references(pages: DataFrame) -> DataFrame:
    """Adds ``payload``, ``digest`` (hex SHA-1) and, for rows that revisit another, ``is_revisit`` and ``refers_to``.

    Only digests are compared. Payloads of a single page stay where they lie, as a bounded bitmap of the repeated
    digests tells; of the others those of very many pages meet their reference in place, and the rest move once.
    """
    rows = pages.select("page_id", "url", "fetched_at", utf8("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    ids = materialize(rows.select("page_id", "digest"), "payloads")
    repeated = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    repeated = materialize(repeated.withColumn("mark", F.xxhash64("digest")), "repeated")
    rows = rows.withColumn("again", marked(F.xxhash64("digest"), bitmap_of(repeated, "mark")))
    met = join_counted(rows.filter("again"), repeated.drop("mark"), "digest", "n", ids.count(), "left")
    # where no row of a group has an id, all are responses
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    met = met.withColumn("is_revisit", revisit).withColumn("refers_to", F.when(F.col("is_revisit"), F.col("refers_to")))
    alone = rows.filter("not again").withColumns({"is_revisit": F.lit(False), "refers_to": F.lit(None).cast("bigint")})
    names = ["page_id", "url", "fetched_at", "payload", "digest", "is_revisit", "refers_to"]
    return alone.select(*names).unionByName(met.select(*names))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives below ``folder`` (the shared one by default); a row for each: archive, n_records, n_bytes.

    A repeated attempt of a task writes under new names; only archives of the rows that Spark has
    committed count. A null html is an empty payload, a null url an empty address, a null time 1970; times
    before the year 1 or after 9999 count as its first or last second. Rows with equal page_id and payload
    are alike: all response, or all revisits. Where no row of a group has an id, all are responses. Pages
    and addresses may be of any length. Other columns are left out, so that none can clash. An empty table
    gives no archives.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    when = F.coalesce(F.unix_timestamp("fetched_at"), F.lit(0)).alias("when")
    rows = with_references(pages).select("page_id", "url", "payload", "digest", when, "refers_to", "is_revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for page_id, url, payload, digest, at, refers_to, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= ARCHIVE_BYTES or n >= ARCHIVE_ROWS:
                    close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                press = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                data = press.compress(record(page_id, url, payload, base32(digest), at, refers_to, again)) + press.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in done], pa.string()), *(pa.array([x[k] for x in done], pa.int64()) for k in (1, 2))], names=["archive", "n_records", "n_bytes"])

    return materialize(rows.mapInArrow(write, "archive string, n_records bigint, n_bytes bigint"), "archives")


def read_runs(archives: DataFrame) -> DataFrame:
    """Reads archives back, each a run of captures in order of (url_key, captured_at, page_id).

    The payload of a response is digested again and must have its record's digest.
    """

    def page(urn: str) -> int | None:
        number = urn.removeprefix("<urn:x-page:").removesuffix(">")
        return int(number) if number else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = _files(archive)
                run = []
                with files.open_input_stream(path, compression=None) as stream:
                    for at, h, payload in records(stream):
                        digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
                        if not revisit and base32(hashlib.sha1(payload).hexdigest()) != digest:
                            raise ValueError(f"{archive}: the payload at {at} differs from its digest")
                        when = time_of(h["WARC-Date"])
                        length = int(h["X-Payload-Length"]) if revisit else len(payload)
                        run.append((page(h["WARC-Record-ID"]), url_key(h["WARC-Target-URI"]), when, length, digest, h["WARC-Type"], page(h["WARC-Refers-To"]) if revisit else None, archive, at))
                run.sort(key=order_key)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in run], t) for k, t in enumerate(_TYPES)], names=FIELDS)

    n = archives.count()
    return archives.select("archive").repartition(max(1, n)).mapInArrow(read, CAPTURE)


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def order_key(capture: tuple) -> tuple:
    """Total order of captures; a missing page id comes first, equal captures go by archive and place."""
    page_id = capture[0]
    return capture[1], capture[2], -(1 << 63) if page_id is None else page_id, capture[7], capture[8]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up.

    Taking the least item and putting its run's next one in replays a single path of matches.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.k = len(runs)
        self.runs = runs
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int) -> tuple | None:
        item = next(self.runs[i], None)
        return None if item is None else (order_key(item), i, item)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or a is not None and a[:2] < b[:2]

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._before(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[2]
            w = self.winner
            self.heads[w] = self._next(w)
            node = (w + self.k) >> 1
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node >>= 1
            self.winner = w


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with ``range_no`` and ``range_pos``: in their order, the histories are globally sorted.

    ``runs`` should be a written table whose partitions hold sorted runs.
    """
    total = runs.count()
    ranges = parts_for(total, range_rows)
    step = max(1, total // (ranges * SAMPLES))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(range(step // 2, batch.num_rows, step), pa.int64())).select(PLACE)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = SAMPLES // 2
        for batch in batches:
            picked = list(range(at, batch.num_rows, SAMPLES))
            at = (picked[-1] + SAMPLES if picked else at) - batch.num_rows
            yield batch.take(pa.array(picked, pa.int64()))

    bounds: list[tuple] = []
    if ranges > 1:
        schema = "url_key string, captured_at bigint, page_id bigint, archive string, at bigint"
        # a missing page_id comes first, as in order_key
        sorted_sample = runs.mapInArrow(sample, schema).orderBy("url_key", "captured_at", F.asc_nulls_first("page_id"), "archive", "at")
        bounds = sorted({(r[0], r[1], -(1 << 63) if r[2] is None else r[2], r[3], r[4]) for r in sorted_sample.mapInArrow(every, schema).toLocalIterator()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            pieces: list[tuple[int, list[tuple]]] = []
            before = None
            for row in rows:
                key = order_key(row)
                where = bisect_right(bounds, key)
                if before is None or key < before or where != pieces[-1][0]:
                    pieces.append((where, []))
                pieces[-1][1].append(row)
                before = key
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32()), pa.array([[dict(zip(FIELDS, r, strict=True)) for r in p[1]] for p in pieces], _SEGMENT)], names=["range_no", "segment"])

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        def run(segment) -> Iterator[tuple]:
            return (tuple(x.values()) for x in segment)

        merged = list(LoserTree([run(s) for s in table.column("segment").to_pylist()]))
        n = len(merged)
        columns = [pa.array([r[k] for r in merged], t) for k, t in enumerate(_TYPES)]
        return pa.Table.from_arrays([*columns, pa.array([key[0].as_py()] * n, pa.int32()), pa.array(range(n), pa.int64())], names=[*FIELDS, "range_no", "range_pos"])

    segments = runs.mapInArrow(cut, f"range_no int, segment array<struct<{', '.join(f.replace(' ', ': ') for f in CAPTURE.split(', '))}>>")
    return segments.groupBy("range_no").applyInArrow(merge, CAPTURE + ", range_no int, range_pos bigint")


_SEGMENT = pa.list_(pa.struct(list(zip(FIELDS, _TYPES, strict=True))))


def archive_and_index(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages (page_id, url, html, fetched_at) to archives, and back as the merged index of captures.

    A row for each page row, as ``write_archives`` says of nulls and repeated rows; an empty table gives none.
    """
    return merge_index(materialize(read_runs(write_archives(pages, folder)), "runs"))
