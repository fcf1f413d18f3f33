"""Records of sequence files by ranges of bytes, plain, gzip and block gzip, each record read by one range.

A record belongs to the range that holds the line break before its mark (that of a file's first record lies before
its first byte). A range of a block-gzip file is one of compressed bytes: it owns the blocks that begin in it. Such
a file is a chain of gzip members, each of at most 64 KiB, that tell their own size, so that a range finds the first
one by its opening and all others by their sizes. Other gzip files are one range.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

CHUNK = 1 << 20
# The opening of a block, with its size less one behind it, and the empty block that ends a file.
BLOCK_OPENING = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00(..)", re.DOTALL)
OPENING_BYTES = 18
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of text in a block that we write, so that it never grows beyond 64 KiB.
BLOCK_TEXT = 65_280


@dataclass(frozen=True)
class Range:
    """Bytes ``start`` to ``end`` of a file; ``kind`` is plain, gzip or blocks."""

    path: str
    start: int
    end: int
    kind: str


def open_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def kind_of(system: fs.FileSystem, path: str) -> str:
    if not path.lower().endswith(".gz"):
        return "plain"
    with system.open_input_file(path) as f:
        return "blocks" if BLOCK_OPENING.match(f.read(OPENING_BYTES)) else "gzip"


def ranges_of(system: fs.FileSystem, path: str, size: int, split: int) -> list[Range]:
    kind = kind_of(system, path)
    step = max(size, 1) if kind == "gzip" else split
    return [Range(path, at, min(at + step, size), kind) for at in range(0, size, step)]


def inflate(block: bytes) -> bytes | None:
    """The text of one whole block; null where it is none."""
    engine = zlib.decompressobj(-15)
    try:
        text = engine.decompress(block[OPENING_BYTES:-8])
    except zlib.error:
        return None
    check, size = struct.unpack("<II", block[-8:])
    return text if engine.eof and len(text) == size and zlib.crc32(text) == check else None


def block_chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """Texts of the blocks from the first one that begins at ``start`` or behind it, and whether one begins before ``end``."""
    f.seek(start)
    raw, at, found = bytearray(), start, False  # ``at`` is where ``raw`` begins in the file
    while True:
        more = f.read(CHUNK)
        raw += more
        while True:
            opening = BLOCK_OPENING.match(raw) if found else BLOCK_OPENING.search(raw)
            if not opening:
                if found and len(raw) >= OPENING_BYTES:
                    raise OSError(f"no block at byte {at}")
                break
            begin = opening.start()
            size = struct.unpack("<H", opening.group(1))[0] + 1
            if not found and at + begin >= end:
                return
            if begin + size > len(raw):
                break
            text = inflate(bytes(raw[begin : begin + size]))
            if text is None:
                if found:
                    raise OSError(f"a broken block at byte {at + begin}")
                del raw[: begin + 1]  # looked like one
                at += begin + 1
                continue
            found = True
            yield text, at + begin < end
            del raw[: begin + size]
            at += begin + size
        if not more:
            if raw and found:
                raise OSError(f"a block without an end at byte {at}")
            return
        if not found and len(raw) > OPENING_BYTES + (1 << 16):
            keep = OPENING_BYTES + (1 << 16)  # the longest block may begin here
            at += len(raw) - keep
            del raw[:-keep]
            if at >= end:
                return


def gzip_chunks(f) -> Iterator[tuple[bytes, bool]]:
    engine = zlib.decompressobj(31)
    while raw := f.read(CHUNK):
        while raw:
            yield engine.decompress(raw), True
            raw = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
            else:
                raw = b""


def plain_chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    f.seek(start)
    at = start
    while chunk := f.read(min(CHUNK, end - at) if at < end else CHUNK):
        yield chunk, at < end
        at += len(chunk)


def records(chunks: Iterator[tuple[bytes, bool]], at_start: bool) -> Iterator[tuple[int, bytes]]:
    """Place of its mark in the stream of chunks, and text without it, of each record whose line break before it is owned."""
    buffer = bytearray(b"\n" if at_start else b"")
    base = -len(buffer)  # the stream's place of the buffer's first byte
    owned, opened, scan = 0, None, 0
    for chunk, mine in chunks:
        if mine:
            owned += len(chunk)
        buffer += chunk
        while (s := buffer.find(b"\n>", scan)) >= 0:
            if opened is not None:
                yield base + opened - 1, bytes(buffer[opened:s])
                opened = None
            if base + s >= owned and base + s >= 0:
                return
            opened, scan = s + 2, s + 1
        # the last byte may be half a mark
        scan = max(len(buffer) - 1, 0)
        if opened is None:
            if not mine and base + scan >= owned:
                return
            cut = scan
        else:
            cut = opened
        del buffer[:cut]
        base, scan, opened = base + cut, max(scan - cut, 0), None if opened is None else 0
    if opened is not None:
        yield base + opened - 1, bytes(buffer[opened:])


def read_range(system: fs.FileSystem, r: Range) -> Iterator[tuple[int | None, bytes]]:
    """Place in the file (null in compressed ones) and text without its mark of each record of a range."""
    with system.open_input_file(r.path) as f:
        chunks = plain_chunks(f, r.start, r.end) if r.kind == "plain" else block_chunks(f, r.start, r.end) if r.kind == "blocks" else gzip_chunks(f)
        for at, text in records(chunks, r.start == 0):
            yield (r.start + at if r.kind == "plain" else None), text


_ID, _REST = re.compile(rb"[ \t]*([^ \t\n\x0b\x0c\r]*)"), re.compile(rb"[ \t]*([^\r\n]*)")


def parts_of(text: bytes) -> tuple[str, str, bytes]:
    """Id, description and body of a record."""
    head = _ID.match(text)
    rest = _REST.match(text, head.end()).group(1)
    line = text.find(b"\n")
    return head.group(1).decode("utf-8", "replace"), rest.decode("utf-8", "replace").strip(" "), text[line + 1 :] if line >= 0 else b""


_CLEAN = bytes.maketrans(b"Jj", b"LL")


def clean(body: bytes) -> str:
    return body.translate(_CLEAN, b"*\n\r\t ").decode("utf-8", "replace")


def layout(body: bytes) -> tuple[int, int | None, int | None]:
    """Letters of a body as they are written, letters of a line and bytes of a line; the last two null where lines differ."""
    code = np.frombuffer(body, np.uint8)
    letters = int(np.count_nonzero((code != 10) & (code != 13)))
    breaks = np.flatnonzero(code == 10)
    if not len(breaks):
        return letters, letters, len(body)
    widths = np.diff(breaks, prepend=-1)
    ends = code[np.maximum(breaks - 1, 0)] == 13
    last = len(body) - int(breaks[-1]) - 1
    even = (widths == widths[0]).all() and (ends == ends[0]).all() and last <= widths[0]
    if not even and len(widths) > 1 and last == 0:  # a short last line with its break
        even = (widths[:-1] == widths[0]).all() and (ends == ends[0]).all() and widths[-1] <= widths[0]
    width = int(widths[0])
    return letters, (width - 1 - int(ends[0])) if even else None, width if even else None


class BlockGzip:
    """Writes a block-gzip file."""

    def __init__(self, out):
        self.out, self.waiting = out, bytearray()

    def write(self, text: bytes) -> None:
        self.waiting += text
        while len(self.waiting) >= BLOCK_TEXT:
            self._block(bytes(self.waiting[:BLOCK_TEXT]))
            del self.waiting[:BLOCK_TEXT]

    def _block(self, text: bytes) -> None:
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = engine.compress(text) + engine.flush()
        size = OPENING_BYTES + len(packed) + 8
        self.out.write(LAST_BLOCK[:16] + struct.pack("<H", size - 1) + packed + struct.pack("<II", zlib.crc32(text), len(text)))

    def close(self) -> None:
        if self.waiting:
            self._block(bytes(self.waiting))
        self.out.write(LAST_BLOCK)
        self.out.close()
