"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they lie; only the pieces' lengths and digests move. Pieces are dealt
evenly, without a key, into packing groups of about ``group_rows`` pieces. Within a group pieces go
longest first, each to the open sequence with the least sufficient room, which a segment tree over
the possible room values finds in logarithmic time. A group leaves at most a few sequences partly
filled, so the number of sequences stays within a small fraction of a percent of one global pass,
while no task ever sees more than ``group_rows`` pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import held, join_skewed, map_batches, materialize, parts_for, utf8

SEQUENCE_TOKENS = 2048
END_ID = 0
GROUP_ROWS = 131_072
#: Words that a worker remembers at most, in each of two generations.
CACHE_WORDS = 400_000

#: An ASCII capital and a first byte that a combining mark may have: what they compose to depends on the letter's case.
CAPITAL_BEFORE_MARK = re.compile(rb"[A-Z][\xcc\xcd\xd2-\xf4]")

#: ``ids_hash`` tells, beside the checksum, pieces of texts apart that share a doc_id.
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids_hash bigint"


def works_by_words(rules: dict) -> bool:
    """Whether a tokenizer's rules lower letters, cut at white space and leave it out, with special tokens of the known opening only."""
    normal, cut = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal])
    known = all(n.get("type") in ("NFC", "Lowercase") or n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in steps)
    first = (cut.get("pretokenizers") or [cut])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ") if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") else " "
    no_blanks = not any(regex.search(pattern, blank) for blank in " \t\n\r\x0b\x0c\xa0") and regex.findall(pattern, "ab cd") == ["ab", "cd"]
    plain = rules.get("post_processor") is None and not rules["model"].get("continuing_subword_prefix")
    return known and any(n.get("type") == "Lowercase" for n in steps) and no_blanks and plain and all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))


class WordEncoder:
    """Token ids of whole texts, exactly as the tokenizer gives them, by remembering words.

    Where a tokenizer lowers letters, drops white space and never merges across it, a text's ids are those
    of its blank-separated words in turn. Words are kept with ASCII letters lowered, but where a mark may stand on one. Texts that hold the
    opening of a special token go to the tokenizer whole, and so do all texts where the tokenizer's file
    doesn't say that it works so.
    """

    SPECIAL = b"<|"

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = works_by_words(json.loads(self.tokenizer.to_str()))
        self.cache_words = cache_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def pack_ids(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def whole(self, text: bytes) -> bytes:
        return self.pack_ids(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids)

    def _learn(self, words: list[bytes]) -> None:
        """Plain letter words are encoded together: each is one word of the tokenizer's own splitting."""
        plain, tails, rest = [], [], []
        for w in words:
            s = w.decode("utf-8")
            stem = s[:-1] if s[-1] in ".," else s
            if stem.isalpha() and stem.lower().isalpha():
                if stem is not s:
                    tails.append((w, stem.encode()))
                    if tails[-1][1] in self.young:
                        continue
                plain.append(stem)
            else:
                rest.append((w, s))
        plain = list(dict.fromkeys(plain))
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            at = np.asarray(e.word_ids)
            cuts = np.flatnonzero(np.diff(at)) + 1
            if len(cuts) + 1 == len(some):
                ids = np.asarray(e.ids, dtype="<u4")
                edges = [0, *cuts.tolist(), len(ids)]
                for k, w in enumerate(some):
                    self.young[w.encode()] = ids[edges[k] : edges[k + 1]].tobytes()
            else:
                rest += [(w.encode(), w) for w in some]
        if rest:
            for (w, _), e in zip(rest, self.tokenizer.encode_batch_fast([s for _, s in rest], add_special_tokens=False), strict=True):
                self.young[w] = self.pack_ids(e.ids)
        for w, stem in tails:
            mark = w[-1:]
            if mark not in self.young:
                self.young[mark] = self.whole(mark)
            self.young[w] = self.young[stem] + self.young[mark]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words:
            return [self.pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]
        split = [None if self.SPECIAL in t else (t if CAPITAL_BEFORE_MARK.search(t) else t.lower()).replace(b"\n", b" ").split(b" ") for t in texts]
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.whole(text))
                continue
            young = self.young
            ids = list(map(young.get, words))
            if None in ids:
                gaps = [k for k, v in enumerate(ids) if v is None]
                new = []
                for w in {words[k] for k in gaps}:
                    if (v := self.old.get(w)) is not None:
                        young[w] = v
                    elif w:
                        new.append(w)
                    else:
                        young[w] = b""
                if new:
                    self._learn(new)
                for k in gaps:
                    ids[k] = young[words[k]]
                if len(young) > self.cache_words:
                    self.old, self.young = young, {}
            out.append(b"".join(ids))
        return out


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and file."""
    return held(("encoder", path), lambda: WordEncoder(path))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, the end id included.

    Null and empty texts have the end id alone; a null doc_id stays null; repeated rows are packed
    each for itself; other columns are left out. ``with_ids`` adds the ids as little-endian bytes.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        enc, end = encoder(tokenizer_path), END_ID.to_bytes(4, "little")
        ids_of, texts = cols
        for lo in range(0, len(texts), 256):
            rows: dict[str, list] = {k: [] for k in (f.split()[0] for f in schema.split(", "))}
            for doc_id, ids in zip(ids_of[lo : lo + 256], enc.encode(texts[lo : lo + 256]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(k)
                    rows["start"].append(at // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    rows["ids_hash"].append(xxhash.xxh3_64_intdigest(part) - (1 << 63))
                    if with_ids:
                        rows["ids"].append(part)
            yield rows

    return map_batches(docs.select("doc_id", utf8("text").alias("text")), run, schema)


class RoomTree:
    """Segment tree over the room values 0..capacity; a leaf counts the open sequences with that room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at:
            self.some[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a sequence with the least room of at least ``need``; its room and number."""
        some, at = self.some, need + self.leaves
        while not some[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            if not at & (at - 1):
                return None
        while at < self.leaves:
            at = 2 * at if some[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            some[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ties keep their order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room, k = tree.take(need) or (capacity, -1)
        if k < 0:
            k, n = n, n + 1
        sequence[i], offset[i] = k, capacity - room
        if room > need:
            tree.add(room - need, k)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` should be a written table of columns that can be ordered, as it is counted first. Pieces of
    one length go in the order of the other columns. An empty table gives no rows.
    """
    groups = parts_for(pieces.count(), group_rows)
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := list(batches)):
            return
        table = pa.Table.from_batches(got)
        sequence, offset = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        sequence += TaskContext.get().partitionId() * (1 << 32)
        out = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"
    # a total order within each group: a repeated attempt of a task packs alike
    dealt = pieces.select(*names).repartition(groups).sortWithinPartitions(F.desc("length"), *(n for n in names if n != "length"))
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Tokenises, cuts and packs; one row for each piece with its place.

    Null and empty texts are packed as an end id; a null doc_id stays null; repeated rows, and rows that
    share a doc_id, are packed each for itself. A text of any length is cut into pieces. Other columns are
    left out, so that none can clash. An empty table gives no rows.
    """
    return pack(materialize(tokenize_pieces(docs, tokenizer_path, capacity), "pieces"), capacity, group_rows)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """The packed training sequences themselves: ``sequence_id``, ``ids`` and ``doc_ids``.

    Tokenises again where the texts lie and brings each piece's ids to its sequence; a sequence has
    at most ``capacity`` ids, so no group is larger than that. A piece finds its ids by doc_id, number, checksum and
    hash: equal pieces of repeated rows share them, a null doc_id is a value like others, and rows that share a
    doc_id but not a text are told apart. Pieces of no row of ``docs`` are left out.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "piece", "length", "ids_crc32", "ids_hash")
    ids = tokenize_pieces(docs, tokenizer_path, capacity, with_ids=True).select(key.alias("key"), "ids").groupBy("key").agg(F.first("ids").alias("ids"))
    parts = join_skewed(placed.select(key.alias("key"), "doc_id", "sequence_id", "offset"), materialize(ids, "ids"), "key")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        parts.groupBy("sequence_id")
        .agg(ordered.alias("p"))
        .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
    )
