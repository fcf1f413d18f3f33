"""Token counts by rank-synchronous merging of ragged arrays.

Texts are counted where they lie, nothing is shuffled. A batch's distinct pre-tokens become one flat array
of symbols with a segment for each. In a round every unfinished segment applies its own pair of lowest rank,
at all its places at once; segments without a pair leave the arrays, and what is left of their symbols are
their tokens. Normalising and pre-tokenising are the library's own components; no text is encoded by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from residua.llm.common import held, map_batches, utf8
from residua.llm.packing import SEQUENCE_TOKENS, works_by_words

#: Bytes of text that are split into units at once, and units that a worker remembers in each of two generations, none longer than this.
SLICE_BYTES, MEMORY_UNITS, LONG_UNIT = 1 << 20, 400_000, 64
NO_RANK = np.iinfo(np.int32).max


class PairMerger:
    """A byte-level pair vocabulary as arrays: first symbols by character, and sorted pairs with rank and product."""

    def __init__(self, model: dict):
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("the tokenizer is not a plain pair-merging one")
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        width = max((ord(t) for t in vocab if len(t) == 1), default=0) + 1
        self.inner, self.last = np.full(width, -1, np.int32), np.full(width, -1, np.int32)
        for c in range(width):
            self.inner[c] = vocab.get(chr(c), -1)
            self.last[c] = vocab.get(chr(c) + self.suffix, -1)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        product = np.array([vocab["".join(m)] for m in merges], np.int32)
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.product = keys[order], order.astype(np.int32), product[order]
        # where no product is part of a pair of lower rank than its own, all places of a pair may be merged at once
        made = np.full(self.size, -1, np.int64)
        np.maximum.at(made, product, np.arange(len(merges)))
        self.ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(merges))).all())

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NO_RANK where it is none."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK, np.int32), np.zeros(len(left), np.int32)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], NO_RANK), self.product[at]

    def first_symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units one after the other, and each unit's length."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if len(codes) and codes.max() >= len(self.inner):
            raise ValueError("the tokenizer's characters are not bytes")
        symbols = self.inner[codes]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = self.last[codes[ends]]
        if (symbols < 0).any():
            raise ValueError("a character has no symbol in the vocabulary")
        return symbols, lengths

    def count(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit: symbols that no pair merges any more."""
        symbols, lengths = self.first_symbols(units)
        out = np.zeros(len(units), np.int64)
        alive = np.flatnonzero(lengths > 1)
        out[lengths <= 1] = lengths[lengths <= 1]
        keep = np.repeat(lengths > 1, lengths)
        symbols, lengths = symbols[keep], lengths[alive]
        while len(alive):
            starts = np.cumsum(lengths) - lengths
            rank, product = self.look_up(symbols[:-1], symbols[1:])
            rank, product = np.append(rank, NO_RANK), np.append(product, 0)
            rank[starts + lengths - 1] = NO_RANK  # no pair crosses the end of a segment
            lowest = np.minimum.reduceat(rank, starts)
            chosen = (rank == np.repeat(lowest, lengths)) & (rank != NO_RANK)
            places = np.flatnonzero(chosen)
            if not self.ordered:  # the leftmost of each segment alone
                segment = np.searchsorted(starts, places, "right")
                places = places[np.append(True, segment[1:] != segment[:-1])] if len(places) else places
            elif len(places):  # of overlapping places, as in "aaa", every other one
                run = np.flatnonzero(np.append(True, np.diff(places) > 1))
                place_in_run = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
                places = places[place_in_run % 2 == 0]
            symbols[places] = product[places]
            stays = np.ones(len(symbols), bool)
            stays[places + 1] = False
            lengths = np.add.reduceat(stays.astype(np.int64), starts)
            done = (lowest == NO_RANK) | (lengths == 1)
            out[alive[done]] = lengths[done]
            going = np.repeat(~done, lengths)
            symbols, lengths, alive = symbols[stays][going], lengths[~done], alive[~done]
        return out


class TokenCounter:
    """Counts of tokens of whole texts, as the tokenizer's library gives them without adding special tokens."""

    def __init__(self, path: str, memory_units: int = MEMORY_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        cut = rules.get("pre_tokenizer") or {}
        if not any(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") for p in cut.get("pretokenizers", [cut])):
            raise ValueError("the tokenizer does not work on bytes")
        added = rules.get("added_tokens", [])
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens must stand for themselves alone")
        self.merger = PairMerger(rules["model"])
        self.by_words = works_by_words(rules)
        # the longest of several that begin at one place
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.memory_units = memory_units
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def cut(self, text: str) -> tuple[str, list[tuple[str, tuple[int, int]]]]:
        """The library's normal form of a text, and its pre-tokens with their places there."""
        text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return text, self.tokenizer.pre_tokenizer.pre_tokenize_str(text)

    def pre_tokens(self, units: list[bytes]) -> tuple[list[str], list[int]]:
        """Pre-tokens of all units, and the number of the unit that each is of.

        Where the tokenizer works by words, ASCII letters are one pre-token and a stop or comma after them is
        another; other units go to the library many at once, with blanks between them.
        """
        out, owner, rest = [], [], []
        for k, u in enumerate(units):
            stem = u[:-1] if u[-1:] in (b".", b",") else u
            if not self.by_words or not stem.isalpha() or not stem.islower():  # of bytes: ASCII letters
                rest.append(k)
                continue
            out.append(stem.decode())
            owner.append(k)
            if stem is not u:
                out.append(chr(u[-1]))
                owner.append(k)
        for lo in range(0, len(rest), 1000):
            some = rest[lo : lo + 1000]
            text, found = self.cut(" ".join(units[k].decode("utf-8") for k in some)) if self.by_words else ("", [])
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
            if self.by_words and len(blanks) == len(some) - 1:
                at = np.searchsorted(blanks, np.fromiter((p[1][0] for p in found), np.int64, len(found)))
                out += [p for p, _ in found]
                owner += np.asarray(some, np.int64)[at].tolist()
                continue
            for k in some:  # a unit holds blanks of its own
                each = self.cut(units[k].decode("utf-8"))[1]
                out += [p for p, _ in each]
                owner += [k] * len(each)
        return out, owner

    def slices(self, text: bytes) -> Iterator[list[bytes]]:
        """The units of a text: what blanks part where the tokenizer works by words, else the text as one."""
        if not self.by_words:
            yield [text]
            return
        # case is folded here for ASCII alone: composing marks depends on the case of what they stand on
        text = (text.lower() if text.isascii() else text).replace(b"\n", b" ")
        at = 0
        while at < len(text):
            end = text.find(b" ", at + SLICE_BYTES)
            end = len(text) if end < 0 else end
            yield text[at:end].split(b" ")
            at = end + 1

    def learn(self, units: Iterable[bytes]) -> dict[bytes, int]:
        """Tokens of distinct units."""
        units = list(units)
        pieces, owner = self.pre_tokens(units)
        numbers = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        counts = self.merger.count(list(numbers))
        at = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
        totals = np.bincount(np.asarray(owner, np.int64), weights=counts[at], minlength=len(units)).astype(np.int64)
        return dict(zip(units, totals.tolist(), strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        """Of each text; those of a call are learnt together, up to a slice's bytes at once."""
        out = [0] * len(texts)
        waiting: list[tuple[int, list[bytes]]] = []
        size = 0
        for k, text in enumerate(texts):
            parts = [text]
            if self.special and (found := self.special.findall(text)):
                out[k] += len(found)
                parts = self.special.split(text)
            for part in parts:
                for units in self.slices(part):
                    waiting.append((k, units))
                    size += sum(map(len, units))
                    if size >= SLICE_BYTES:
                        self._settle(waiting, out)
                        waiting, size = [], 0
        self._settle(waiting, out)
        return out

    def _settle(self, waiting: list[tuple[int, list[bytes]]], out: list[int]) -> None:
        young, old = self.young, self.old
        new = set().union(*(units for _, units in waiting)) - young.keys()
        known = {u: old[u] for u in new & old.keys()}
        learnt = self.learn(new - known.keys()) if len(known) < len(new) else {}
        young |= known | learnt
        for k, units in waiting:
            out[k] += sum(map(young.__getitem__, units))
        for u in learnt:
            if len(u) > LONG_UNIT:
                del young[u]
        if len(young) > self.memory_units:
            self.young, self.old = {}, young


def counter(path: str) -> TokenCounter:
    """One for each Python worker and file."""
    return held(("counter", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each row.

    Null and empty texts have no bytes and no tokens. A special token's string in a text is one token. Texts
    may be of any length; repeated rows and rows with a null or repeated doc_id are counted each for itself.
    Other columns are left out, so that none can clash. An empty table gives no rows.
    """

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        for lo in range(0, len(cols[0]), 256):
            texts = cols[1][lo : lo + 256]
            n = counter(tokenizer_path).count(texts)
            yield {"doc_id": cols[0][lo : lo + 256], "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    return map_batches(docs.select("doc_id", utf8("text").alias("text")), run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
