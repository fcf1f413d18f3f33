"""Personal data, and terms that disclose it.

Emails, IP addresses, card and phone numbers are found by their form. Each such value is a protected
entity. Corpus co-occurrence tells how much of an entity's information a term carries: with N
documents, IC(e) = log(N / n(e)) and PMI(e; t) = log(N n(e, t) / (n(e) n(t))). A term within
``REACH`` words of an entity that carries at least ``GENERALISE`` of IC is generalised wherever it
occurs, and removed from ``REMOVE`` on. That they meet so often must be no chance: were they independent,
n(e, t) or more meetings would have a probability of at most exp(-G), where G = n(e, t) (PMI - 1) + n(e) n(t) / N
is half the likelihood-ratio statistic. A pair counts where that, times the number of all pairs, is at most
``CHANCE``; so one meeting never decides, and a corpus without disclosing terms has none marked. The values of a
kind together, and the addresses of a mail domain, are entities as well.

A term is a run of letters and their marks, of two at least. In scripts that are written without blanks it is
each pair of neighbouring letters (a letter alone where it stands so), counted like all others.

All counts are of distinct texts over the whole corpus, so that copies change none. The terms to mark
and the digests of copied texts travel as bitmaps sized by their number, 32 MB at most; what passes them is
counted and joined exactly by term or digest, so the bitmaps decide nothing. Texts are cut into terms a few
megabytes at a time, each distinct term of which is looked up once. A document holds spans of its own only.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.common import bitmap_of, document_key, join_counted, join_skewed, map_batches, materialize

#: Kinds in their order: found by form, then by disclosure.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "generalise", "remove")
REACH = 8
#: Marks by chance that a corpus may be expected to have at most.
CHANCE = 0.05
GENERALISE, REMOVE = 0.8, 0.95
#: Bytes of text that are cut into terms at once.
SLICE_BYTES = 8_000_000
NONE = np.zeros(0, np.int64)

# possessive: each run is read once, also in texts without any match
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
RUN, BETWEEN_RUNS = regex.compile(r"[\p{L}\p{M}]+"), r"[^\p{L}\p{M}]+"
# Scripts that are written without blanks between words.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
SEGMENT = regex.compile(rf"(?P<letters>(?:{UNSPACED}\p{{M}}*)+)|(?:(?!{UNSPACED}).)+", regex.DOTALL)
UNIT = regex.compile(rf"{UNSPACED}\p{{M}}*")
#: The first letter of a script without blanks: texts and runs below it are cut by blanks and marks alone.
FIRST_UNSPACED = "\u0e00"
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; leftmost non-overlapping of each kind."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    if any(d in text for d in "0123456789"):
        for m in DOTTED.finditer(text):
            parts = list(re.finditer("[0-9]+", m[0])) if m[0].count(".") >= 3 else []
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in four):
                    out.append(("ip", m.start() + four[0].start(), m.start() + four[3].end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def entities(kind: str, value: str) -> list[str]:
    """The value in one form (of numbers the digits only), its kind and, of an address, the mail domain."""
    if kind == "email":
        value = value.lower()
        return [f"{kind}:{value}", kind, "@" + value.rsplit("@", 1)[1]]
    parts = re.findall("[0-9]+", value)
    return [f"{kind}:{'.'.join(str(int(p)) for p in parts) if kind == 'ip' else ''.join(parts)}", kind]


def run_terms(run: str) -> list[tuple[str, int, int]]:
    """Terms of a run of letters and marks, with their places in it."""
    if max(run, default="") < FIRST_UNSPACED:
        return [(run, 0, len(run))] if len(run) > 1 else []
    out = []
    for m in SEGMENT.finditer(run):
        if m["letters"] is None:
            out += [(m[0], *m.span())] if m.end() - m.start() > 1 else []
            continue
        units = [(m.start() + u.start(), m.start() + u.end()) for u in UNIT.finditer(m[0])]
        pairs = zip(units, units[1:], strict=False) if len(units) > 1 else zip(units, units, strict=True)
        out += [(run[a:b], a, b) for (a, _), (_, b) in pairs]
    return out


def terms_in(text: str) -> Iterator[tuple[str, int, int]]:
    """Terms of a lower-case text, with their places."""
    for m in RUN.finditer(text):
        for term, a, b in run_terms(m[0]):
            yield term, m.start() + a, m.start() + b


def near_terms(text: str, spans: list[tuple[str, int, int]], reach: int = REACH) -> dict[str, set[str]]:
    """Terms within ``reach`` words of each entity of a lower-case text, however long these are; none that start in a value.

    Blanks and values end words. A value is a word itself, so that a term lies near few values; marks alone are none.
    """
    taken = np.zeros(len(text) + 2, np.int8)
    for _, a, b in spans:
        taken[a + 1 : b + 1] = 1
    runs = np.flatnonzero(np.diff(taken)).reshape(-1, 2).tolist()
    words: list[int] = []
    place, at = [], 0
    for lo, hi in [*runs, [len(text)] * 2]:
        words += [m.start() for m in WORD.finditer(text, at, lo) if any(map(str.isalnum, m[0]))]
        place.append(len(words))
        words.append(lo)
        at = hi
    terms: list[set[str]] = [set() for _ in words]
    for term, at, _ in terms_in(text):
        if not taken[at + 1]:
            terms[bisect_right(words, at) - 1].add(term)
    found: dict[str, set[str]] = {}
    firsts = [lo for lo, _ in runs]
    for kind, a, b in spans:
        k = place[bisect_right(firsts, a) - 1]
        near = set().union(*terms[max(0, k - reach) : k], *terms[k + 1 : k + 1 + reach])
        for e in entities(kind, text[a:b]):
            found.setdefault(e, set()).update(near)
    return found


BASE = "doc_id bigint, digest bigint, base array<struct<kind: string, s: int, e: int>>, near array<struct<entity: string, term: string>>"


def lower(texts: pa.Array) -> pa.Array:
    """Letter for letter: places in the result are those in the text. Nulls are empty."""
    return pc.utf8_lower(pc.fill_null(texts, ""))


def text_digest(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), base spans and ``near``: pairs of entity and nearby term, and one with a null term for each entity."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BASE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                base = [base_spans(t or "") for t in part.column(1).to_pylist()]
                texts = lower(part.column(1))
                near = [[{"entity": e, "term": t} for e, ts in near_terms(texts[k].as_py(), spans).items() for t in (None, *sorted(ts))] if spans else [] for k, spans in enumerate(base)]
                spans = [[{"kind": k, "s": a, "e": b} for k, a, b in x] for x in base]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(spans, schema.field(2).type), pa.array(near, schema.field(3).type)], schema=schema)

    return docs.select("doc_id", "text", text_digest().alias("digest")).mapInArrow(run, BASE)


def term_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Slices of some megabytes: the first row, where each row's terms begin (and the last end), their numbers, and the distinct terms."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
        split = pc.split_pattern_regex(lower(texts.slice(lo, hi - lo)), pattern=BETWEEN_RUNS)
        runs = split.flatten().dictionary_encode()
        edges = split.offsets.to_numpy()
        yield lo, *as_terms(edges - edges[0], runs.indices.to_numpy(), runs.dictionary)
        lo = hi


def as_terms(edges: np.ndarray, codes: np.ndarray, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same of the terms of runs: each distinct run is cut once."""
    number: dict[str, int] = {}
    of_run = [[number.setdefault(t, len(number)) for t, _, _ in run_terms(run)] for run in runs.to_pylist()]
    sizes = np.fromiter(map(len, of_run), np.int64, len(of_run))
    flat = np.fromiter((t for some in of_run for t in some), np.int64, int(sizes.sum()))
    begins, lengths = np.cumsum(sizes) - sizes, sizes[codes]
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(begins[codes] - total[:-1], lengths) + np.arange(total[-1])
    return total[edges], flat[at], pa.array(list(number), pa.string())


def term_hashes(terms: pa.Array) -> np.ndarray:
    """Spark's xxhash64 of each term."""
    return np.array([xxhash.xxh64_intdigest(t, 42) for t in terms.cast(pa.binary()).to_pylist()], np.uint64)


def hashed(terms: DataFrame) -> DataFrame:
    return terms.select(F.xxhash64("term").alias("h"))


def text_counts(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """term and n_t: the distinct texts with each term of the corpus. ``copied`` has the digests of texts with copies.

    Texts that may have copies give a row for each digest, all others are added up where they lie. All terms are
    counted, so that the rows grow as the texts do, and not with the entities too.
    """
    again = docs.sparkSession.sparkContext.broadcast(bitmap_of(copied, "digest"))
    names = ["digest", "term", "n", "terms"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            digests, counts = batch.column(1).to_numpy(), []
            twice = again.value.marked(digests)
            for lo, edges, codes, words in term_slices(batch.column(0)):
                single, texts = [NONE], []
                for k in range(len(edges) - 1):
                    here = codes[edges[k] : edges[k + 1]]
                    if not twice[lo + k]:
                        single.append(np.unique(here))
                    elif (d := int(digests[lo + k])) not in done:
                        done.add(d)
                        texts.append((d, np.unique(here)))
                n = np.bincount(np.concatenate(single), minlength=len(words))
                some = np.flatnonzero(n)
                counts.append(pa.table({"term": words.take(pa.array(some)), "n": pa.array(n[some])}))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(t) for _, t in texts)]).astype(np.int32), words.take(pa.array(np.concatenate([NONE, *(t for _, t in texts)]))))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.int64()), pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int64()), lists], names=names)
            if counts:
                whole = pa.concat_tables(counts).group_by("term").aggregate([("n", "sum")])
                for part in whole.select(["term", "n_sum"]).to_batches(max_chunksize=50_000):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), *part.columns, pa.nulls(len(part), pa.list_(pa.string()))], names=names)

    rows = docs.filter(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("digest"))
    found = materialize(rows.mapInArrow(count, "digest bigint, term string, n bigint, terms array<string>"), "terms_seen")
    once = found.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("terms").alias("terms"))
    both = found.filter(F.col("digest").isNull()).select("term", "n").union(once.select(F.explode("terms"), F.lit(1).cast("bigint")))
    return both.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """term, action (generalise or remove) and share: the largest part of an entity's information that it carries.

    Copies of a text count once in all four counts.
    """
    near = base.select("digest", F.explode("near").alias("p")).select("digest", "p.entity", "p.term").distinct()
    counts = materialize(near.groupBy("entity", "term").agg(F.count("*").alias("n")), "pairs")
    n_e = counts.filter(F.col("term").isNull()).select("entity", F.col("n").alias("n_e"))
    pairs = counts.filter(F.col("term").isNotNull()).withColumnRenamed("n", "n_et")
    digests = base.groupBy("digest").count()
    n_t = text_counts(docs, digests.filter("count > 1"))
    # a kind has pairs with nearly every term, and a common term with nearly every entity. As n(t) is n(e, t) at least,
    # of equal n(e, t) the rarest entity has the largest share, and the most evidence where they meet more than by chance
    both = join_skewed(pairs, n_e, "entity").groupBy("term", "n_et").agg(F.min("n_e").alias("n_e")).join(n_t, "term")
    total = F.lit(float(max(digests.count(), 2)))
    pmi = F.log(total * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    share = pmi / F.greatest(F.log(total / F.col("n_e")), F.lit(1e-9))
    evidence = F.col("n_et") * (pmi - 1) + F.col("n_e") * F.col("n_t") / total
    needed = math.log(max(pairs.count(), 1) / CHANCE)
    sure = both.filter((pmi > 0) & (evidence >= needed)).groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= GENERALISE)
    return sure.select("term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"), "share")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, digest and ``added``: the spans of the given terms in each text that has some."""
    asked = docs.sparkSession.sparkContext.broadcast(bitmap_of(hashed(terms), "h"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, digests = batch.columns
            for lo, edges, codes, words in term_slices(texts):
                wanted = asked.value.marked(term_hashes(words))
                hits = np.unique(np.searchsorted(edges, np.flatnonzero(wanted[codes]), side="right") - 1)
                names = set(words.filter(pa.array(wanted)).to_pylist())
                low = lower(texts.take(pa.array(lo + hits))).to_pylist()
                found = [(lo + k, *t) for k, text in zip(hits.tolist(), low, strict=True) for t in terms_in(text) if t[0] in names]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids.take(at), digests.take(at), pa.array([f[1] for f in found], pa.string()), *(pa.array([f[k] for f in found], pa.int32()) for k in (2, 3))], names=["doc_id", "digest", "term", "s", "e"])

    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    found = materialize(rows.mapInArrow(find, "doc_id bigint, digest bigint, term string, s int, e int"), "term_spans")
    exact = join_skewed(found, terms.select("term", "action"), "term")
    return exact.groupBy("doc_id", "digest").agg(F.collect_set(F.struct(F.col("action").alias("kind"), "s", "e")).alias("added"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, digest, base spans and ``spans`` (all, in order).

    Null texts are empty. Added spans never overlap base ones. Repeated rows get equal answers, rows that
    share a doc_id are told apart by their text, and a null doc_id stays null. Texts may be of any length.
    Other columns are left out, so that none can clash. An empty table gives no rows.
    """
    base = materialize(find_base(docs), "base")
    terms = materialize(disclosing_terms(docs, base), "terms")
    added = term_spans(docs, terms).select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest"), "added")
    both = base.join(added, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("digest") == F.col("__digest")), "left")
    none = F.array().cast("array<struct<kind: string, s: int, e: int>>")
    free = F.filter(F.coalesce("added", none), lambda a: ~F.exists("base", lambda b: (a.s < b.e) & (b.s < a.e)))
    return both.select("doc_id", "digest", "base", in_order(F.concat("base", free)).alias("spans"))


def in_order(spans):
    order = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.array_position(order, x.kind).alias("k"), x.e.alias("e"), x.kind.alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e")))


def listing(name: str):
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the text with values masked by their kind, disclosing terms generalised or removed.

    A row for each document row: null texts become empty, empty ones stay, a null doc_id stays, rows that
    share a doc_id keep their own text, repeated rows are each returned. Other columns are left out, so
    that none can clash. Texts may be of any length; an empty table gives no rows.
    """

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        out = []
        for text, spans in zip(cols[1], cols[2], strict=True):
            parts, at = [], 0
            for x in spans:
                if x["s"] >= at:
                    parts += [text[at : x["s"]], {"generalise": "[TERM]", "remove": ""}.get(x["kind"], f"[{x['kind'].upper()}]")]
                at = max(at, x["e"])  # spans of neighbouring letters overlap
            out.append("".join(parts) + (text or "")[at:])
        yield {"doc_id": cols[0], "text": out}

    found = find_personal_data(docs).groupBy("doc_id", "digest").agg(F.first("spans").alias("spans"), F.count("*").alias("n"))
    facts = materialize(found.select(*document_key("doc_id", F.col("digest")), "spans", "n"), "found")
    rows = docs.select("doc_id", "text", *document_key("doc_id", text_digest()))
    both = join_counted(rows, facts, ["unnamed", "known_id", "digest"], "n", docs.count())
    return map_batches(both.select("doc_id", "text", "spans"), run, "doc_id bigint, text string")
