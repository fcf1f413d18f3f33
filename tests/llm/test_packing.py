import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from residua.llm import packing
from residua.llm.queries import op2_best_fit_packing, tokenizer_path


def slow_bfd(lengths, capacity):
    """Sequence of each piece by looking at all open sequences."""
    room, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [k for k, r in enumerate(room) if r >= lengths[i]]
        k = min(fits, key=lambda k: room[k], default=None)
        if k is None:
            room.append(capacity)
            k = len(room) - 1
        room[k] -= lengths[i]
        out[i] = k
    return len(room), sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=120), st.sampled_from([37, 40, 63, 64, 65]))
def test_tree_finds_the_tightest(lengths, capacity):
    sequence, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), capacity)
    n, rooms = slow_bfd(lengths, capacity)
    load = defaultdict(list)
    for i, (s, o) in enumerate(zip(sequence.tolist(), offset.tolist(), strict=True)):
        load[s].append((o, lengths[i]))
    assert len(load) == n
    assert sorted(capacity - sum(x for _, x in v) for v in load.values()) == rooms
    for v in load.values():
        at = 0
        for o, x in sorted(v):
            assert o == at
            at += x
        assert at <= capacity


def check_pieces(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    by_seq, want, got = defaultdict(list), [], []
    for d, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            part = np.asarray(ids[lo : lo + 2048], "<u4")
            want.append((d, k, lo, len(part), zlib.crc32(part.tobytes())))
    for r in rows:
        got.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for v in by_seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    return len(by_seq), -(-sum(w[3] for w in want) // 2048)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check_pieces(op2_best_fit_packing(spark, sf).collect(), docs)
    assert n <= 1.02 * least + 1


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, tokenizer_path()).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["", "a...b", "x's can't ... İstanbul 12ab #tag. é ́x\x0b\x0cy z", "A<|ENDOFTEXT|>b", "ﬁ Ω Å K ß SS. É, 。", "\t\t a\r\nb", "a.́ b,. c.,", "ª. ² x². ǅ.", "<|endoftext|> x"])
def test_words_encode_as_the_whole(text):
    from tokenizers import Tokenizer

    enc = packing.WordEncoder(tokenizer_path(), cache_words=3)
    for _ in range(3):
        assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_several_groups(spark, sf):
    """Pieces in groups of a hundred: every piece once, all sequences within their room, few more sequences than needed."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_path(), group_rows=100).collect()
    n, least = check_pieces(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len({r.sequence_id >> 32 for r in rows}) > 1 and n <= 1.1 * least + 4


def test_sequences_hold_the_ids(spark, odd_docs):
    """Of all rows, those with a null or repeated doc_id too: each sequence is the ids of its pieces in their places."""
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(3, "word " * 3000), (3, "word " * 3000), (None, "d e")], "doc_id long, text string"))
    placed = packing.pack_documents(docs, tokenizer_path())
    places = placed.collect()
    rows = {r.sequence_id: r for r in packing.sequences(docs, placed, tokenizer_path()).collect()}
    assert sum(len(r.ids) for r in rows.values()) == 4 * sum(p.length for p in places)
    for p in places:
        r = rows[p.sequence_id]
        assert zlib.crc32(r.ids[4 * p.offset : 4 * (p.offset + p.length)]) == p.ids_crc32
    order = sorted(places, key=lambda p: (p.sequence_id, p.offset))
    assert [d for k in sorted(rows) for d in rows[k].doc_ids] == [p.doc_id for p in order]


@pytest.mark.parametrize("text", ["T\u0308 t\u0308 T\u0308e end", "W\u030a. Y\u030a, J\u030c J\u0327\u030c", "H\u0331 E\u0301 \u00c9 MÊME Über I\u0307"])
def test_marks_on_capitals(text):
    """What a mark composes to may exist for the small letter alone, and letters are lowered after that."""
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordEncoder(tokenizer_path()).encode([text.encode()])[0], "<u4").tolist() == want


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A tokenizer that keeps case and blanks is not cut into words."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.BPE(vocab={"a": 0, "A": 1, "Ġ": 2, "Ġa": 3, "b": 4}, merges=[("Ġ", "a")]))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.save(str(tmp_path / "t.json"))
    enc = packing.WordEncoder(str(tmp_path / "t.json"))
    assert not enc.by_words and packing.WordEncoder(tokenizer_path()).by_words
    texts = ["a A a b", "", "  a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode([t.encode() for t in texts])] == [tok.encode(t).ids for t in texts]
