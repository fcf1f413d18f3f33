import numpy as np
import pytest

from residua.llm.queries import op13_token_counts, table, tokenizer_path
from residua.llm.token_counts import PairMerger, TokenCounter, count_tokens

ODD = [
    "", " ", "T̈ ẗ J̌ é", "<|endoftext|><|startoftext|>a <|endoftext <|ENDOFTEXT|>", "a" * 4000, "ab" * 700 + "!" * 999, "é b",
    "it's we'll İ ﬁ ΑΣ Σ 漢字 🙂🙂 1234567 \x1c  x\x85y\x00 a\tb. ., Ab,\r\nc d",
]


def by_library(path: str, texts: list[str]) -> list[int]:
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_query_equals_the_library(spark, sf):
    rows = {r.doc_id: r for r in op13_token_counts(spark, sf).collect()}
    docs = [(r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect()]
    want = by_library(tokenizer_path(), [t for _, t in docs])
    assert len(rows) == len(docs)
    for (doc_id, text), n in zip(docs, want, strict=True):
        r = rows[doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_texts(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    assert TokenCounter(path).count([t.encode() for t in ODD]) == by_library(path, ODD)


def test_slices_and_memory_change_nothing(monkeypatch):
    from residua.llm import token_counts

    monkeypatch.setattr(token_counts, "SLICE_BYTES", 40)
    texts = [" ".join(f"Wörd{k % 37} x{k % 91}" for k in range(400)), *ODD]
    assert TokenCounter(tokenizer_path(), memory_units=10).count([t.encode() for t in texts]) == by_library(tokenizer_path(), texts)


def merged_one_by_one(model: dict, unit: str) -> int:
    ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
    parts = [*unit[:-1], unit[-1] + (model["end_of_word_suffix"] or "")]
    while pairs := [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]:
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return len(parts)


@pytest.mark.parametrize("merges", [[("a", "a"), ("aa", "a"), ("b", "a")], [("aa", "b"), ("a", "a"), ("b", "aa"), ("aab", "aa")]])
def test_rounds_equal_one_merge_at_a_time(merges):
    """In the second table a product is part of a pair of lower rank, so that places must be merged one by one."""
    tokens = dict.fromkeys(["a", "b", *(x + y for x, y in merges)])
    model = {"type": "BPE", "vocab": {t: k for k, t in enumerate(tokens)}, "merges": merges, "end_of_word_suffix": None}
    merger = PairMerger(model)
    assert merger.ordered == (merges[0] == ("a", "a"))
    draw = np.random.default_rng(3)
    units = ["".join(draw.choice(["a", "b"], size=n, p=[0.8, 0.2])) for n in draw.integers(1, 30, 300)]
    assert merger.count(units).tolist() == [merged_one_by_one(model, u) for u in units]
    assert merger.count([]).tolist() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        PairMerger({"type": "WordPiece"})


def test_odd_rows(spark, odd_docs, no_docs):
    rows = count_tokens(odd_docs, tokenizer_path()).collect()
    docs = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    want = [(d, len(t.encode()), n) for (d, t), n in zip(docs, by_library(tokenizer_path(), [t for _, t in docs]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=key) == sorted(want, key=key)
    assert count_tokens(no_docs, tokenizer_path()).count() == 0
