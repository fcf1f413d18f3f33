import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402

from residua.llm import toxicity  # noqa: E402
from residua.llm.common import materialize  # noqa: E402
from residua.llm.queries import table  # noqa: E402
from tests.llm import test_decontamination, test_line_windows, test_packing, test_simhash  # noqa: E402


def test_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit_severity(docs, table(spark, sf, "labels"))
    toxic = {r.doc_id for r in toxicity.score_documents(docs, model).filter("toxic").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic)
    rows = [(d, v[0]) for (d, _), v in test_line_windows.slow(rows).items()]
    first = test_simhash.slow_components([(d, test_simhash.slow_print(t)) for d, t in rows])
    rows = [r for r, c in zip(rows, first, strict=True) if r[0] == c]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in test_decontamination.slow(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    assert 0 < len(rows) < docs.count()
    test_packing.check_pieces(corpus_pipeline.run(spark, sf).collect(), rows)


ODD_NAMES = ["meta.host", "a b", "n_lines", "n_cut", "digest", "touched", "column_1", "back`tick"]


def test_stages_leave_odd_columns_alone(spark, odd_docs, no_docs, sf):
    """Names with dots, blanks and marks, and names that operators use themselves: values stay with their rows."""
    values = [F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for k, n in enumerate(ODD_NAMES)]
    docs = materialize(odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *values), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[5 + k] == f"{k}:{'null' if r[0] is None else r[0]}" for r in rows for k in range(len(ODD_NAMES))), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_stages_keep_the_columns(spark, odd_docs, no_docs, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf)
        assert out.columns == odd_docs.columns, name
        assert 0 < out.count() <= odd_docs.count()
        assert stage(spark, no_docs, sf).count() == 0
