"""The pipeline stage by stage against what each should leave of its own input."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from convfeat.llm.common import table
from tests.llm.helpers import by_id
from tests.llm.test_duplicates import exact_expected, near_expected
from tests.llm.test_texts import contamination_expected, encoding, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, benchmark = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in benchmark.collect()]

    def leaves(name, expected):
        nonlocal docs
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        assert out.columns == columns and {r.doc_id for r in rows} == expected and len(rows) == len(expected), name

    def texts():
        return [(r.doc_id, r.text) for r in docs.collect()]

    lettered = {i for i, t in texts() if any(c.isalpha() for c in t or "")}
    leaves("language ID", lettered)
    leaves("exact dedup", {i for i, x in exact_expected(texts()).items() if x[2]})
    leaves("n-gram Jaccard join", {x[0] for x in near_expected(texts()).values()})
    leaves("benchmark decontamination", {i for i, x in contamination_expected(texts(), items).items() if not x[4]})
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    own = encoding()
    assert by_id(out, "ids", "round_trip") == {i: (own.encode_ordinary(t), True) for i, t in texts()}
    assert all(words(t) for _, t in texts())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == out.select("doc_id").distinct().count() > 0
    assert public_tokenizers.PATTERN and [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"
