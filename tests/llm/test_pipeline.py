"""The pipeline on the small tables against brute force, stage by stage."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lumenq.llm import quality  # noqa: E402
from tests.llm.test_dedup import brute_exact, brute_near  # noqa: E402
from tests.llm.test_pii_and_benchmark import shingles  # noqa: E402
from tests.llm.test_tokens import check_packing  # noqa: E402


def test_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] == 1]
    rows = [r for r in rows if brute_exact(rows)[r[0]][2]]
    near = brute_near(rows, 80)
    rows = [r for r in rows if near[r[0]][2]]
    items = [shingles(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(100 * len(i & shingles(r[1])) >= 80 * len(i) for i in items if i)]
    got = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and 0 < len(rows) < docs.count()
    number = {d: k for k, (d, _) in enumerate(sorted(rows))}
    renamed = [type(r)(**(r.asDict() | {"doc_id": number[r.doc_id]})) for r in got]
    used, total = check_packing(renamed, [t for _, t in sorted(rows)], 2048)
    assert used <= 1.1 * total / 2048 + 2


def test_stages_keep_columns_and_edges(spark, data):
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "a b c d e f g", None, None, None), (3, "A b c d e f g", "en", "s", 1), (4, " ".join(f"word{i % 7_000}x{i}" for i in range(60_000)), "en", "s", 2)], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (empty, odd):
            out = stage(spark, docs, data)
            assert k + 1 == len(corpus_pipeline.STAGES) or out.columns == docs.columns
            assert docs is not empty or out.count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, odd, data).collect() if r.doc_id is not None) == [1, 2, 4]


def test_stages_keep_columns_of_any_name(spark, data):
    """Names that the operators use themselves, in any case, on rows with repeats."""
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words of the same id, which are told apart"), (2, "a b c  d e f g"), (3, None), (3, None), (None, "x y z"), (None, "x y z")]
    names = ["__id", "__key", "__text", "verdict_id_0", "WHOLE_TEXT_0", "stays", "N", "STAYED", "Key", "text_key", "digest", "keep_id", "kept", "at", "kind", "i", "k", "size", "group_size", "bucket", "owner", "rank", "row_key", "value", "label", "SCORE", "component_id", "n_tokens", "length", "start", "piece", "members"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.select("doc_id", "text", *(F.lit(f"{k} of {n}").alias(n) for k, n in enumerate(names)))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, data)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert got.columns == docs.columns
            assert all(r[n] == f"{i} of {n}" for r in got.collect() for i, n in enumerate(names))
    keys = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert keys(corpus_pipeline.without_copies(spark, docs, data)) == sorted([rows[2], (2, "a b c  d e f g"), (3, None), (None, "x y z")], key=repr)
    assert keys(corpus_pipeline.without_near_copies(spark, docs, data)) == sorted([rows[0], rows[2], (3, None), (None, "x y z")], key=repr)
