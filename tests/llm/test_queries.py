"""The registered queries over the smallest tables: SQL where there is some, else the contracts' columns and counts."""

import pytest

from lumenq.llm import queries
from tests.test_queries import TABLES, plain

COLUMNS = {
    "op1_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op2_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op5_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op7_pii_pseudonyms": {"doc_id", "text", "n_found"},
    "op8_toxicity_grammar": {"doc_id", "held_out", "score", "predicted"},
    "op10_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op11_context_tree": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = queries.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_columns_and_rows(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    assert set(got.columns) == COLUMNS[name]
    key = "page_id" if "page_id" in COLUMNS[name] else "doc_id"
    source = spark.read.parquet(f"{data}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert got.select(key).distinct().count() == source.count()
