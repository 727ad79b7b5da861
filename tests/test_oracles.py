"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.jobs import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "fn2_distinct_tokens", "fn9_token_windows", "q1_bm25_content", "q1_bm25_in_folder", "q3_vector_outside_folder", "q7_hybrid_search", "agg_weighted_top_l_sum",
    "q11_rag_chunks", "win5_merge_first", "src15_trec_round_trip", "flt_path_predicates", "q16_multi_run_metrics", "agg22_grades", "jon10_sync_diff", "stm1_streamed_changes",
    "stm2_coalesced_changes", "stm9_windowed_events", "snk3_incremental_postings", "set6_pages_by_url", "top11_stratified_sample", "fn21_page_text", "jon11_page_of_chunk",
    "src10_jsonl_queries", "src12_jsonl_corpus", "src14_qrels", "src18_calendar_events", "agg29_batch_tokens", "top7_capped_rerank", "fn16_char_truncate",
    "q18_index_sync", "q18_synced_terms", "snk6_failed_files", "jon9_result_rows", "q4_embedded_titles", "udf2_reranked_chunks", "q13_vault_search", "fn26_context",
    "win9_history", "win11_heading_scope", "src13_tolerant_json", "fn19_frontmatter", "fn27_char_budget", "fn28_grade", "fn33_tasks",
]


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    if not SF.exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, str(SF))
    result = sql.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    expected = sorted(tuple(map(repr, (row[columns.index(c)] for c in sorted(columns)))) for row in result.fetchall())
    assert sorted(tuple(map(repr, (row[c] for c in sorted(columns)))) for row in got.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
