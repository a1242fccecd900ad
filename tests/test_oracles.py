"""Registered queries against DuckDB on the smallest tables. VOICELAKE_ALL=1 runs every key, otherwise one of each kind."""

import os

import pytest

pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import connect, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SOME = ["eer", "auroc", "det_curve", "parse_reference", "src_jsonl_strict", "snk_replace_partitions", "connected_components", "closure_poison",
        "eligibility_filter", "cross_split_roles", "manifest_cache_diff", "group_stats", "content_signature", "quota_trim", "choose_genuine_test",
        "select_window", "near_dup_band", "audit_parents", "ledger_rollup", "st_resume_dedupe", "st_chunk_score",
        "st_event_windows", "version_validate", "audit_cache", "cap_per_group", "subgroup_summarize", "prediction_parity", "src_union_glob", "closure_path"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(oracle_sql()) if os.environ.get("VOICELAKE_ALL") else SOME)
def test_query_matches_sql(spark, con, key):
    df = queries()[key](spark, FOLDER)
    result = con.execute(oracle_sql()[key])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want)


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
