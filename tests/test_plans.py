"""Plans at scale: no pair of tables is multiplied, scans read the columns they need and filters reach them."""

import pytest

from codelake import catalog

DIR = "/root/testdata/sf0.001"
#: A row (or one query vector) is joined to each row.
SINGLE_ROWS = {"r10_neural", "r24_coherence", "v12_int8_search", "x10_parse_stats"}
EAGER = {k for k in catalog.QUERIES if k.startswith("g") or k in {"m24_cross_project", "m31_expand_entry", "m47_name_impact", "t06_publish", "s17_snapshot"}}


def _plan(spark, key):
    return catalog.QUERIES[key](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_no_products(spark):
    for key in sorted(set(catalog.QUERIES) - EAGER):
        plan = _plan(spark, key)
        assert "CartesianProduct" not in plan, key
        assert key in SINGLE_ROWS or "BroadcastNestedLoopJoin" not in plan, key


@pytest.mark.parametrize(("key", "columns"), [("o04_scoped_top_k", "struct<doc_id:bigint,source:string,n_chars:bigint>"), ("a28_modal_language", "struct<lang:string,source:string>"), ("m48_event_count", "struct<event_type:string>"), ("l18_token_estimate", "struct<doc_id:bigint,text:string>")])
def test_scans_read_what_they_need(spark, key, columns):
    assert f"ReadSchema: {columns}" in _plan(spark, key)


@pytest.mark.parametrize(("key", "pushed"), [("o04_scoped_top_k", "EqualTo(source,src3)"), ("f04_file_hash", "EqualTo(doc_id,17)"), ("u05_merge", "GreaterThan(p_size,20)"), ("f12_line_filter", "IsNotNull(text)")])
def test_filters_reach_the_scan(spark, key, pushed):
    plan = _plan(spark, key)
    assert pushed in plan


@pytest.mark.parametrize("key", ["o01_top_k", "r18_staged", "w02_diversity"])
def test_top_k_is_taken_by_task(spark, key):
    assert "TakeOrderedAndProject" in _plan(spark, key)
