"""Plans that scale: pruned columns, pushed filters, no Cartesian products, top-k cut before the shuffle."""

import re

import pytest

from tessera.plans.catalogue import QUERIES

D = "/root/testdata/sf0.001"


def plan(spark, name):
    df = QUERIES[name](spark, D)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "schema"), [("label_counts", "struct<doc_id:bigint,source:string>"), ("session_list", "struct<conv_id:bigint,turn:bigint,role:string>"), ("todo_flags", "struct<o_orderkey:bigint")])
def test_columns_are_pruned(spark, name, schema):
    scans = re.findall(r"ReadSchema: (struct<[^\n]*)", plan(spark, name))
    assert any(s.startswith(schema) for s in scans)
    assert not any("text" in s for s in scans)


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*vec_id", plan(spark, "knowledge_dense_topk"))


@pytest.mark.parametrize("name", ["knowledge_dense_topk", "keyword_search", "lexical_union", "entry_list_page"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["keyword_search", "lexical_union", "lexical_scan_budget", "page_lexical", "todo_lexical"])
def test_lexical_search_is_by_equal_keys(spark, name):
    found = plan(spark, name)
    assert "NestedLoop" not in found and "postings" in found


#: Queries in which every row meets a stated set of queries, or a single row, by a broadcast.
STATED = {"entry_dense_topk", "entry_dense_labelled", "entry_dense_fallback", "knowledge_dense_topk", "session_vector_topk", "memory_vector_topk", "hybrid_search", "hybrid_pipeline", "lookup_pool", "live_rankings", "vector_recent_merge", "config_selection"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_joins(spark, name):
    found = plan(spark, name)
    assert "CartesianProduct" not in found
    assert name in STATED or "BroadcastNestedLoopJoin" not in found
