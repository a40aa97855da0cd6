"""Plan-shape guards: no cartesian / nested-loop joins, filters reach the scan."""
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = ["link_edges", "click_edges", "tfidf_weights", "nearest_centroid", "topic_similarity", "recommend_links",
           "pixel_layout"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
@pytest.mark.parametrize("name", QUERIES)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_filters_and_columns_reach_the_scan(spark, monkeypatch):
    from linkloom.operators import sequence

    # the successor writes its ranged input first; without that cut the whole plan is visible
    monkeypatch.setattr(sequence, "cut", lambda df: df)
    plan = _plan(spark, "click_edges")
    assert "EqualTo(event_type,click)" in plan
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1][:200]
    plan = _plan(spark, "tfidf_weights")
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan and "n_chars" not in plan
