"""Plan-shape checks: the properties the operators are designed around."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    names = ["recommend_jobs", "recommend_candidates", "overlap_distinct", "job_report", "assign_ids",
             "rank_similarity", "top_keywords", "skills_extract", "fuzzy_skill_match", "score_pairs"]
    q = E.queries()
    return {n: plan_text(q[n](spark, SF_SMALL)) for n in names}


def test_no_cartesian_products(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p, name


def test_no_single_partition_exchange(plans):
    # global numbering goes through range partitioning, never a one-partition window
    for name in ["recommend_jobs", "recommend_candidates", "job_report", "assign_ids", "rank_similarity"]:
        assert "SinglePartition" not in plans[name], name


def test_top_keywords_shuffles_texts_once(plans):
    p = plans["top_keywords"]
    # one explicit repartition of the documents; the count and the top-k window reuse it
    assert len(re.findall(r"^\(\d+\) Exchange", p, re.M)) == 1 and "WindowGroupLimit" in p


def test_nested_loop_only_against_bounded_sides(plans):
    # the only nested-loop joins are against the fixed skill dictionary or a size-checked
    # catalogue, both broadcast
    for name in ["skills_extract", "fuzzy_skill_match"]:
        p = plans[name]
        if "BroadcastNestedLoopJoin" in p:
            assert "BroadcastExchange" in p, name
