"""Registered queries against their SQL twins, and the plans they get."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict, _ = check.compare(spark, con, QUERIES[name], SQL.get(name), SF)
    assert verdict.startswith(("ok", "rows")), verdict


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


# written intermediate tables or streams: their plans were run already
RAN = {"seen_dedup_stream", "sink_digest", "sink_broad_report", "sink_audit_report"}


@pytest.mark.parametrize("name", ["src_lever", "src_workday", "posting_filter", "seen_dedup_history", "vocab_join", "audit_status",
                                  "state_merge", "src_page_assembly", "company_counts", "validate_summary"])
def test_no_cross_product(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_first_of_group_is_limited_before_the_shuffle(spark):
    for name in ("first_in_batch", "first_n_per_page", "seen_dedup_batch"):
        assert "WindowGroupLimit" in plan_of(spark, name)


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(spark, "is_canada")
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "event_id" in schema and "props" not in schema and "value" not in schema


def test_postings_never_leave_the_jvm(spark):
    for name in ("src_greenhouse", "posting_filter", "digest_by_category", "src_html_links_native"):
        plan = plan_of(spark, name)
        assert not re.search(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython", plan)
