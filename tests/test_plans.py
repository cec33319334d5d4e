"""What the plans must not have, and what must reach the scan."""

import os
import re

import pytest

from weft.plans import catalogue, problems

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = catalogue.QUERIES | problems.QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text), text[:3000]


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(problems.QUERIES["p1_found"](spark, DATA))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", text)
    nodes = [(cols, filters) for cols, filters in scans if "span_start" in cols or "updated_at" in cols]
    assert nodes and all("EqualTo(type,file)" in f and "summary" not in c and "signature" not in c for c, f in nodes)
    assert all("observed_at" not in c for c, _ in re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan(problems.QUERIES["p5_found"](spark, DATA))))
