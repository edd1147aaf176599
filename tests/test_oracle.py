"""Every query against its SQL, and the shape of every plan."""

import re

import pytest

import __spark_entry__ as entry_module
from compare import connect, differences

SF = "/root/testdata/sf0.001"
OWN = lambda name: not re.match(r"op\d+_|pipeline$", name)  # noqa: E731  the others are optional and tested with their package
QUERIES = {n: q for n, q in entry_module.queries().items() if OWN(n)}
ORACLE = {n: q for n, q in entry_module.oracle_sql().items() if OWN(n)}
PYTHON_OPERATORS = {"score_batch", "catalog_changes", "catalog_snapshot", "sliding_admission", "login_lockout",
                    "frame_select", "near_duplicate_frames"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_cross_join_and_no_stray_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_OPERATORS:
        assert "MapInPandas" not in plan and "Python" not in plan
