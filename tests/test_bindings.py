"""How the bindings' tables meet."""

import pytest

from sinkweave.jobs import registry
from tests.conftest import DATA


def plan_of(spark, name: str) -> str:
    return registry.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["delete_marks", "apply_status"])
def test_decisions_meet_files_by_key(spark, name):
    plan = plan_of(spark, name)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_decisions_are_read_once(spark):
    plan = plan_of(spark, "fold_decisions")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("events.parquet") == 2  # once for marks, once for decisions
