"""A larger table is dealt to more tasks, so that a task's memory stays."""

import oracle
import pytest
from clinframe import registry
from clinframe.operators import chart
from clinframe.sources import bindings


@pytest.mark.parametrize("name", ["dml_assign", "dml_respond", "caller_scopes"])
def test_access_is_dealt_by_size(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(bindings, "TASK_BYTES", 10_000)
    n = bindings.table_bytes(spark, sf_dir, "lineitem") // 10_000
    assert n > 8 and "hashpartitioning(doctor_user_id" in (plan := registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()) and f", {n}), REPARTITION_BY_NUM" in plan
    assert oracle.same(spark, sf_dir, registry.QUERIES[name], registry.ORACLE[name]) > 0


def test_small_tables_are_left_to_the_session(spark, sf_dir):
    assert "REPARTITION_BY_NUM" not in bindings.access(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_scopes_group_no_joined_rows(spark):
    callers = spark.createDataFrame([(2, "doctor"), (2, "doctor")], "caller_id long, role string")
    access = spark.createDataFrame([(2, 3), (2, 3), (2, 4)], "doctor_user_id long, patient_id long")
    seen = chart.scopes(callers, spark.createDataFrame([], "id long, user_id long"), access)
    assert sorted(map(tuple, seen.collect())) == [(2, "doctor", 3), (2, "doctor", 4)]
