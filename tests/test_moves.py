"""What trends move between tasks, with broadcasts off."""

import re

from clinframe import registry


def plan_of(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nested_points_move_once_by_test(spark, sf_dir):
    assert len(re.findall(r"Exchange hashpartitioning\(patient_id#\d+L, test_key#", plan_of(spark, sf_dir, "trend_nested"))) == 1


def test_names_are_joined_to_bloodwork_only(spark, sf_dir):
    joins = re.findall(r"SortMergeJoin \[(\w+)#", plan_of(spark, sf_dir, "trend_first_seen"))
    # The plan is printed from the top: parts are joined last.
    assert joins[0] in ("part_id", "l_partkey") and joins[1] in ("document_id", "l_orderkey"), joins
