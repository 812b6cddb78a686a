"""Lines and tokens of a report are listed once."""

from clinframe import registry


def test_report_assembly_lists_marks_once(spark, sf_dir):
    plan = registry.QUERIES["report_assembly"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # One list of marks, and three of tables: cells, rows, tables.
    assert plan.count("collect_list(") == 4, plan.count("collect_list(")
