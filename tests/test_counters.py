"""Counters of worklists ask for no names, so that no lists are made for them."""

from clinframe import registry


def test_worklist_counters_make_no_lists(spark, sf_dir, monkeypatch):
    from clinframe.operators import chart

    kept = []
    monkeypatch.setattr(chart, "written", lambda df, name: kept.append(df.columns) or df)
    plan = registry.QUERIES["worklist_counters"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert kept == [["id", "patient_id", "n_abnormal"]]
    assert "collect_" not in plan
