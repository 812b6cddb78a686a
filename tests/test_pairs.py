"""Pairs of doctors and patients meet a patient's lists once: what is moved are the lists, not lists by doctors."""

import re

from clinframe import registry
from clinframe.operators import chart

LAB = "document_id long, line_no int, part_id long, doctor_user_id long, quantity double, price double, discount double, tax double, ship_date date, test_key string, flag string"


def test_top_abnormal_moves_no_lists_by_doctors(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["worklist_top3_abnormal"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Pairs and the documents' lists are joined last, by patient alone.
    assert re.search(r"Join \w+, \(?(\w+#\d+L?) = ", plan).group(0).count("patient") == 1
    assert "doctor_user_id" not in re.search(r"Join .*", plan).group(0)


def test_top_abnormal_of_seen_documents(spark):
    """A doctor without an id has seen nothing; whoever has seen more documents than are asked for gets the next ones."""
    lab = lambda d, i, flag="High": (d, i, 1, 1, 1.0, 1.0, 0.0, 0.0, None, f"t{d}.{i}", flag)
    labs = spark.createDataFrame([lab(d, i) for d in range(1, 8) for i in (1, 2)] + [lab(8, 1, "Normal")], LAB)
    documents = spark.createDataFrame([(d, 5) for d in range(1, 9)], "id long, patient_id long")
    access = spark.createDataFrame([(1, 5), (2, 5), (None, 5), (3, 6)], "doctor_user_id long, patient_id long")
    reviews = spark.createDataFrame([(1, d) for d in (8, 7, 6, 5, 3)] + [(None, 7), (9, 7)], "doctor_user_id long, document_id long")
    got = {(r.doctor_user_id, r.place): r.test_key for r in chart.top_abnormal(documents, labs, access, reviews).collect()}
    newest = {1: "t7.1", 2: "t7.2", 3: "t6.1"}
    assert got == {(1, 1): "t4.1", (1, 2): "t4.2", (1, 3): "t2.1"} | {(d, p): t for d in (2, None) for p, t in newest.items()}


def test_no_term_looks_at_no_text(spark):
    """An empty term is in every text, so none is put together for it."""
    from clinframe.operators import pages
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "A"), (2, None)], "id long, name string").where(pages.contains_term(" ", F.col("name")))
    assert "name" not in rows.select("id")._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0].replace("Project [id#", "") and rows.count() == 2
