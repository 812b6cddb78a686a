"""What plans are made of, with broadcasts off."""

import re

from clinframe.plans import records


def test_worklist_reads_each_table_once(spark, sf_dir):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = records._worklist(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    exchanges, scans = len(re.findall(r"[ -] Exchange hashpartitioning", plan)), len(re.findall("FileScan", plan))
    # Beside documents, written once: access, receipts, patients and events.
    assert exchanges <= 12 and scans <= 8, (exchanges, scans)
