"""Name -> query and name -> oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from clinframe.plans import chart, extract, records, reports, rules, scalars

QUERIES = {**chart.QUERIES, **scalars.QUERIES, **extract.QUERIES, **rules.QUERIES, **records.QUERIES, **reports.QUERIES}
ORACLE = {**chart.ORACLE, **scalars.ORACLE, **extract.ORACLE, **rules.ORACLE, **records.ORACLE, **reports.ORACLE}
FLAGSHIP = "trend_last5"
