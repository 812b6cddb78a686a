"""Only texts that may hold what is looked for are searched or parsed, with the same results."""

import datetime
import re

from clinframe import registry
from clinframe.functions import dates, header
from pyspark.sql import functions as F

SAID = ["2023-03-01 08:41", "2023-3-1", "+2023-3-1", "01.03.2023 8:5", "1/3/2023", "1-3-2023", "1 Mar 2023", "01 Mar 2023 08:41", "1 March 2023", "1 mar 2023", "2023-03-01t08:00:00", "2023-03-01T08:00:00", "32.1.2023", "1.3.23", "1.3.2023 ", "x", "", None]


def test_layouts_are_tried_by_shape(spark):
    df = spark.createDataFrame([(x,) for x in SAID], "x string")
    for layouts in (dates.LAYOUTS, dates.TITLE_LAYOUTS):
        each = df.select("x", dates._at(F.col("x"), layouts).alias("got"), F.coalesce(*[F.try_to_timestamp(F.col("x"), F.lit(a)) for a in layouts]).alias("want")).collect()
        assert [r for r in each if r.got != r.want] == [] and sum(isinstance(r.got, datetime.datetime) for r in each) >= 6
    assert re.match(dates.shape("d MMM yyyy H:m"), "1 Mar 2023 8:05") and not re.match(dates.shape("d MMM yyyy"), "1.3.2023")


def test_labels_are_looked_for_first(spark):
    assert [header.label_word(p) for p in header.IDENTIFIER] == ["pacient", "pacient", "patient", "observatie"] and header.label_word(header.LAB[1]) == "laborator"
    said = ["NUME: POP ANA", "nUmE POP ANA", "Pacient - POP ANA", "no", ""]
    df = spark.createDataFrame([(x,) for x in said], "x string").select(header.first_match(F.col("x"), header.NAME))
    assert [r[0] for r in df.collect()] == ["POP ANA", "POP ANA", "POP ANA", None, None]


def test_meta_fields_are_dealt(spark, sf_dir):
    assert "REPARTITION_BY_NUM" in registry.QUERIES["meta_fields"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
