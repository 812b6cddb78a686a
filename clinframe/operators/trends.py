"""Bloodwork trends: the last points of every (patient, test) and what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinframe.functions import dates, flags, numbers, texts
from clinframe.sources.bindings import LAB_ORDER


def points(labs: DataFrame, documents: DataFrame) -> DataFrame:
    """Numeric lab values of bloodwork documents with patient and date.

    The join is on document id; Spark broadcasts the filtered documents where they are small enough.
    """
    docs = documents.where(F.col("section") == "bloodwork").select(F.col("id").alias("__doc"), "patient_id", "test_date")
    return labs.join(docs, F.col("document_id") == F.col("__doc")).drop("__doc").withColumn("value_num", numbers.lab_value(F.col("value"))).where(F.col("value_num").isNotNull())


def identity(canonical, display, raw):
    """The name by which a test's points belong together."""
    return texts.first_filled(canonical, display, raw)


def first_seen(pts: DataFrame) -> DataFrame:
    """(patient_id, test_key) with the display name and category of the first lab scanned, not of the latest."""
    order = F.struct(*[F.col(c) for c in LAB_ORDER if c != "test_date"])
    first = F.min_by(F.struct("display_name", "category"), order)
    return pts.groupBy("patient_id", "test_key").agg(first.alias("first")).select("patient_id", "test_key", F.col("first.display_name").alias("display_name"), F.col("first.category").alias("category"))


def recency_window():
    return Window.partitionBy("patient_id", "test_key").orderBy(*[F.col(c).desc() for c in LAB_ORDER])


def last_points(pts: DataFrame, n: int = 5) -> DataFrame:
    """The n most recent points of each (patient, test), rn = 1 the latest."""
    return pts.withColumn("rn", F.row_number().over(recency_window())).where(F.col("rn") <= n)


def summary(last: DataFrame) -> DataFrame:
    """Of each (patient, test): points kept, latest and previous value, their difference, and the latest flag."""
    at = lambda column, n: F.max(F.when(F.col("rn") == n, F.col(column)))
    per = last.groupBy("patient_id", "test_key").agg(F.count(F.lit(1)).alias("n_points"), at("value_num", 1).alias("latest"), at("value_num", 2).alias("previous"), at("flag", 1).alias("latest_flag"))
    return per.withColumn("delta", F.round(F.col("latest") - F.col("previous"), 2))


def ordered(summaries: DataFrame) -> DataFrame:
    """Tests of a patient with the abnormal ones first, then by name."""
    w = Window.partitionBy("patient_id").orderBy(flags.trend_abnormal(F.col("latest_flag")).desc(), F.coalesce("test_key", F.lit("")))
    return summaries.withColumn("place", F.row_number().over(w).cast("int"))


#: What a nested trend's point holds.
POINT = ["document_id", "date", "value", "value_display", "flag", "report_name", "reference_range"]


def nested(labs: DataFrame, documents: DataFrame, n: int = 5) -> DataFrame:
    """One row per patient and test: names, category and unit of its first lab, its last n points in order, latest, previous, delta.

    labs: (document_id, line_no, canonical_name, display_name, raw_test_name, category, unit, value, flag, reference_range);
    documents: (id, patient_id, section, report_name, filename and the six dates of dates.best_document_date). Values that are
    nil are no points; a lab without a name belongs to no test. Points follow the strict date key (dates.iso_key: what isn't
    an ISO date counts as 0), then document and line. `place`: a patient's tests, abnormal ones first, then by display name, then
    by key. Points are moved once by patient and test: names and last points come from the same sorted rows.
    """
    date = F.coalesce(dates.best_document_date(*[F.col(c) for c in ("test_date", "collected_on", "reported_on", "generated_on", "registered_on", "created_at")]), F.lit(""))
    docs = documents.where("section = 'bloodwork'").select(F.col("id").alias("of"), "patient_id", date.alias("date"), texts.first_filled(F.col("report_name"), F.col("filename")).alias("report_name"))
    key = F.trim(F.coalesce(identity(F.col("canonical_name"), F.col("display_name"), F.col("raw_test_name")), F.lit("")))
    shown = F.coalesce(texts.first_filled(F.col("display_name"), F.col("canonical_name"), F.col("raw_test_name")), key)
    pts = labs.withColumns({"test_key": key, "shown": shown, "value_num": numbers.lab_value(F.col("value"))}).where("value_num IS NOT NULL AND test_key <> ''").join(docs, F.col("document_id") == F.col("of"))
    pts = pts.withColumn("at", dates.iso_key(F.col("date")))
    of_test = Window.partitionBy("patient_id", "test_key")
    first = F.min_by(F.struct(F.col("shown").alias("display_name"), "canonical_name", "category", "unit"), F.struct("document_id", "line_no")).over(of_test)
    w = of_test.orderBy(F.desc("at"), F.desc("document_id"), F.desc("line_no"))
    point = F.struct("document_id", "date", F.col("value_num").alias("value"), F.trim("value").alias("value_display"), "flag", "report_name", "reference_range")
    placed = pts.withColumns({"first": first, "rn": F.row_number().over(w)}).where(F.col("rn") <= n)
    last = placed.groupBy("patient_id", "test_key").agg(F.first("first").alias("first"), F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("o"), point.alias("p")))).alias("sorted"))
    trends = last.select("patient_id", "test_key", "first.*", F.transform("sorted", lambda x: x["p"]).alias("points"))
    trends = trends.withColumns({"latest": F.try_element_at("points", F.lit(-1)), "previous": F.try_element_at("points", F.lit(-2))}).withColumn("delta", F.round(F.col("latest.value") - F.col("previous.value"), 2))
    order = Window.partitionBy("patient_id").orderBy(F.coalesce(flags.trend_abnormal(F.col("latest.flag")), F.lit(False)).desc(), F.coalesce("display_name", F.lit("")), "test_key")
    return trends.withColumn("place", F.row_number().over(order).cast("int"))
