"""What pages make of read models: filters, counters, orders, groups, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinframe.functions import dates

#: Words of tests that come first among trends, in this order.
PRIORITY = [
    "rbc", "red blood", "hemoglobin", "hgb", "hematocrit", "hct", "mcv", "mch", "mchc", "rdw", "wbc", "white blood", "neut", "lymph", "mono", "eosin", "baso", "platelet", "plt", "mpv", "glucose", "creatinine",
    "creatinina", "urea", "alt", "ast", "bilirubin", "cholesterol", "triglyceride", "tsh",
]
MODES = ["all", "active", "inactive", "new", "abnormal"]


def contains_term(term: str, *fields: Column) -> Column:
    """Do the fields that aren't empty, joined by blanks, contain the term in any case?"""
    if not term.strip():
        return F.lit(True)
    kept = F.filter(F.array(*fields), lambda f: F.coalesce(f, F.lit("")) != "")
    return F.lower(F.array_join(kept, " ")).contains(term.strip().lower())


def in_mode(mode: str, active: Column, new: Column, abnormal: Column) -> Column:
    n = lambda c: F.coalesce(c, F.lit(0)) > 0
    return {"all": F.lit(True), "active": active, "inactive": ~active, "new": n(new), "abnormal": n(abnormal)}[mode]


def worklist(rows: DataFrame, mode: str = "all", term: str = "") -> DataFrame:
    """A doctor's patients (doctor_user_id, full_name, patient_identifier, care_context, new_records_count, abnormal_count, abnormal_names) in order.

    Active admissions first, then patients with abnormal labs, then with new records, then by name.
    """
    active = F.col("care_context") == "active"
    kept = rows.where(in_mode(mode, active, F.col("new_records_count"), F.col("abnormal_count"))).where(contains_term(term, *[F.col(c) for c in ("full_name", "patient_identifier", "care_context", "abnormal_names")]))
    order = [active.desc(), (F.coalesce("abnormal_count", F.lit(0)) > 0).desc(), (F.coalesce("new_records_count", F.lit(0)) > 0).desc(), "full_name", "patient_id"]
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("doctor_user_id").orderBy(*order)).cast("int"))


def counters(rows: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Of each key how many rows there are, and how many meet each condition."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def card_theme(abnormal: Column, active: Column) -> Column:
    return F.when(F.coalesce(abnormal, F.lit(0)) > 0, "danger").when(active, "success").otherwise("default")


def board(patients: DataFrame, access: DataFrame, care: DataFrame, abnormal: DataFrame, mode: str = "all", term: str = "") -> DataFrame:
    """All patients with their doctors' names, care and abnormal labs: active ones first, then abnormal ones, then by name.

    access: (patient_id, doctor_name); care: (patient_id, care_context); abnormal: (patient_id, abnormal_count).
    """
    doctors = access.groupBy(F.col("patient_id").alias("d_of")).agg(F.array_join(F.array_sort(F.collect_set("doctor_name")), ", ").alias("doctors"), F.count(F.lit(1)).alias("n_doctors"))
    joined = patients.join(doctors, F.col("id") == F.col("d_of"), "left").join(care.withColumnRenamed("patient_id", "c_of"), F.col("id") == F.col("c_of"), "left").join(abnormal.withColumnRenamed("patient_id", "a_of"), F.col("id") == F.col("a_of"), "left")
    rows = joined.drop("d_of", "c_of", "a_of").fillna(0, ["n_doctors", "abnormal_count"]).fillna("", ["doctors"]).withColumn("is_unassigned", F.col("n_doctors") == 0)
    active = F.col("care_context") == "active"
    return rows.where(in_mode(mode, active, F.lit(0), F.col("abnormal_count"))).where(contains_term(term, F.col("full_name"), F.col("patient_identifier"), F.col("doctors")))


def board_order() -> list[Column]:
    return [(F.col("care_context") == "active").desc(), (F.col("abnormal_count") > 0).desc(), F.col("full_name"), F.col("id")]


def trend_priority(*names: Column) -> Column:
    """Place of the first priority word that the names contain; 999 for none."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(n, F.lit("")) for n in names]))
    found = F.lit(999)
    for i, word in reversed(list(enumerate(PRIORITY))):
        found = F.when(hay.contains(word), F.lit(i)).otherwise(found)
    return found


def recut(points: DataFrame, n: int = 5) -> DataFrame:
    """A trend's last n points (rn = 1 the latest) in ascending order, each with the one before it and the difference."""
    w = Window.partitionBy("patient_id", "test_key").orderBy(F.col("rn").desc())
    before = F.lag("value_num").over(w)
    return points.where(F.col("rn") <= n).withColumn("previous", before).withColumn("delta", F.round(F.col("value_num") - before, 2)).withColumn("place", F.row_number().over(w).cast("int"))


def axis(low: Column, high: Column) -> Column:
    """Five ticks from low to high with 18 percent around; three around one value."""
    flat = F.when(F.abs(low) < 1, 0.5).otherwise(F.abs(low) * 0.15)
    pad = (high - low) * 0.18
    step = (high - low + pad * 2) / 4
    return F.when(low == high, F.array(low - flat, low, low + flat)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: low - pad + step * i))


def domain(low: Column, high: Column) -> Column:
    """Bottom and top of a chart: 22 percent around the values, or around a quarter of a single value (1 at least)."""
    spread = F.when(high > low, high - low).otherwise(F.greatest(F.abs(high) * 0.25, F.lit(1.0)))
    return F.struct((low - spread * 0.22).alias("bottom"), (high + spread * 0.22).alias("top"))


def axis_number(value: Column) -> Column:
    """0 decimals from 100 on, 1 from 10 on, else 2 or 3 without zeros at the end."""
    bare = lambda n: F.regexp_replace(F.format_string(f"%.{n}f", value), r"\.?0+$", "")
    size = F.abs(value)
    return F.when(size >= 100, F.format_string("%.0f", value)).when(size >= 10, F.format_string("%.1f", value)).when(size >= 1, bare(2)).otherwise(bare(3))


def filtered_timeline(items: DataFrame, sections: list[str], year: int | None = None) -> DataFrame:
    """Items (section, item_at) of any of the sections (all for none), of one year if it is given."""
    kept = items.where(F.col("section").isin(*sections)) if sections else items
    return kept.where(F.year("item_at") == year) if year is not None else kept


def unverified(documents: DataFrame, tab: str = "all", term: str = "") -> DataFrame:
    """Documents that wait for verification: all, blood work or other, whose fields contain the term."""
    waiting = documents.where(F.col("is_verified") == 0)
    if tab != "all":
        waiting = waiting.where((F.col("section") == "bloodwork") if tab == "bloodwork" else (F.col("section") != "bloodwork"))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("patient_name", "filename", "report_name", "section")]))
    return waiting.where(hay.contains(term.strip().lower()))


def log_page(logs: DataFrame, names: DataFrame, term: str = "") -> DataFrame:
    """Log entries (actor_id, patient_id, action, timestamp) with names, newest timestamp text first, whose fields contain the term."""
    who = names.select(F.col("id").alias("w_id"), F.col("full_name").alias("actor_name"))
    joined = logs.join(who, F.col("actor_id") == F.col("w_id"), "left").drop("w_id")
    return joined.where(contains_term(term, *[F.col(c) for c in ("actor_name", "action", "timestamp")]))


def hospitalizations(events: DataFrame, mode: str = "all") -> DataFrame:
    """A patient's events: all, active or past; by discharge or else admission, latest first."""
    active = F.col("status") == "active"
    kept = {"all": events, "active": events.where(active), "past": events.where(~active)}[mode]
    at = dates.event_date(F.col("discharged_at"), F.col("admitted_at"))
    return kept.withColumn("event_date", at).withColumn("place", F.row_number().over(Window.partitionBy("patient_id").orderBy(F.coalesce(at, F.lit("")).desc(), F.col("id").desc())).cast("int"))


def doctor_choices(doctors: DataFrame, access: DataFrame, patient_id: int, term: str = "") -> DataFrame:
    """Doctors whose name or hospital contains the term, marked where they are assigned to the patient."""
    mine = access.where(F.col("patient_id") == patient_id).select(F.col("doctor_user_id").alias("m_id")).distinct()
    found = doctors.where(contains_term(term, F.col("full_name"), F.col("hospital_name")))
    return found.join(mine, F.col("id") == F.col("m_id"), "left").withColumn("is_assigned", F.col("m_id").isNotNull()).drop("m_id")
