"""Chart read models: cards, profiles, access, worklists, timelines, jobs.

All are joins, sums and windows over the logical tables. Labs are summed per document before anything is joined
to them, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinframe.functions import flags
from clinframe.sources.bindings import LAB_ORDER, SECTIONS
from clinframe.sources.scratch import written


def section_or_other(section: Column) -> Column:
    return F.when(section.isin(*SECTIONS), section).otherwise("other")


def abnormal_per_document(labs: DataFrame) -> DataFrame:
    return labs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_labs"), F.count_if(flags.worklist_abnormal(F.col("flag"))).alias("n_abnormal"))


def labs_per_document(labs: DataFrame) -> DataFrame:
    abnormal = flags.worklist_abnormal(F.col("flag"))
    return labs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_labs"), F.count_if(abnormal).alias("n_abnormal"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def with_counts(documents: DataFrame, labs: DataFrame) -> DataFrame:
    """Documents with n_labs and n_abnormal, 0 where there are no labs."""
    per = abnormal_per_document(labs).withColumnRenamed("document_id", "labs_of")
    return documents.join(per, F.col("id") == F.col("labs_of"), "left").drop("labs_of").fillna(0, ["n_labs", "n_abnormal"])


def with_labs(documents: DataFrame, labs: DataFrame) -> DataFrame:
    """with_counts() and categories, empty where there are no labs."""
    per = labs_per_document(labs).withColumnRenamed("document_id", "labs_of")
    return documents.join(per, F.col("id") == F.col("labs_of"), "left").drop("labs_of").fillna(0, ["n_labs", "n_abnormal"]).fillna("", ["categories"])


def cards(documents: DataFrame, labs: DataFrame) -> DataFrame:
    return with_counts(documents, labs).select(
        "id", "patient_id", section_or_other(F.col("section")).alias("section"), (F.col("is_verified") == 1).alias("is_verified"), (F.col("n_abnormal") > 0).alias("has_abnormal"),
    )


def section_counts(documents: DataFrame) -> DataFrame:
    section = section_or_other(F.col("section"))
    return documents.groupBy("patient_id").agg(*[F.count_if(section == s).alias(f"n_{s}") for s in SECTIONS])


def visible_patients(patients: DataFrame, access: DataFrame, role: str, user_id: int) -> DataFrame:
    """An admin sees all, a doctor those assigned, a patient itself."""
    if role == "admin":
        return patients
    if role == "doctor":
        mine = access.where(F.col("doctor_user_id") == user_id).select(F.col("patient_id").alias("__p"))
        return patients.join(mine, F.col("id") == F.col("__p"), "left_semi")
    return patients.where(F.col("id") == user_id)


def scopes(callers: DataFrame, patients: DataFrame, access: DataFrame) -> DataFrame:
    """(caller_id, role, patient_id): what each caller may see. A null patient stands for all of them, which an admin sees.

    callers: (caller_id, role); patients: (id, user_id). A doctor sees the patients of the bridge, a patient's user the row that
    is linked to it; callers without patients and unknown roles have no row.
    """
    admins = callers.where("role = 'admin'").select("caller_id", "role", F.lit(None).cast("long").alias("patient_id"))
    # Both sides once each, before they meet: the joined rows, which are many, aren't grouped again.
    doctors, pairs = callers.where("role = 'doctor'").distinct(), access.select("doctor_user_id", "patient_id").distinct()
    bridge = doctors.join(pairs, F.col("caller_id") == F.col("doctor_user_id")).select("caller_id", "role", "patient_id")
    own = callers.where("role = 'patient'").join(patients, F.col("caller_id") == F.col("user_id")).select("caller_id", "role", F.col("id").alias("patient_id"))
    return admins.unionByName(bridge).unionByName(own)


def scope_counts(scopes_: DataFrame, patients: DataFrame, documents: DataFrame) -> DataFrame:
    """(caller_id, role, n_patients, n_documents) of scopes(). Admins get the totals; no admin meets the patients one by one."""
    per = documents.groupBy(F.col("patient_id").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    listed = scopes_.where("patient_id IS NOT NULL").join(per, F.col("patient_id") == F.col("of"), "left")
    counted = listed.groupBy("caller_id", "role").agg(F.count(F.lit(1)).alias("n_patients"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"))
    n_patients, n_documents = patients.agg(F.count(F.lit(1)).alias("n_patients")), documents.agg(F.count(F.lit(1)).alias("n_documents"))
    key = F.lit("admin").alias("of_role")
    totals = n_patients.select(key, "n_patients").join(n_documents.select(key, "n_documents"), "of_role")
    all_ = scopes_.where("patient_id IS NULL").select("caller_id", "role").join(F.broadcast(totals), F.col("role") == F.col("of_role"))
    return counted.unionByName(all_.select("caller_id", "role", "n_patients", "n_documents"))


def search(patients: DataFrame, access: DataFrame, term: str, doctor_id: int) -> DataFrame:
    """Patients whose joined fields contain the term, and whether the doctor has access."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("full_name", F.lit("")), F.coalesce("patient_identifier", F.lit(""))))
    mine = access.where(F.col("doctor_user_id") == doctor_id).select(F.col("patient_id").alias("__p"), F.lit(True).alias("__has"))
    return patients.where(hay.contains(term.strip().lower())).join(mine, F.col("id") == F.col("__p"), "left").withColumn("has_access", F.coalesce("__has", F.lit(False))).drop("__p", "__has")


def worklist_counts(documents: DataFrame, labs: DataFrame, access: DataFrame, reviews: DataFrame) -> DataFrame:
    """Of each (doctor, patient): documents not reviewed, and abnormal labs in them.

    Both are the patient's totals less what the doctor has reviewed, so that documents aren't multiplied by doctors.
    """
    per_doc = with_counts(documents, labs).select("id", "patient_id", "n_abnormal")
    totals = per_doc.groupBy("patient_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_abnormal").alias("abnormal"))
    seen = reviews.join(per_doc, F.col("document_id") == F.col("id")).groupBy("doctor_user_id", "patient_id").agg(F.count(F.lit(1)).alias("seen_docs"), F.sum("n_abnormal").alias("seen_abnormal"))
    joined = access.join(totals, "patient_id", "left").join(seen, ["doctor_user_id", "patient_id"], "left").fillna(0)
    new = F.col("docs") - F.col("seen_docs")
    return joined.select("doctor_user_id", "patient_id", new.alias("new_records_count"), (F.col("abnormal") - F.col("seen_abnormal")).alias("abnormal_count"), (new > 0).alias("has_new_records"))


def first_abnormal(labs: DataFrame, n: int, *kept: str) -> DataFrame:
    """Of each document (labs_of) how many labs are abnormal, and the kept columns of the n first of them as a sorted array; with n = 0 no array."""
    order = [c for c in LAB_ORDER if c not in ("test_date", "document_id")]
    bad = flags.worklist_abnormal(F.col("flag"))
    listed = lambda: [F.slice(F.sort_array(F.collect_list(F.when(bad, F.struct(*order, *kept)))), 1, n).alias("first")]
    per = labs.groupBy(F.col("document_id").alias("labs_of")).agg(F.count_if(bad).alias("n_abnormal"), *(listed() if n else []))
    return per.withColumn("first", F.transform("first", lambda x: F.struct(*[x[c].alias(c) for c in kept]))) if n else per


def doctor_pairs(access: DataFrame, receipts: DataFrame, lists: bool) -> DataFrame:
    """Of each pair of the bridge what the doctor has seen of the patient: seen_docs, seen_abnormal and, if asked for, the documents' ids.

    receipts: (doctor_user_id, patient_id, id, n_abnormal), one row per doctor and document. Rows are dealt by patient, so that pairs
    meet their patient without moving again.
    """
    none = [F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n_abnormal")]
    seen = receipts.where("doctor_user_id IS NOT NULL").select("doctor_user_id", "patient_id", F.lit(0).alias("may_see"), "id", "n_abnormal")
    both = access.select("doctor_user_id", "patient_id", F.lit(1).alias("may_see"), *none).unionByName(seen).repartition("patient_id")
    pair = ["patient_id", "doctor_user_id"]
    if not lists:
        return both.groupBy(*pair).agg(F.max("may_see").alias("may_see"), F.count("id").alias("seen_docs"), F.sum("n_abnormal").alias("seen_abnormal")).where("may_see = 1")
    # A window lists ids in one pass over sorted rows, where a group by would list them twice; the bridge's row is the one that stays.
    w = Window.partitionBy(*pair)
    return both.select(*pair, "may_see", F.count("id").over(w).alias("seen_docs"), F.sum("n_abnormal").over(w).alias("seen_abnormal"), F.collect_list("id").over(w).alias("seen")).where("may_see = 1")


def not_seen(docs: Column, n: int) -> Column:
    """The n first of a patient's documents that a pair hasn't seen, or some more: what was seen hides no more than its own number, so only as many are looked at."""
    return F.filter(F.slice(docs, F.lit(1), F.size("seen") + n), lambda d: ~F.array_contains("seen", d["id"]))


def top_abnormal(documents: DataFrame, labs: DataFrame, access: DataFrame, reviews: DataFrame, n: int = 3) -> DataFrame:
    """The n first abnormal labs of each (doctor, patient)'s documents not reviewed, newest document first.

    A document gives n labs at most. A patient's documents are one sorted array, which meets its doctors once and isn't moved after
    that: rows are doctors by patients, not doctors by labs, and what a doctor has seen is joined to the pair before.
    """
    order = [c for c in LAB_ORDER if c not in ("test_date", "document_id")]
    bad = labs.where(flags.worklist_abnormal(F.col("flag"))).withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).where(F.col("rank") <= n)
    per_doc = bad.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("rank", "test_key", "flag"))).alias("first"))
    docs = documents.select("id", "patient_id")
    of_patient = docs.join(per_doc, F.col("id") == F.col("document_id")).drop("document_id")
    listed = of_patient.groupBy(F.col("patient_id").alias("of_patient")).agg(F.sort_array(F.collect_list(F.struct((-F.col("id")).alias("order"), "id", "first"))).alias("docs"))
    seen = reviews.join(docs, F.col("document_id") == F.col("id")).select("doctor_user_id", "patient_id", "id", F.lit(0).cast("long").alias("n_abnormal"))
    joined = doctor_pairs(access, seen, True).join(listed, F.col("patient_id") == F.col("of_patient"))
    lab = lambda d: F.transform(d["first"], lambda x: F.struct(d["id"].alias("document_id"), x["test_key"].alias("test_key"), x["flag"].alias("flag")))
    first = F.slice(F.flatten(F.transform(not_seen(F.col("docs"), n), lab)), 1, n)
    # The outer form: Spark would make the array once more, to filter rows where it is empty.
    each = joined.select("doctor_user_id", "patient_id", first.alias("labs")).select("doctor_user_id", "patient_id", F.posexplode_outer("labs").alias("place", "lab")).where("place IS NOT NULL")
    return each.select("doctor_user_id", "patient_id", "lab.document_id", "lab.test_key", "lab.flag", (F.col("place") + 1).alias("place"))


def worklist_rows(documents: DataFrame, labs: DataFrame, access: DataFrame, reviews: DataFrame, n: int = 3) -> DataFrame:
    """worklist_counts() and the test keys of top_abnormal() as one array, from one aggregation of labs per document.

    Documents with their counts and first labs are written once, for the patients' totals and for what was reviewed; access and
    receipts meet in one group by (doctor, patient). With n = 0 there are no test keys, and no lists are made for them.
    """
    lists = n > 0
    docs = documents.select("id", "patient_id").join(first_abnormal(labs, n, "test_key"), F.col("id") == F.col("labs_of"), "left")
    docs = docs.select("id", "patient_id", F.coalesce("n_abnormal", F.lit(0)).alias("n_abnormal"), *([F.transform("first", lambda x: x["test_key"]).alias("first")] if lists else []))
    docs = written(docs, "worklist-documents")
    listed = lambda: [F.sort_array(F.collect_list(F.when(F.coalesce(F.size("first"), F.lit(0)) > 0, F.struct((-F.col("id")).alias("order"), "id", "first")))).alias("listed")]
    totals = docs.groupBy(F.col("patient_id").alias("of_patient")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_abnormal").alias("abnormal"), *(listed() if lists else []))
    seen = reviews.join(docs.select("id", "patient_id", "n_abnormal"), F.col("document_id") == F.col("id"))
    joined = doctor_pairs(access, seen, lists).join(totals, F.col("patient_id") == F.col("of_patient"), "left").fillna(0, ["docs", "abnormal"])
    count = F.col("docs") - F.col("seen_docs")
    counts = [count.alias("new_records_count"), (F.col("abnormal") - F.col("seen_abnormal")).alias("abnormal_count"), (count > 0).alias("has_new_records")]
    if not lists:
        return joined.select("doctor_user_id", "patient_id", *counts)
    listed = F.coalesce("listed", F.array().cast("array<struct<order:bigint,id:bigint,first:array<string>>>"))
    names = F.slice(F.flatten(F.transform(not_seen(listed, n), lambda d: d["first"])), 1, n)
    return joined.select("doctor_user_id", "patient_id", *counts, names.alias("abnormal_keys"))


def care_context(patients: DataFrame, events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """active with the latest active event, past with the latest event, or outpatient; and the patients' columns to keep."""
    latest = lambda cond: F.max_by(F.struct("id", "event_type"), F.when(cond, F.col("id")))
    per = events.groupBy("patient_id").agg(latest(F.col("status") == "active").alias("active"), latest(F.lit(True)).alias("last"), F.count_if(F.col("status") == "active").alias("n_active"))
    joined = patients.join(per, F.col("id") == F.col("patient_id"), "left")
    event = F.when(F.col("n_active") > 0, F.col("active")).otherwise(F.col("last"))
    context = F.when(F.col("n_active") > 0, "active").when(F.col("last").isNotNull(), "past").otherwise("outpatient")
    return joined.select(patients["id"].alias("patient_id"), context.alias("care_context"), event["id"].alias("event_id"), event["event_type"].alias("event_type"), *keep)


def assignments(access: DataFrame, doctors: DataFrame, patients: DataFrame) -> DataFrame:
    d = doctors.select(F.col("id").alias("__d"), F.col("full_name").alias("doctor_name"), "hospital_name")
    p = patients.select(F.col("id").alias("__p"), F.col("full_name").alias("patient_name"))
    return access.join(d, F.col("doctor_user_id") == F.col("__d"), "left").join(p, F.col("patient_id") == F.col("__p"), "left").drop("__d", "__p")


def timeline(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Document and event items of all patients."""
    d = documents.select("patient_id", F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("item_id"), F.lit("document").alias("item_type"), F.col("test_date").alias("item_at"), section_or_other(F.col("section")).alias("title"))
    e = events.select("patient_id", F.concat(F.lit("event-"), F.col("id").cast("string")).alias("item_id"), F.lit("event").alias("item_type"), F.col("admitted_at").alias("item_at"), F.col("event_type").alias("title"))
    return d.unionByName(e)


def timeline_days(items: DataFrame) -> DataFrame:
    """One row per (patient, day), newest first, marked where a year begins in that order."""
    per = items.groupBy("patient_id", F.to_date("item_at").alias("day")).agg(F.count(F.lit(1)).alias("n_items"))
    w = Window.partitionBy("patient_id").orderBy(F.col("day").desc_nulls_last())
    year = F.year("day")
    return per.withColumn("starts_year", ~F.coalesce(F.lag(year).over(w) == year, F.lit(False)))


def first_page(rows: DataFrame, key: str, order: list[Column], n: int = 10) -> DataFrame:
    """The first n rows of each key, and how many more there are.

    Rows are counted apart from the ranking, so that a partition keeps n rows of a key and not all.
    """
    sizes = rows.groupBy(F.col(key).alias("size_of")).agg(F.count(F.lit(1)).alias("size"))
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
    return top.join(sizes, F.col(key).eqNullSafe(F.col("size_of"))).withColumn("hidden_count", F.greatest(F.col("size") - n, F.lit(0))).drop("size_of", "size")


def latest_state(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key of an append-only log."""
    return events.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")
