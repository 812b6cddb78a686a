"""Read models of records: cards, payloads, profiles, access, requests, job lists.

Labs, logs and documents are summed or collected per parent before they are joined to it, so no join multiplies rows.
Nested results are arrays of structs, newest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinframe.functions import dates, flags, texts
from clinframe.operators import chart
from clinframe.sources.bindings import SECTIONS

#: What a request, a role and a job may be.
STATES = ["pending", "approved", "denied"]
ROLES = ["admin", "doctor", "patient"]
JOB_STATES = ["done", "error", "processing", "uploading"]
ACTIVE_JOBS = ["queued", "uploading", "processing"]
JOB_FINISHED_SECONDS = 7


def public_users(users: DataFrame) -> DataFrame:
    """Users without their secrets."""
    return users.select("id", "full_name", "email", "role", "department", "hospital_name")


def abnormal_documents(labs: DataFrame) -> DataFrame:
    return labs.where(flags.worklist_abnormal(F.col("flag"))).select(F.col("document_id").alias("abnormal_id")).distinct()


def document_cards(documents: DataFrame, labs: DataFrame, users: DataFrame, reviews: DataFrame, doctor_id: int) -> DataFrame:
    """What lists show of documents to a doctor: title, dates, uploader, note, and whether it is abnormal, reviewed and theirs to edit."""
    who = users.select(F.col("id").alias("who_id"), F.col("full_name").alias("uploader"), F.col("hospital_name").alias("uploader_hospital"))
    mine = reviews.where(F.col("doctor_user_id") == doctor_id).select(F.col("document_id").alias("mine_id")).distinct()
    cards = documents.join(who, F.col("uploaded_by") == F.col("who_id"), "left").join(abnormal_documents(labs), F.col("id") == F.col("abnormal_id"), "left").join(mine, F.col("id") == F.col("mine_id"), "left")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    return cards.select(
        "id", "patient_id", chart.section_or_other(F.col("section")).alias("section"), "filename", texts.document_title(F.col("report_name"), F.col("filename"), F.col("id")).alias("title"), (F.col("is_verified") == 1).alias("is_verified"),
        F.col("abnormal_id").isNotNull().alias("has_abnormal"), F.col("mine_id").isNotNull().alias("reviewed_by_me"), texts.preview(F.col("note")).alias("note_preview"),
        ((F.col("section") == "notes") & F.coalesce(F.col("uploaded_by") == doctor_id, F.lit(False))).alias("can_edit_note"), texts.joined(F.col("uploader"), F.col("uploader_hospital")).alias("uploaded_by"),
        dates.date_label(none, day("test_date"), none, none).alias("date_label"), (F.col("abnormal_id").isNotNull() & F.col("mine_id").isNull()).alias("needs_review"),
    )


#: What a document's card has of the document itself.
CARD_FIELDS = [
    "id", "filename", "content_type", "report_name", "report_type", "lab_name", "sample_type", "referring_doctor", "test_date", "collected_on", "reported_on", "registered_on", "generated_on", "created_at", "section",
]


def whole_cards(documents: DataFrame, labs: DataFrame, users: DataFrame, reviews: DataFrame, viewer: int, role: str = "doctor") -> DataFrame:
    """All fields of a document's card for a viewer; uploaded_by is the public part of the uploader's row, null where it is missing.

    documents: CARD_FIELDS, is_verified, uploaded_by, note. Only doctors have reviewed documents; notes are edited by who wrote them.
    """
    public = public_users(users)
    who = public.select(F.col("id").alias("who_id"), F.struct(*public.columns).alias("who"))
    mine = reviews.where(F.col("doctor_user_id") == viewer).select(F.col("document_id").alias("mine_id")).distinct()
    cards = documents.join(who, F.col("uploaded_by") == F.col("who_id"), "left").join(abnormal_documents(labs), F.col("id") == F.col("abnormal_id"), "left").join(mine, F.col("id") == F.col("mine_id"), "left")
    abnormal, reviewed = F.col("abnormal_id").isNotNull(), F.col("mine_id").isNotNull() if role == "doctor" else F.lit(False)
    return cards.select(
        *CARD_FIELDS, (F.coalesce(F.col("is_verified"), F.lit(0)) != 0).alias("is_verified"), abnormal.alias("has_abnormal"), abnormal.alias("has_abnormal_labs"), reviewed.alias("reviewed_by_current_doctor"), F.col("who").alias("uploaded_by"),
        texts.preview(F.col("note")).alias("note_preview"), F.coalesce((F.col("section") == "notes") & (F.col("uploaded_by") == viewer), F.lit(False)).alias("can_edit_note"),
    )


def event_cards(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with their doctor's name, null where the doctor is missing."""
    who = users.select(F.col("id").alias("who_id"), F.col("full_name").alias("doctor_name"))
    return events.join(who, F.col("doctor_user_id") == F.col("who_id"), "left").drop("who_id")


def access_cards(access: DataFrame, users: DataFrame) -> DataFrame:
    """Access links with their doctor; a missing doctor has empty names and no hospital."""
    who = users.select(F.col("id").alias("who_id"), F.col("full_name").alias("doctor_name"), F.col("email").alias("doctor_email"), "hospital_name")
    return access.join(who, F.col("doctor_user_id") == F.col("who_id"), "left").drop("who_id").fillna("", ["doctor_name", "doctor_email"])


def payload(documents: DataFrame, labs: DataFrame, logs: DataFrame) -> DataFrame:
    """Documents with their labs and their log entries as arrays, in order; empty arrays where there are none."""
    lab = F.struct("line_no", "part_id", "test_key", "value", "flag")
    of_labs = labs.groupBy(F.col("document_id").alias("lab_of")).agg(F.array_sort(F.collect_list(lab)).alias("labs"))
    of_logs = logs.groupBy(F.col("document_id").alias("log_of")).agg(F.array_sort(F.collect_list(F.struct("at", "action", "actor"))).alias("audit_logs"))
    both = documents.join(of_labs, F.col("id") == F.col("lab_of"), "left").join(of_logs, F.col("id") == F.col("log_of"), "left").drop("lab_of", "log_of")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return both.select(*documents.columns, empty("labs"), empty("audit_logs"))


def profiles(patients: DataFrame, cards: DataFrame, events: DataFrame, access: DataFrame) -> DataFrame:
    """Patients with a map of sections to cards (newest first), their events (latest admission first) and doctors."""
    card = F.struct((-F.col("id")).alias("order"), "id", "title", "has_abnormal")
    of_section = cards.groupBy("patient_id", "section").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    sections = of_section.groupBy(F.col("patient_id").alias("section_of")).agg(F.map_from_entries(F.collect_list(F.struct("section", "cards"))).alias("sections"))
    event = F.struct("admitted_at", "id", "event_type", "status", "doctor_name")
    of_events = events.groupBy(F.col("patient_id").alias("event_of")).agg(F.reverse(F.array_sort(F.collect_list(event))).alias("events"))
    of_access = access.groupBy(F.col("patient_id").alias("access_of")).agg(F.array_sort(F.collect_list(F.struct("doctor_user_id", "doctor_name"))).alias("doctor_access"))
    joined = patients.join(sections, F.col("id") == F.col("section_of"), "left").join(of_events, F.col("id") == F.col("event_of"), "left").join(of_access, F.col("id") == F.col("access_of"), "left")
    return joined.drop("section_of", "event_of", "access_of")


def section_cards(sections: Column, section: str) -> Column:
    """A section's cards, or an empty array."""
    return F.coalesce(F.try_element_at(sections, F.lit(section)), F.array())


def flat_sections(sections: Column, names: list[str] = SECTIONS) -> Column:
    """All cards of the named sections, section by section; a patient's own page leaves notes out."""
    return F.flatten(F.array_compact(F.array(*[F.try_element_at(sections, F.lit(s)) for s in names])))


def assignments(access: DataFrame, users: DataFrame, patients: DataFrame) -> DataFrame:
    """Assignments with the names of doctor, patient and granter, each null where missing."""
    who = lambda at, name: users.select(F.col("id").alias(at), F.col("full_name").alias(name))
    named = access.join(who("d_id", "doctor_name"), F.col("doctor_user_id") == F.col("d_id"), "left").join(who("g_id", "granted_by"), F.col("granted_by_user_id") == F.col("g_id"), "left")
    return named.join(patients.select(F.col("id").alias("p_id"), F.col("full_name").alias("patient_name")), F.col("patient_id") == F.col("p_id"), "left").drop("d_id", "g_id", "p_id")


def requests_named(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Access requests with their doctor, newest first within a patient."""
    who = users.select(F.col("id").alias("d_id"), F.col("full_name").alias("doctor_name"), F.col("hospital_name").alias("doctor_hospital_name"))
    named = requests.join(who, F.col("doctor_user_id") == F.col("d_id"), "left").drop("d_id")
    return named.withColumn("place", F.row_number().over(Window.partitionBy("patient_id").orderBy(F.col("id").desc())).cast("int"))


def search_with_requests(patients: DataFrame, access: DataFrame, requests: DataFrame, term: str, doctor_id: int, role: str = "doctor") -> DataFrame:
    """Patients whose joined fields contain the term: whether the doctor has access, or has asked for it. An admin has access to all."""
    found = chart.search(patients, access, term, doctor_id)
    if role == "admin":
        return found.withColumns({"has_access": F.lit(True), "has_pending_request": F.lit(False)})
    asked = requests.where((F.col("doctor_user_id") == doctor_id) & (F.col("status") == "pending")).select(F.col("patient_id").alias("asked")).distinct()
    return found.join(asked, F.col("id") == F.col("asked"), "left").withColumn("has_pending_request", F.col("asked").isNotNull()).drop("asked")


def touching(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) of which either end is one of the documents: a join for each end, not one with OR."""
    ids = documents.select(F.col("id").alias("end"))
    return links.join(ids, F.col("a") == F.col("end"), "left_semi").unionByName(links.join(ids, F.col("b") == F.col("end"), "left_semi")).distinct()


def one(table: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; the filter reaches the scan."""
    return table.where(F.col(key) == F.lit(value)).limit(1)


def allowed(rows: DataFrame) -> DataFrame:
    """Rows (role, section, request_status) whose values are of the allowed sets."""
    return rows.where(F.col("role").isin(*ROLES) & F.col("section").isin(*SECTIONS) & F.col("request_status").isin(*STATES))


def job_state(status: Column) -> Column:
    """A job's state as pages know it; unknown ones are queued."""
    return F.when(status.isin(*JOB_STATES), status).otherwise("queued")


def merge_tasks(tasks: DataFrame, jobs: DataFrame, now: Column, most: int = 30) -> DataFrame:
    """A user's upload tasks after the server's jobs (both by user_id, job_id): known ones are updated, new ones added.

    Size and patient's name stay the task's own; finished ones go after seven seconds; the newest `most` are kept.
    """
    j = jobs.select(F.col("user_id").alias("j_user"), F.col("job_id").alias("j_id"), F.col("filename").alias("j_name"), job_state(F.col("status")).alias("j_status"), F.col("progress").alias("j_progress"), F.col("created_at").alias("j_created"), F.col("finished_at").alias("j_finished"))
    both = tasks.join(j, (F.col("user_id") == F.col("j_user")) & (F.col("job_id") == F.col("j_id")), "full_outer")
    new = lambda a, b: F.when(F.col("j_id").isNotNull(), F.col(a)).otherwise(F.col(b))
    merged = both.select(
        F.coalesce("user_id", "j_user").alias("user_id"), F.coalesce("id", F.concat(F.lit("job-"), F.col("j_id").cast("string"))).alias("id"), F.coalesce("job_id", "j_id").alias("job_id"), new("j_name", "filename").alias("filename"),
        F.coalesce("size", F.lit(0)).alias("size"), "patient_name", new("j_status", "status").alias("status"), F.coalesce(new("j_progress", "progress"), F.lit(0)).alias("progress"), new("j_created", "created_at").alias("created_at"),
        new("j_finished", "finished_at").alias("finished_at"),
    )
    running = F.col("status").isin(*ACTIVE_JOBS) | F.col("finished_at").isNull()
    kept = merged.where(running | (F.unix_timestamp(now) - F.unix_timestamp("finished_at") < JOB_FINISHED_SECONDS))
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_last(), "id")
    return kept.withColumn("place", F.row_number().over(order).cast("int")).where(F.col("place") <= most)
