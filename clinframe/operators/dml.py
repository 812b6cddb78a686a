"""Changes as transforms: each returns the table's new content, which the caller writes.

A change of one row never rewrites by key lookup on the driver: it is an anti join plus a union, or a conditional
column, and applies to any number of changes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_missing(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with those rows of new whose keys it doesn't have, once each (get-or-create, receipts, assignments)."""
    fresh = new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """children with all rows of the parents in new replaced by new's."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*children.columns))


def delete_cascade(documents: DataFrame, dependents: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """documents without the ids in gone, and each dependent table without their rows. dependents: name -> (table, key)."""
    ids = gone.select(F.col("id").alias("gone_id")).distinct()
    out = {"documents": documents.join(ids, F.col("id") == F.col("gone_id"), "left_anti")}
    for name, (table, key) in dependents.items():
        out[name] = table.join(ids, F.col(key) == F.col("gone_id"), "left_anti")
    return out


def set_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """table with columns set in the rows that satisfy the condition (verify, discharge, clearing a pointer)."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def fill_missing(table: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with null or empty columns taken from source's row of the same key."""
    other = source.select(F.col(key).alias("fill_key"), *[F.col(c).alias(f"fill_{c}") for c in columns])
    joined = table.join(other, F.col(key) == F.col("fill_key"), "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"fill_{c}"), F.lit(""))) for c in columns}
    return joined.withColumns(filled).select(*table.columns)


def audit(rows: DataFrame, action: str, actor: str, at: str) -> DataFrame:
    """Log rows of an action on documents (id)."""
    return rows.select(F.col("id").alias("document_id"), F.lit(action).alias("action"), F.lit(actor).alias("actor"), F.lit(at).alias("timestamp"))


def new_assignments(access: DataFrame, wanted: DataFrame, users: DataFrame, patients: DataFrame) -> DataFrame:
    """access with the wanted pairs (doctor_user_id, patient_id) of doctors and patients that exist, once each."""
    doctors = users.where("role = 'doctor'").select(F.col("id").alias("doctor_user_id"))
    known = wanted.join(doctors, "doctor_user_id", "left_semi").join(patients.select(F.col("id").alias("patient_id")), "patient_id", "left_semi")
    return upsert_missing(access, known.select(*access.columns), ["doctor_user_id", "patient_id"])


def new_requests(requests: DataFrame, wanted: DataFrame, access: DataFrame, patients: DataFrame) -> DataFrame:
    """The wanted requests that may be made: the patient exists, and the doctor has neither access nor a request that waits."""
    pair = ["doctor_user_id", "patient_id"]
    known = wanted.dropDuplicates(pair).join(patients.select(F.col("id").alias("patient_id")), "patient_id", "left_semi")
    return known.join(access.select(*pair), pair, "left_anti").join(requests.where("status = 'pending'").select(*pair), pair, "left_anti")


def respond(requests: DataFrame, answers: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, access) after answers (id, patient_id, answer): only the patient's own waiting requests, only approved or denied.

    An approved request adds the pair to access if it isn't there.
    """
    valid = answers.where(F.col("answer").isin("approved", "denied")).dropDuplicates(["id"]).select(F.col("id").alias("a_id"), F.col("patient_id").alias("a_patient"), "answer")
    joined = requests.join(valid, (F.col("id") == F.col("a_id")) & (F.col("patient_id") == F.col("a_patient")) & (F.col("status") == "pending"), "left")
    after = joined.withColumn("status", F.coalesce("answer", "status"))
    granted = after.where("answer = 'approved'").select(*access.columns)
    return after.select(*requests.columns), upsert_missing(access, granted, ["doctor_user_id", "patient_id"])


def denormalised(documents: DataFrame, patients: DataFrame, fields: list[str]) -> DataFrame:
    """Documents (patient_id, section, ...) with empty fields taken from their patient, and name and type from their section."""
    filled = fill_missing(documents, patients.withColumnRenamed("id", "patient_id"), "patient_id", fields)
    named = F.initcap(F.replace("section", F.lit("_"), F.lit(" ")))
    return filled.withColumns({"report_name": F.coalesce(F.nullif("report_name", F.lit("")), named), "report_type": F.coalesce(F.nullif("report_type", F.lit("")), F.col("section"))})


def back_filled(patients: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """Patients whose empty fields take the first value that isn't empty of their documents, by document id."""
    first = lambda f: F.min_by(F.col(f), F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("id"))).alias(f)
    return fill_missing(patients, documents.groupBy(F.col("patient_id").alias("id")).agg(*[first(f) for f in fields]), "id", fields)


def update_documents(documents: DataFrame, labs: DataFrame, edits: DataFrame, new_labs: DataFrame, fields: list[str], actor: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, labs, log rows) after edits (id, fields): every field is overwritten, null clears it; an edited document's labs are replaced by its rows of new_labs."""
    new = edits.select(F.col("id").alias("e_id"), *[F.col(f).alias(f"e_{f}") for f in fields])
    joined = documents.join(new, F.col("id") == F.col("e_id"), "left")
    changed = joined.withColumns({f: F.when(F.col("e_id").isNotNull(), F.col(f"e_{f}")).otherwise(F.col(f)) for f in fields}).select(*documents.columns)
    ids = edits.select(F.col("id").alias("document_id"))
    kept = labs.join(ids, "document_id", "left_anti").unionByName(new_labs.join(ids, "document_id", "left_semi").select(*labs.columns))
    return changed, kept, audit(edits, "edited", actor, at)


def delete_documents(documents: DataFrame, dependents: dict[str, tuple[DataFrame, str]], pointers: dict[str, tuple[DataFrame, str]], links: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """As delete_cascade; also links (a, b) of which either end is gone go, and pointers (name -> table, column) to it become null."""
    out = delete_cascade(documents, dependents, gone)
    ids = gone.select(F.col("id").alias("gone_id")).distinct()
    out["links"] = links.join(ids, F.col("a") == F.col("gone_id"), "left_anti").join(ids, F.col("b") == F.col("gone_id"), "left_anti")
    for name, (table, column) in pointers.items():
        joined = table.join(ids, F.col(column) == F.col("gone_id"), "left")
        out[name] = joined.withColumn(column, F.when(F.col("gone_id").isNull(), F.col(column))).select(*table.columns)
    return out


def new_events(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """Events to add, with the doctor's hospital where none is given."""
    who = users.select(F.col("id").alias("u_id"), F.col("hospital_name").alias("u_hospital"))
    joined = wanted.join(who, F.col("doctor_user_id") == F.col("u_id"), "left")
    return joined.withColumn("hospital_name", F.coalesce(F.nullif("hospital_name", F.lit("")), "u_hospital")).withColumn("status", F.lit("active")).drop("u_id", "u_hospital")


def discharge(events: DataFrame, leaving: DataFrame) -> DataFrame:
    """Events of which those in leaving (id, at) are discharged."""
    out = leaving.select(F.col("id").alias("l_id"), F.col("at").alias("l_at"))
    joined = events.join(out, F.col("id") == F.col("l_id"), "left")
    gone = F.col("l_id").isNotNull()
    return joined.withColumns({"status": F.when(gone, "discharged").otherwise(F.col("status")), "discharged_on": F.when(gone, F.col("l_at")).otherwise(F.col("discharged_on"))}).drop("l_id", "l_at")


def job_steps(jobs: DataFrame) -> DataFrame:
    """The states that an upload job (job_id, ok) goes through, as log rows: queued 0, processing 10 and 70, then done or error 100."""
    last = F.when(F.col("ok"), F.lit("done")).otherwise("error")
    steps = [("queued", 0), ("processing", 10), ("processing", 70)]
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("state"), F.lit(p).alias("progress")) for i, (s, p) in enumerate(steps)], F.struct(F.lit(len(steps)).alias("step"), last.alias("state"), F.lit(100).alias("progress")))
    return jobs.select("job_id", F.explode(each).alias("s")).select("job_id", "s.*")


def upload_patient(uploads: DataFrame, patients: DataFrame) -> DataFrame:
    """Uploads (role, user_id, patient_id) with the patient they go to: a patient's own row, or the one that is named and exists; others go nowhere."""
    wanted = F.when(F.col("role") == "patient", F.col("user_id")).when(F.col("role").isin("doctor", "admin"), F.col("patient_id"))
    named = uploads.withColumn("target", wanted)
    known = patients.select(F.col("id").alias("known_id"))
    return named.join(known, F.col("target") == F.col("known_id"), "left").withColumn("target", F.col("known_id")).drop("known_id")
