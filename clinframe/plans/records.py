"""Named queries over cards, payloads, profiles, pages and changes, with their SQL. Nested results are spelled out as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions import dates
from clinframe.operators import chart, dml, pages, records, trends
from clinframe.plans.chart import DOCTOR, SQL_ALL, SQL_POINTS, _tables
from clinframe.sources import bindings

NOW = "2024-01-08 00:00:00"
_LIST = lambda column, *fields: F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ",")

SQL_MORE = f"""{SQL_ALL},
users AS (SELECT id, full_name, lower(replace(full_name, '#', '.')) || '@example.org' AS email, hospital_name FROM doctors),
paper AS (SELECT d.*, id % 120 AS uploaded_by, CASE WHEN id % 4 = 0 THEN '' ELSE 'scan_' || id || '.pdf' END AS filename, CASE WHEN id % 6 = 0 THEN 'Report ' || id END AS report_name, CASE WHEN id % 5 = 0 THEN repeat('note ', (id % 60)::INT) END AS note FROM full_docs d),
evd AS (SELECT *, id % 120 AS doctor_user_id, CASE WHEN status <> 'active' AND id % 3 = 0 THEN strftime(admitted_at::DATE + INTERVAL 2 DAY, '%Y-%m-%d') END AS discharged_on FROM ev),
reqs AS (SELECT id, id % 120 AS doctor_user_id, patient_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'denied' ELSE 'pending' END AS status FROM ev),
logs AS (SELECT DISTINCT l_orderkey AS document_id, strftime(l_shipdate, '%Y-%m-%d') AS done_at, CASE l_returnflag WHEN 'A' THEN 'edited' ELSE 'verified' END AS action, l_suppkey::VARCHAR AS actor FROM lineitem WHERE l_returnflag <> 'N'),
titled AS (SELECT *, coalesce(nullif(report_name, ''), nullif(filename, ''), 'Document ' || id) AS title FROM paper)"""


def _select(columns: str, source: str) -> str:
    return f"WITH {SQL_MORE} SELECT {columns} FROM {source}"


def public_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.public_users(bindings.users(spark, sf_dir))


def doctor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.users(spark, sf_dir).where("role = 'doctor'").select("id", "full_name", "hospital_name")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.one(bindings.documents(spark, sf_dir), "id", 42).select("id", "patient_id", "section")


def lookup_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.one(bindings.users(spark, sf_dir), "email", "supplier.000000007@example.org").select("id", "full_name")


def document_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.document_cards(*_tables(spark, sf_dir, "documents", "lab_flags", "users", "reviews"), DOCTOR)


def event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = records.event_cards(*_tables(spark, sf_dir, "events", "users"))
    return cards.select("id", "patient_id", "event_type", "status", "doctor_name", dates.event_date(F.col("discharged_on"), F.date_format("admitted_at", "yyyy-MM-dd")).alias("event_date"))


def access_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    access, users = _tables(spark, sf_dir, "access", "users")
    return records.access_cards(access, users.where("id % 3 <> 0"))


def document_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records.payload(bindings.documents(spark, sf_dir).select("id"), *_tables(spark, sf_dir, "lab_results", "logs"))
    return p.select("id", _LIST(F.col("labs"), "line_no", "test_key", "value", "flag").alias("labs"), _LIST(F.col("audit_logs"), "at", "action", "actor").alias("audit_logs"))


def patient_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients, events, users, access = _tables(spark, sf_dir, "patients", "events", "users", "access")
    p = records.profiles(patients.select("id", "full_name"), document_cards(spark, sf_dir), records.event_cards(events, users), records.access_cards(access, users))
    shown = {s: _LIST(records.section_cards(F.col("sections"), s), "id", "title").alias(f"s_{s}") for s in ("bloodwork", "notes", "other")}
    own = F.size(records.flat_sections(F.col("sections"), [s for s in bindings.SECTIONS if s != "notes"]))
    return p.select("id", "full_name", *[F.coalesce(c, F.lit("")).alias(f"s_{s}") for s, c in shown.items()], F.greatest(own, F.lit(0)).alias("n_own"), F.coalesce(_LIST(F.col("events"), "id", "doctor_name"), F.lit("")).alias("events"), F.coalesce(F.size("doctor_access"), F.lit(0)).alias("n_doctors"))


def granter_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    access, users, patients = _tables(spark, sf_dir, "access", "users", "patients")
    return records.assignments(access.withColumn("granted_by_user_id", (F.col("patient_id") + F.col("doctor_user_id")) % 130), users, patients)


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = records.requests_named(*_tables(spark, sf_dir, "requests", "users"))
    return named.select("id", "patient_id", "doctor_user_id", "doctor_name", "doctor_hospital_name", "status", "place")


def patient_search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.search_with_requests(*_tables(spark, sf_dir, "patients", "access", "requests"), "01", DOCTOR)
    return found.select("id", "full_name", "has_access", "has_pending_request")


def links_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bindings.documents(spark, sf_dir)
    links = documents.select(F.col("id").alias("a"), (F.col("id") * 7 % 1000).alias("b"))
    return records.touching(links, documents.where("status = 'P'"))


def domain_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bindings.read(spark, sf_dir, "orders")
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % k % len(words) + 1).cast("int"))
    rows = o.select("o_orderkey", pick(["admin", "doctor", "nurse"], 31).alias("role"), pick(["notes", "scans", "photos"], 37).alias("section"), pick(["pending", "approved", "maybe"], 41).alias("request_status"))
    return records.allowed(rows)


def upload_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local tasks of each user (every third event) merged with the server's jobs (every second)."""
    ev = bindings.read(spark, sf_dir, "events")
    finished = F.when(F.col("event_type").isin("purchase", "error"), F.to_timestamp(F.lit(NOW)) - F.expr("make_interval(0, 0, 0, 0, 0, 0, event_id % 14)"))
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    jobs = ev.where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("job_id"), name.alias("filename"), F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("waiting").alias("status"), (F.col("event_id") % 100).cast("int").alias("progress"), F.col("ts").alias("created_at"), finished.alias("finished_at"))
    tasks = ev.where("event_id % 3 = 0").select("user_id", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("job_id"), F.lit("local").alias("filename"), F.lit(5).alias("size"), F.lit("Ann").alias("patient_name"), F.lit("uploading").alias("status"), F.lit(2).alias("progress"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    merged = records.merge_tasks(tasks, jobs, F.to_timestamp(F.lit(NOW)))
    return merged.select("user_id", "id", "job_id", "filename", "size", "patient_name", "status", "progress", "place")


def _worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A doctor's patients with counts, care and the names of their first abnormal labs."""
    documents, labs, access, reviews, patients, events = _tables(spark, sf_dir, "documents", "lab_results", "access", "reviews", "patients", "events")
    work = chart.worklist_rows(documents, labs, access, reviews).withColumn("abnormal_names", F.array_join("abnormal_keys", " ")).drop("abnormal_keys")
    care = chart.care_context(patients, events, ("full_name", "patient_identifier")).select("patient_id", "care_context", "full_name", "patient_identifier")
    rows = work.join(care, "patient_id")
    return rows.withColumn("theme", pages.card_theme(F.col("abnormal_count"), F.col("care_context") == "active"))


def whole_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the cards of all documents, to one doctor; some uploaders are missing."""
    documents, labs, users, reviews = _tables(spark, sf_dir, "documents", "lab_flags", "users", "reviews")
    day, none = F.date_format("test_date", "yyyy-MM-dd"), F.lit(None).cast("string")
    documents = documents.withColumns({
        "content_type": F.when(F.col("filename") != "", "application/pdf"), "report_type": F.when(F.col("section") == "bloodwork", "Bloodwork"), "lab_name": F.concat(F.lit("Lab "), (F.col("id") % 7).cast("string")), "sample_type": F.when(F.col("id") % 2 == 0, "ser"),
        "referring_doctor": none, "collected_on": F.when(F.col("id") % 3 == 0, day), "reported_on": none, "registered_on": none, "generated_on": none, "created_at": F.concat(day, F.lit("T00:00:00Z")), "test_date": day,
    })
    cards = records.whole_cards(documents, labs, users.where("id % 5 <> 0"), reviews, 7)
    user = [F.col(f"uploaded_by.{c}").alias(f"uploader_{c}") for c in ("id", "full_name", "email", "role", "hospital_name")]
    return cards.select("*", *user).drop("uploaded_by")


def caller_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth doctor's account is an admin's; every third patient has an account of its own, under another number."""
    documents, access, doctors, patients = _tables(spark, sf_dir, "documents", "access", "doctors", "patients")
    linked = patients.select("id", F.when(F.col("id") % 3 == 0, F.col("id") * 2 + 1_000_000).alias("user_id"))
    staff = doctors.select(F.col("id").alias("caller_id"), F.when(F.col("id") % 10 == 0, "admin").otherwise("doctor").alias("role"))
    callers = staff.unionByName(linked.where("user_id IS NOT NULL").select(F.col("user_id").alias("caller_id"), F.lit("patient").alias("role")))
    return chart.scope_counts(chart.scopes(callers, linked, access), linked, documents)


def worklist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.worklist(_worklist(spark, sf_dir), "all", "")
    return rows.select("doctor_user_id", "patient_id", "care_context", "new_records_count", "abnormal_count", F.coalesce("abnormal_names", F.lit("")).alias("abnormal_names"), "theme", "place")


def worklist_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.worklist(_worklist(spark, sf_dir), "abnormal", " PROMO").select("doctor_user_id", "patient_id", "place")


def worklist_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the names of abnormal labs, which no counter asks for: neither lists of labs nor of documents are made."""
    documents, labs, access, reviews, patients, events = _tables(spark, sf_dir, "documents", "lab_flags", "access", "reviews", "patients", "events")
    rows = chart.worklist_rows(documents, labs, access, reviews, 0).join(chart.care_context(patients, events).select("patient_id", "care_context"), "patient_id")
    n = lambda c: F.col(c) > 0
    return pages.counters(rows, "doctor_user_id", active=F.col("care_context") == "active", with_new=n("new_records_count"), abnormal=n("abnormal_count"))


def assignments_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labs, access, users, patients, events = _tables(spark, sf_dir, "documents", "lab_flags", "access", "users", "patients", "events")
    abnormal = chart.with_counts(documents, labs).groupBy("patient_id").agg(F.sum("n_abnormal").alias("abnormal_count"))
    named = records.access_cards(access.where("doctor_user_id % 2 = 0"), users)
    rows = pages.board(patients, named, chart.care_context(patients, events).select("patient_id", "care_context"), abnormal)
    return rows.select("id", "doctors", "n_doctors", "is_unassigned", "care_context", "abnormal_count")


def unverified_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, patients = _tables(spark, sf_dir, "documents", "patients")
    named = documents.join(patients.select(F.col("id").alias("p_id"), F.col("full_name").alias("patient_name")), F.col("patient_id") == F.col("p_id"), "left")
    return pages.unverified(named, "other", "SCAN_1").select("id", "patient_name", "filename", "section")


def admin_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, users = _tables(spark, sf_dir, "logs", "users")
    rows = logs.select("document_id", F.col("actor").cast("long").alias("actor_id"), "action", F.col("at").alias("timestamp"))
    return pages.log_page(rows, users.where("id % 5 <> 0"), "Verif").select("document_id", "actor_id", "actor_name", "action", "timestamp")


def hospitalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bindings.events(spark, sf_dir).select("id", "patient_id", "status", F.col("discharged_on").alias("discharged_at"), F.date_format("admitted_at", "yyyy-MM-dd").alias("admitted_at"))
    return pages.hospitalizations(events, "past").select("patient_id", "id", "event_date", "place")


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.col("status") == "active"
    return pages.counters(bindings.events(spark, sf_dir), "patient_id", active=active, past=~active)


def doctor_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.doctor_choices(*_tables(spark, sf_dir, "doctors", "access"), 5, "nation_1").select("id", "full_name", "hospital_name", "is_assigned")


def full_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = chart.timeline(*_tables(spark, sf_dir, "documents", "events")).withColumn("section", F.when(F.col("item_type") == "event", "events").otherwise(F.col("title")))
    return pages.filtered_timeline(items, ["events", "bloodwork"], 1998).select("patient_id", "item_id", "section")


def _last_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.last_points(bindings.named(trends.points(*_tables(spark, sf_dir, "lab_flags", "documents")), spark, sf_dir), 5)


def trend_recut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.recut(_last_points(spark, sf_dir)).select("patient_id", "test_key", "document_id", F.col("value_num").alias("value"), "previous", "delta", "place")


def trend_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.first_seen(bindings.named(trends.points(*_tables(spark, sf_dir, "lab_flags", "documents")), spark, sf_dir))


def trend_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks, domain and labels of each trend's chart, and its place among the patient's trends by priority words."""
    per = _last_points(spark, sf_dir).groupBy("patient_id", "test_key").agg(F.min("value_num").alias("low"), F.max("value_num").alias("high"))
    d = pages.domain(F.col("low"), F.col("high"))
    tick = lambda x: F.format_string("%.4f", x)
    return per.select("patient_id", "test_key", F.array_join(F.transform(pages.axis(F.col("low"), F.col("high")), tick), ",").alias("ticks"), tick(d["bottom"]).alias("bottom"), tick(d["top"]).alias("top"), pages.axis_number(F.col("high")).alias("label"), pages.trend_priority(F.col("test_key"), F.lit("MCH glucose")).cast("int").alias("priority"))


def dml_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge after all patients have been wanted for doctors 7 and 100007, who doesn't exist."""
    access, users, patients = _tables(spark, sf_dir, "access", "users", "patients")
    wanted = patients.select(F.explode(F.array(F.lit(7).cast("long"), F.lit(100007).cast("long"))).alias("doctor_user_id"), F.col("id").alias("patient_id"))
    return dml.new_assignments(access, wanted, users, patients)


def dml_respond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests after answers to every third of them, some by the wrong patient or with a wrong word; and how many links there are then."""
    requests, access = _tables(spark, sf_dir, "requests", "access")
    answers = requests.where("id % 3 = 0").select("id", (F.col("patient_id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("patient_id"), F.element_at(F.array(F.lit("approved"), F.lit("denied"), F.lit("perhaps")), (F.col("id") % 7 % 3 + 1).cast("int")).alias("answer"))
    after, links = dml.respond(requests, answers, access)
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(links.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("links").alias("status"), "n"))


def dml_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, access, patients = _tables(spark, sf_dir, "requests", "access", "patients")
    wanted = requests.select("doctor_user_id", (F.col("patient_id") + 1).alias("patient_id"))
    return dml.new_requests(requests, wanted, access, patients)


def dml_update_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of status P get a new name and lose their note; their labs become one."""
    documents, labs = _tables(spark, sf_dir, "documents", "lab_flags")
    edits = documents.where("status = 'P'").select("id", F.concat(F.lit("Edited "), F.col("id").cast("string")).alias("report_name"), F.lit(None).cast("string").alias("note"))
    new = edits.select(F.col("id").alias("document_id"), F.lit("9").alias("value"))
    docs, kept, log = dml.update_documents(documents, labs.select("document_id", "value"), edits, new, ["report_name", "note"], "me", "2024")
    n = lambda t, name: t.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return n(docs.where("report_name LIKE 'Edited %' AND note IS NULL"), "edited").unionByName(n(docs.where("note IS NOT NULL"), "notes")).unionByName(n(kept, "labs")).unionByName(n(log, "log"))


def dml_delete_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and job pointers after documents of status P are gone."""
    documents, events = _tables(spark, sf_dir, "documents", "events")
    jobs = events.select(F.col("id").alias("job_id"), (F.col("id") * 3).alias("document_id"))
    links = documents.select(F.col("id").alias("a"), (F.col("id") * 7 % 1000).alias("b"))
    left = dml.delete_documents(documents, {}, {"jobs": (jobs, "document_id")}, links, documents.where("status = 'P'"))
    return left["links"].groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("links").alias("what"), "n").unionByName(left["jobs"].groupBy(F.when(F.col("document_id").isNull(), "null pointers").otherwise("pointers").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def dml_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients without a name take the first report name of their documents; documents without one take their patient's, or else their section."""
    patients, documents = _tables(spark, sf_dir, "patients", "documents")
    poor = patients.select("id", F.when(F.col("id") % 2 == 0, F.col("full_name")).otherwise("").alias("report_name"))
    filled = dml.back_filled(poor, documents.select("id", "patient_id", "report_name"), ["report_name"])
    docs = dml.denormalised(documents.select("id", "patient_id", "section", "report_name", F.lit("").alias("report_type")), filled, ["report_name"])
    return docs.select("id", "report_name", "report_type")


def dml_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events take their doctor's hospital where none is given; every fourth old one is discharged."""
    events, users = _tables(spark, sf_dir, "events", "users")
    wanted = events.select("id", "patient_id", "doctor_user_id", F.when(F.col("id") % 2 == 0, "Own").otherwise("").alias("hospital_name"))
    added = dml.new_events(wanted, users).groupBy("hospital_name", "status").agg(F.count(F.lit(1)).alias("n"))
    old = dml.discharge(events, events.where("id % 4 = 0").select("id", F.lit("2024-02-01").alias("at")))
    return added.unionByName(old.groupBy(F.coalesce("discharged_on", F.lit("-")).alias("hospital_name"), "status").agg(F.count(F.lit(1)).alias("n")))


def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bindings.read(spark, sf_dir, "events")
    return dml.job_steps(ev.select(F.col("event_id").alias("job_id"), (F.col("event_type") != "error").alias("ok"))).select("job_id", "state", "progress")


def upload_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients = bindings.patients(spark, sf_dir)
    ev = bindings.read(spark, sf_dir, "events")
    uploads = ev.select("event_id", F.element_at(F.array(F.lit("patient"), F.lit("doctor"), F.lit("guest")), (F.col("event_id") % 3 + 1).cast("int")).alias("role"), "user_id", (F.col("event_id") * 11).alias("patient_id"))
    return dml.upload_patient(uploads, patients).select("event_id", "target")


QUERIES = {f.__name__: f for f in (
    public_users, doctor_list, point_lookup, lookup_by_email, document_cards, event_cards, access_cards, document_payload, patient_profiles, granter_left, access_requests, patient_search_requests, links_touching, domain_guards, upload_tasks,
    whole_cards, caller_scopes, worklist_page, worklist_filtered, worklist_counters, assignments_board, unverified_queue, admin_log, hospitalizations, event_counters, doctor_choices, full_timeline, trend_recut, trend_first_seen, trend_charts, dml_assign, dml_respond, dml_request,
    dml_update_documents, dml_delete_links, dml_back_fill, dml_events, job_steps, upload_targets,
)}

_WORKLIST = f"""{SQL_MORE}, care AS (SELECT c_custkey AS patient_id, CASE WHEN count(*) FILTER (e.status = 'active') > 0 THEN 'active' WHEN count(e.id) > 0 THEN 'past' ELSE 'outpatient' END AS care_context FROM customer LEFT JOIN ev e ON e.patient_id = c_custkey GROUP BY 1),
open AS (SELECT a.doctor_user_id, a.patient_id, d.id, d.n_abnormal FROM access a JOIN full_docs d ON a.patient_id = d.patient_id LEFT JOIN reviews r ON r.document_id = d.id AND r.doctor_user_id = a.doctor_user_id WHERE r.document_id IS NULL),
sums AS (SELECT a.doctor_user_id, a.patient_id, count(o.id) AS new_records_count, coalesce(sum(n_abnormal), 0)::BIGINT AS abnormal_count FROM access a LEFT JOIN open o ON o.doctor_user_id = a.doctor_user_id AND o.patient_id = a.patient_id GROUP BY 1, 2),
tops AS (SELECT doctor_user_id, patient_id, string_agg(test_key, ' ' ORDER BY rn) AS names FROM (SELECT o.doctor_user_id, o.patient_id, l.test_key, row_number() OVER (PARTITION BY o.doctor_user_id, o.patient_id
  ORDER BY l.document_id DESC, line_no, part_id, l.doctor_user_id, quantity, price, discount, tax, ship_date) AS rn FROM open o JOIN labs l ON l.document_id = o.id AND l.flag <> 'Normal') WHERE rn <= 3 GROUP BY 1, 2),
work AS (SELECT s.*, care_context, c_name AS full_name, c_mktsegment, coalesce(names, '') AS abnormal_names, CASE WHEN abnormal_count > 0 THEN 'danger' WHEN care_context = 'active' THEN 'success' ELSE 'default' END AS theme
  FROM sums s JOIN care USING (patient_id) JOIN customer ON c_custkey = s.patient_id LEFT JOIN tops t ON t.doctor_user_id = s.doctor_user_id AND t.patient_id = s.patient_id)"""
_PLACE = "row_number() OVER (PARTITION BY doctor_user_id ORDER BY care_context = 'active' DESC, abnormal_count > 0 DESC, new_records_count > 0 DESC, full_name, patient_id)::INT AS place"
_WAY = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'queued' END"
_CARDS = "coalesce((SELECT string_agg(t.id || ':' || title, ',' ORDER BY t.id DESC) FROM titled t WHERE t.patient_id = c_custkey AND sec = '{s}'), '') AS s_{s}"
ORACLE = {
    "public_users": _select("id, full_name, email, 'doctor' AS role, NULL::VARCHAR AS department, hospital_name", "users"),
    "doctor_list": _select("id, full_name, hospital_name", "users"),
    "point_lookup": "SELECT id, patient_id, section FROM (WITH " + SQL_ALL + " SELECT * FROM docs) WHERE id = 42",
    "lookup_by_email": _select("id, full_name", "users WHERE email = 'supplier.000000007@example.org'"),
    "document_cards": _select(
        f"""p.id, p.patient_id, sec AS section, filename, title, is_verified = 1 AS is_verified, n_abnormal > 0 AS has_abnormal, r.document_id IS NOT NULL AS reviewed_by_me, CASE WHEN length(note) > 180 THEN left(note, 180) || '...' ELSE nullif(note, '') END AS note_preview,
        section = 'notes' AND uploaded_by = {DOCTOR} AS can_edit_note, coalesce(u.full_name || ' · ' || u.hospital_name, 'Unknown') AS uploaded_by, 'Test date ' || strftime(test_date, '%Y-%m-%d') AS date_label, n_abnormal > 0 AND r.document_id IS NULL AS needs_review""",
        f"titled p LEFT JOIN users u ON u.id = uploaded_by LEFT JOIN (SELECT document_id FROM reviews WHERE doctor_user_id = {DOCTOR}) r ON r.document_id = p.id"),
    "event_cards": _select("e.id, patient_id, event_type, status, u.full_name AS doctor_name, coalesce(discharged_on, strftime(admitted_at, '%Y-%m-%d')) AS event_date", "evd e LEFT JOIN users u ON u.id = doctor_user_id"),
    "access_cards": _select("doctor_user_id, patient_id, coalesce(full_name, '') AS doctor_name, coalesce(email, '') AS doctor_email, hospital_name", "access LEFT JOIN (FROM users WHERE id % 3 <> 0) u ON u.id = doctor_user_id"),
    "document_payload": f"""WITH {SQL_MORE}, a AS (SELECT document_id, string_agg(line_no || ':' || test_key || ':' || quantity::DECIMAL(10,1) || ':' || flag, ',' ORDER BY line_no, part_id, test_key, quantity::DECIMAL(10,1)::VARCHAR, flag) AS labs FROM labs GROUP BY 1),
      b AS (SELECT document_id, string_agg(done_at || ':' || action || ':' || actor, ',' ORDER BY done_at, action, actor) AS audit_logs FROM logs GROUP BY 1)
      SELECT id, coalesce(labs, '') AS labs, coalesce(audit_logs, '') AS audit_logs FROM docs LEFT JOIN a ON a.document_id = id LEFT JOIN b ON b.document_id = id""",
    "patient_profiles": f"""WITH {SQL_MORE}, s AS (SELECT patient_id, {', '.join(f"string_agg(id || ':' || title, ',' ORDER BY id DESC) FILTER (sec = '{x}') AS s_{x}" for x in ('bloodwork', 'notes', 'other'))}, count(*) FILTER (sec <> 'notes') AS n_own FROM titled GROUP BY 1),
      e AS (SELECT patient_id, string_agg(v.id || ':' || coalesce(full_name, '-'), ',' ORDER BY admitted_at DESC, v.id DESC) AS events FROM evd v LEFT JOIN users u ON u.id = doctor_user_id GROUP BY 1), a AS (SELECT patient_id, count(*) AS n FROM access GROUP BY 1)
      SELECT c_custkey AS id, c_name AS full_name, coalesce(s_bloodwork, '') AS s_bloodwork, coalesce(s_notes, '') AS s_notes, coalesce(s_other, '') AS s_other, coalesce(n_own, 0)::INT AS n_own, coalesce(events, '') AS events, coalesce(n, 0)::INT AS n_doctors
      FROM customer LEFT JOIN s ON s.patient_id = c_custkey LEFT JOIN e ON e.patient_id = c_custkey LEFT JOIN a ON a.patient_id = c_custkey""",
    "granter_left": _select("doctor_user_id, patient_id, (patient_id + doctor_user_id) % 130 AS granted_by_user_id, d.full_name AS doctor_name, g.full_name AS granted_by, c_name AS patient_name", "access LEFT JOIN users d ON d.id = doctor_user_id LEFT JOIN users g ON g.id = (patient_id + doctor_user_id) % 130 LEFT JOIN customer ON c_custkey = patient_id"),
    "access_requests": _select("q.id, patient_id, doctor_user_id, full_name AS doctor_name, hospital_name AS doctor_hospital_name, status, row_number() OVER (PARTITION BY patient_id ORDER BY q.id DESC)::INT AS place", "reqs q LEFT JOIN users u ON u.id = doctor_user_id"),
    "patient_search_requests": _select(f"c_custkey AS id, c_name AS full_name, c_custkey IN (SELECT patient_id FROM access WHERE doctor_user_id = {DOCTOR}) AS has_access, c_custkey IN (SELECT patient_id FROM reqs WHERE doctor_user_id = {DOCTOR} AND status = 'pending') AS has_pending_request", "customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '01')"),
    "links_touching": _select("DISTINCT id AS a, id * 7 % 1000 AS b", "docs WHERE status = 'P' OR id * 7 % 1000 IN (SELECT id FROM docs WHERE status = 'P')"),
    "domain_guards": """SELECT o_orderkey, ['admin', 'doctor'][(o_orderkey % 31 % 3 + 1)] AS role, ['notes', 'scans'][(o_orderkey % 37 % 3 + 1)] AS section, ['pending', 'approved'][(o_orderkey % 41 % 3 + 1)] AS request_status
      FROM orders WHERE o_orderkey % 31 % 3 < 2 AND o_orderkey % 37 % 3 < 2 AND o_orderkey % 41 % 3 < 2""",
    "upload_tasks": f"""WITH j AS (SELECT *, event_id % 2 = 0 AS job, event_id % 3 = 0 AS task FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0),
      m AS (SELECT user_id, CASE WHEN task THEN 't' ELSE 'job-' END || event_id AS id, event_id AS job_id, CASE WHEN job THEN 'f' || event_id ELSE 'local' END AS filename, CASE WHEN task THEN 5 ELSE 0 END::INT AS size, CASE WHEN task THEN 'Ann' END AS patient_name,
        CASE WHEN job THEN {_WAY} ELSE 'uploading' END AS status, CASE WHEN job THEN event_id % 100 ELSE 2 END::INT AS progress, ts FROM j WHERE NOT (job AND event_type IN ('purchase', 'error') AND event_id % 14 >= 7))
      SELECT * EXCLUDE (ts) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id)::INT AS place FROM m) WHERE place <= 30""",
    "whole_cards": """WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'scan_' || o_orderkey || '.pdf' END AS filename, CASE WHEN o_orderkey % 6 = 0 THEN 'Report ' || o_orderkey END AS report_name, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus = 'F' AS is_verified,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'bloodwork' WHEN o_orderpriority = '5-LOW' THEN ['scans', 'notes', 'medications', 'hospitalizations'][(o_orderkey % 4 + 1)] ELSE 'unmapped' END AS section, o_orderkey % 120 AS up, CASE WHEN o_orderkey % 5 = 0 THEN repeat('note ', (o_orderkey % 60)::INT) END AS note FROM orders),
      bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R')), mine AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey = 7),
      who AS (SELECT s_suppkey, s_name, lower(replace(s_name, '#', '.')) || '@example.org' AS email, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0)
      SELECT id, filename, CASE WHEN filename <> '' THEN 'application/pdf' END AS content_type, report_name, CASE WHEN section = 'bloodwork' THEN 'Bloodwork' END AS report_type, 'Lab ' || id % 7 AS lab_name, CASE WHEN id % 2 = 0 THEN 'ser' END AS sample_type, NULL::VARCHAR AS referring_doctor,
      day AS test_date, CASE WHEN id % 3 = 0 THEN day END AS collected_on, NULL::VARCHAR AS reported_on, NULL::VARCHAR AS registered_on, NULL::VARCHAR AS generated_on, day || 'T00:00:00Z' AS created_at, section, is_verified, bad.l_orderkey IS NOT NULL AS has_abnormal, bad.l_orderkey IS NOT NULL AS has_abnormal_labs,
      mine.l_orderkey IS NOT NULL AS reviewed_by_current_doctor, CASE WHEN length(note) > 180 THEN left(note, 180) || '...' ELSE nullif(note, '') END AS note_preview, section = 'notes' AND up = 7 AS can_edit_note,
      s_suppkey AS uploader_id, s_name AS uploader_full_name, email AS uploader_email, CASE WHEN s_suppkey IS NOT NULL THEN 'doctor' END AS uploader_role, n_name AS uploader_hospital_name
      FROM d LEFT JOIN bad ON id = bad.l_orderkey LEFT JOIN mine ON id = mine.l_orderkey LEFT JOIN who ON up = s_suppkey""",
    "caller_scopes": """WITH d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT s_suppkey AS caller_id, 'admin' AS role, (SELECT count(*) FROM customer) AS n_patients, (SELECT count(*) FROM orders) AS n_documents FROM supplier WHERE s_suppkey % 10 = 0
      UNION ALL SELECT l_suppkey, 'doctor', count(*), coalesce(sum(n), 0)::BIGINT FROM a LEFT JOIN d USING (o_custkey) JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 10 <> 0 GROUP BY 1
      UNION ALL SELECT c_custkey * 2 + 1000000, 'patient', 1, coalesce(n, 0)::BIGINT FROM customer LEFT JOIN d ON c_custkey = o_custkey WHERE c_custkey % 3 = 0""",
    "worklist_page": f"WITH {_WORKLIST} SELECT doctor_user_id, patient_id, care_context, new_records_count, abnormal_count, abnormal_names, theme, {_PLACE} FROM work",
    "worklist_filtered": f"WITH {_WORKLIST} SELECT doctor_user_id, patient_id, {_PLACE} FROM work WHERE abnormal_count > 0 AND contains(lower(full_name || ' ' || c_mktsegment || ' ' || care_context || ' ' || abnormal_names), 'promo')",
    "worklist_counters": f"WITH {_WORKLIST} SELECT doctor_user_id, count(*) AS total, count(*) FILTER (care_context = 'active') AS active, count(*) FILTER (new_records_count > 0) AS with_new, count(*) FILTER (abnormal_count > 0) AS abnormal FROM work GROUP BY 1",
    "assignments_board": f"""WITH {_WORKLIST}, d AS (SELECT patient_id, string_agg(DISTINCT coalesce(full_name, ''), ', ' ORDER BY coalesce(full_name, '')) AS doctors, count(*) AS n FROM access LEFT JOIN users u ON u.id = doctor_user_id WHERE doctor_user_id % 2 = 0 GROUP BY 1),
      b AS (SELECT patient_id, sum(n_abnormal)::BIGINT AS abnormal_count FROM full_docs GROUP BY 1)
      SELECT c_custkey AS id, coalesce(doctors, '') AS doctors, coalesce(n, 0) AS n_doctors, n IS NULL AS is_unassigned, care_context, coalesce(abnormal_count, 0)::BIGINT AS abnormal_count
      FROM customer JOIN care ON care.patient_id = c_custkey LEFT JOIN d ON d.patient_id = c_custkey LEFT JOIN b ON b.patient_id = c_custkey""",
    "unverified_queue": _select("id, c_name AS patient_name, filename, section", "paper LEFT JOIN customer ON c_custkey = patient_id WHERE is_verified = 0 AND section <> 'bloodwork' AND contains(lower(concat_ws(' ', coalesce(c_name, ''), filename, coalesce(report_name, ''), section)), 'scan_1')"),
    "admin_log": _select("document_id, actor::BIGINT AS actor_id, full_name AS actor_name, action, done_at AS timestamp", "logs LEFT JOIN (FROM users WHERE id % 5 <> 0) u ON u.id = actor::BIGINT WHERE action = 'verified'"),
    "hospitalizations": _select("patient_id, id, event_date, row_number() OVER (PARTITION BY patient_id ORDER BY event_date DESC, id DESC)::INT AS place", "(SELECT *, coalesce(discharged_on, strftime(admitted_at, '%Y-%m-%d')) AS event_date FROM evd WHERE status <> 'active')"),
    "event_counters": _select("patient_id, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status <> 'active') AS past", "ev GROUP BY 1"),
    "doctor_choices": _select("id, full_name, hospital_name, id IN (SELECT doctor_user_id FROM access WHERE patient_id = 5) AS is_assigned", "users WHERE contains(lower(concat_ws(' ', full_name, hospital_name)), 'nation_1')"),
    "full_timeline": _select("patient_id, 'doc-' || id AS item_id, sec AS section", "full_docs WHERE sec = 'bloodwork' AND year(test_date) = 1998 UNION ALL SELECT patient_id, 'event-' || id, 'events' FROM ev WHERE year(admitted_at) = 1998"),
    "trend_recut": f"""WITH {SQL_POINTS}, k AS (SELECT * FROM points WHERE rn <= 5), p AS (SELECT *, lag(value_num) OVER w AS previous, row_number() OVER w AS place FROM k WINDOW w AS (PARTITION BY patient_id, test_key ORDER BY rn DESC))
      SELECT patient_id, test_key, document_id, value_num AS value, previous, round(value_num - previous, 2) AS delta, place::INT AS place FROM p""",
    "trend_first_seen": f"""WITH {SQL_POINTS} SELECT patient_id, test_key, display_name, category FROM points QUALIFY row_number() OVER (PARTITION BY patient_id, test_key ORDER BY document_id, line_no, part_id, doctor_user_id, quantity, price, discount, tax, ship_date) = 1""",
    "trend_charts": f"""WITH {SQL_POINTS}, p AS (SELECT patient_id, test_key, min(value_num) AS lo, max(value_num) AS hi FROM points WHERE rn <= 5 GROUP BY 1, 2), s AS (SELECT *, CASE WHEN hi > lo THEN hi - lo ELSE greatest(abs(hi) * 0.25::DOUBLE, 1.0::DOUBLE) END AS spread,
        CASE WHEN abs(lo) < 1 THEN 0.5::DOUBLE ELSE abs(lo) * 0.15::DOUBLE END AS flat, (hi - lo + (hi - lo) * 0.18::DOUBLE * 2) / 4 AS step, lo - (hi - lo) * 0.18::DOUBLE AS first FROM p)
      SELECT patient_id, test_key, CASE WHEN lo = hi THEN printf('%.4f,%.4f,%.4f', lo - flat, lo, lo + flat) ELSE printf('%.4f,%.4f,%.4f,%.4f,%.4f', first, first + step, first + step * 2, first + step * 3, first + step * 4) END AS ticks, printf('%.4f', lo - spread * 0.22::DOUBLE) AS bottom,
      printf('%.4f', hi + spread * 0.22::DOUBLE) AS top, CASE WHEN hi >= 10 THEN printf('%.1f', hi) ELSE hi::INT::VARCHAR END AS label, 7 AS priority FROM s""",
    "dml_assign": _select("doctor_user_id::BIGINT AS doctor_user_id, patient_id", "access UNION SELECT 7::BIGINT, c_custkey FROM customer WHERE 7 IN (SELECT id FROM doctors)"),
    "dml_respond": f"""WITH {SQL_MORE}, a AS (SELECT *, CASE WHEN status = 'pending' AND id % 3 = 0 AND id % 5 <> 0 AND id % 7 % 3 < 2 THEN ['approved', 'denied'][(id % 7 % 3 + 1)] END AS answer FROM reqs)
      SELECT coalesce(answer, status) AS status, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT 'links', count(*) FROM (SELECT doctor_user_id, patient_id FROM access UNION SELECT doctor_user_id, patient_id FROM a WHERE answer = 'approved')""",
    "dml_request": _select("DISTINCT doctor_user_id, patient_id + 1 AS patient_id", """reqs q WHERE patient_id + 1 IN (SELECT c_custkey FROM customer) AND NOT EXISTS (SELECT 1 FROM access a WHERE a.doctor_user_id = q.doctor_user_id AND a.patient_id = q.patient_id + 1)
      AND NOT EXISTS (SELECT 1 FROM reqs r WHERE r.status = 'pending' AND r.doctor_user_id = q.doctor_user_id AND r.patient_id = q.patient_id + 1)"""),
    "dml_update_documents": f"""WITH {SQL_MORE} SELECT 'edited' AS what, count(*) AS n FROM docs WHERE status = 'P' UNION ALL SELECT 'notes', count(*) FROM paper WHERE status <> 'P' AND note IS NOT NULL
      UNION ALL SELECT 'labs', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM docs WHERE status = 'P')) + (SELECT count(*) FROM docs WHERE status = 'P') UNION ALL SELECT 'log', count(*) FROM docs WHERE status = 'P'""",
    "dml_delete_links": f"""WITH {SQL_MORE}, gone AS (SELECT id FROM docs WHERE status = 'P') SELECT 'links' AS what, count(*) AS n FROM docs WHERE id NOT IN (FROM gone) AND id * 7 % 1000 NOT IN (FROM gone)
      UNION ALL SELECT CASE WHEN id * 3 IN (FROM gone) THEN 'null pointers' ELSE 'pointers' END, count(*) FROM ev GROUP BY 1""",
    "dml_back_fill": f"""WITH {SQL_MORE}, f AS (SELECT patient_id, arg_min(report_name, id) FILTER (report_name IS NOT NULL) AS name FROM paper GROUP BY 1), p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE name END AS name FROM customer LEFT JOIN f ON f.patient_id = c_custkey)
      SELECT d.id, coalesce(d.report_name, p.name, upper(left(section, 1)) || substr(section, 2)) AS report_name, section AS report_type FROM paper d LEFT JOIN p ON p.id = d.patient_id""",
    "dml_events": f"""WITH {SQL_MORE} SELECT CASE WHEN v.id % 2 = 0 THEN 'Own' ELSE hospital_name END AS hospital_name, 'active' AS status, count(*) AS n FROM evd v LEFT JOIN users u ON u.id = doctor_user_id GROUP BY 1
      UNION ALL SELECT CASE WHEN id % 4 = 0 THEN '2024-02-01' ELSE coalesce(discharged_on, '-') END, CASE WHEN id % 4 = 0 THEN 'discharged' ELSE status END, count(*) FROM evd GROUP BY 1, 2""",
    "job_steps": "SELECT event_id AS job_id, unnest(['queued', 'processing', 'processing', CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END]) AS state, unnest([0, 10, 70, 100])::INT AS progress FROM events",
    "upload_targets": "SELECT event_id, c_custkey AS target FROM events LEFT JOIN customer ON c_custkey = CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN event_id * 11 END",
}
