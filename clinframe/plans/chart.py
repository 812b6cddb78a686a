"""Named chart queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions import flags
from clinframe.operators import chart, dml, trends
from clinframe.sources import bindings

SQL_LABS = """
docs AS (SELECT o_orderkey AS id, o_custkey AS patient_id, o_orderdate AS test_date,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'bloodwork'
       WHEN o_orderpriority = '5-LOW' THEN list_extract(['scans','notes','medications','hospitalizations'], (o_orderkey % 4 + 1)::INT)
       ELSE 'unmapped' END AS section, (o_orderstatus = 'F')::INT AS is_verified, o_orderstatus AS status, o_totalprice AS amount FROM orders),
labs AS (SELECT l_orderkey AS document_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS doctor_user_id, l_quantity AS quantity,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_shipdate AS ship_date, l_linestatus AS line_status,
  l_quantity::DOUBLE AS value_num, CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'R' THEN 'Low' ELSE 'Normal' END AS flag,
  p_type AS test_key, p_brand AS category, p_name AS display_name FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SQL_POINTS = f"""{SQL_LABS},
points AS (SELECT d.patient_id, l.*, d.test_date, row_number() OVER (PARTITION BY d.patient_id, l.test_key ORDER BY d.test_date DESC, document_id DESC,
  line_no DESC, part_id DESC, doctor_user_id DESC, quantity DESC, price DESC, discount DESC, tax DESC, ship_date DESC) AS rn
  FROM labs l JOIN docs d ON l.document_id = d.id WHERE d.section = 'bloodwork')"""


def trend_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = bindings.named(trends.points(*_tables(spark, sf_dir, "lab_flags", "documents")), spark, sf_dir)
    return trends.last_points(pts, 5).select(
        "patient_id", "test_key", "document_id", F.date_format("test_date", "yyyy-MM-dd").alias("point_date"), F.col("value_num").alias("point_value"), "flag", F.col("rn").cast("int").alias("recency"),
    )



DOCTOR, TERM, AS_OF = 7, "r#000000001", "2024-01-01T00:00:00+00:00"

SQL_ALL = f"""{SQL_LABS},
access AS (SELECT DISTINCT l_suppkey AS doctor_user_id, o_custkey AS patient_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
reviews AS (SELECT DISTINCT l_suppkey AS doctor_user_id, l_orderkey AS document_id FROM lineitem WHERE l_linestatus = 'F'),
doctors AS (SELECT s_suppkey AS id, s_name AS full_name, n_name AS hospital_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
ev AS (SELECT event_id AS id, user_id AS patient_id, event_type, ts AS admitted_at, value, props, CASE WHEN event_type IN ('signup','purchase') THEN 'active' ELSE 'discharged' END AS status FROM events),
per AS (SELECT document_id, count(*) AS n_labs, count(*) FILTER (flag <> 'Normal') AS n_abnormal, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM labs GROUP BY 1),
full_docs AS (SELECT d.*, coalesce(n_labs, 0) AS n_labs, coalesce(n_abnormal, 0) AS n_abnormal, coalesce(categories, '') AS categories, CASE WHEN section = 'unmapped' THEN 'other' ELSE section END AS sec FROM docs d LEFT JOIN per ON d.id = per.document_id)"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [getattr(bindings, n)(spark, sf_dir) for n in names]


def trend_latest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.summary(trends.last_points(bindings.named(trends.points(*_tables(spark, sf_dir, "lab_flags", "documents")), spark, sf_dir), 5))


def trend_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.ordered(trend_latest_delta(spark, sf_dir))


def worklist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.worklist_counts(*_tables(spark, sf_dir, "documents", "lab_flags", "access", "reviews"))


def worklist_top3_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = chart.top_abnormal(*_tables(spark, sf_dir, "documents", "lab_results", "access", "reviews"))
    return top.select("doctor_user_id", "patient_id", "document_id", "test_key", "flag", F.col("place").cast("int").alias("place"))


def worklist_care_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.care_context(*_tables(spark, sf_dir, "patients", "events"))


def patient_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.cards(*_tables(spark, sf_dir, "documents", "lab_flags"))


def profile_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.section_counts(bindings.documents(spark, sf_dir))


def document_payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.with_labs(*_tables(spark, sf_dir, "documents", "lab_results")).select("id", "n_labs", "n_abnormal", "categories")


def patients_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.visible_patients(*_tables(spark, sf_dir, "patients", "access"), "doctor", DOCTOR).select("id", "full_name")


def patient_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.search(*_tables(spark, sf_dir, "patients", "access"), TERM, DOCTOR).select("id", "full_name", "has_access")


def assignments_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.assignments(*_tables(spark, sf_dir, "access", "doctors", "patients")).select("doctor_user_id", "patient_id", "doctor_name", "hospital_name", "patient_name")


def access_request_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = chart.latest_state(bindings.events(spark, sf_dir), "patient_id", [F.col("admitted_at").desc(), F.col("id").desc()])
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "denied").otherwise("pending")
    return last.select("patient_id", F.col("id").alias("request_id"), status.alias("request_status"))


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = chart.first_page(bindings.events(spark, sf_dir), "patient_id", [F.col("id").desc()], 30)
    return page.select("patient_id", F.col("id").alias("job_id"), "event_type", F.col("place").cast("int").alias("place"))


def abnormal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in FLAG_WORDS])
    flag = F.element_at(words, (F.col("l_linenumber") * 7 + F.col("l_partkey")).cast("int") % len(FLAG_WORDS) + 1)
    rows = bindings.read(spark, sf_dir, "lineitem").select(F.nullif(flag, F.lit("-")).alias("flag"))
    each = rows.select("flag", flags.worklist_abnormal(F.col("flag")).alias("worklist"), flags.trend_abnormal(F.col("flag")).alias("trend"), flags.ui_abnormal(F.col("flag")).alias("ui"), flags.normalise(F.col("flag")).alias("normal_form"))
    return each.groupBy("flag", "worklist", "trend", "ui", "normal_form").agg(F.count(F.lit(1)).alias("n"))


FLAG_WORDS = ["High", " low ", "Normal", "n", "N ", "ok", "None", "within range", "Critical", "borderline", "foo", "", "-", "crescut", "scăzut", "↑", "H", "l", "Abnormal"]


def any_abnormal_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.lab_flags(spark, sf_dir).groupBy("document_id").agg(F.bool_or(flags.worklist_abnormal(F.col("flag"))).alias("any_abnormal"))


def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abnormal documents that the doctor hasn't reviewed, per patient."""
    documents, labs, reviews = _tables(spark, sf_dir, "documents", "lab_flags", "reviews")
    mine = reviews.where(F.col("doctor_user_id") == DOCTOR).select(F.col("document_id").alias("__d"))
    todo = chart.cards(documents, labs).where("has_abnormal").join(mine, F.col("id") == F.col("__d"), "left_anti")
    return todo.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_to_review"))


def unreviewed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, reviews = _tables(spark, sf_dir, "documents", "reviews")
    return documents.join(reviews.select(F.col("document_id").alias("__d")), F.col("id") == F.col("__d"), "left_anti").select("id", "patient_id")


def reviewed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, reviews = _tables(spark, sf_dir, "documents", "reviews")
    mine = reviews.where(F.col("doctor_user_id") == DOCTOR).select(F.col("document_id").alias("__d"))
    return documents.join(mine, F.col("id") == F.col("__d"), "left_semi").select("id", "patient_id")


def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = chart.first_page(chart.timeline(*_tables(spark, sf_dir, "documents", "events")), "patient_id", [F.col("item_at").desc(), F.col("item_id").desc()], 8)
    return page.select("patient_id", "item_id", "item_type", "title", F.col("place").cast("int").alias("place"), "hidden_count")


def timeline_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = chart.timeline_days(chart.timeline(*_tables(spark, sf_dir, "documents", "events")))
    return days.select("patient_id", F.concat_ws("-", F.year("day"), F.month("day"), F.dayofmonth("day")).alias("date_key"), "n_items", "starts_year")


def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bindings.documents(spark, sf_dir)
    years = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_set(F.year("test_date")))), lambda y: y.cast("string")), ",")
    return documents.groupBy("patient_id").agg(years.alias("years"), F.array_join(F.array_sort(F.collect_set(chart.section_or_other(F.col("section")))), ",").alias("sections"))


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = chart.first_page(bindings.documents(spark, sf_dir), "patient_id", [F.col("test_date").desc(), F.col("id").desc()], 10)
    return page.select("patient_id", "id", F.col("place").cast("int").alias("place"), "hidden_count")


def dml_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left per table after documents of status P are deleted with their labs and receipts."""
    documents, labs, reviews = _tables(spark, sf_dir, "documents", "lab_flags", "reviews")
    left = dml.delete_cascade(documents, {"labs": (labs, "document_id"), "reviews": (reviews, "document_id")}, documents.where("status = 'P'"))
    counts = [t.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def dml_replace_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with more than five labs get one summary lab instead."""
    labs = bindings.lab_results(spark, sf_dir).select("document_id", "test_key", "quantity")
    new = labs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max("quantity").alias("quantity")).where("n > 5").select("document_id", F.lit("SUMMARY").alias("test_key"), "quantity")
    return dml.replace_children(labs, new, "document_id")


def dml_mark_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts after a doctor has read all documents of one status."""
    documents, reviews = _tables(spark, sf_dir, "documents", "reviews")
    read = documents.where("status = 'O'").select(F.lit(DOCTOR).cast("long").alias("doctor_user_id"), F.col("id").alias("document_id"))
    return dml.upsert_missing(reviews, read, ["doctor_user_id", "document_id"])


def dml_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bindings.documents(spark, sf_dir)
    done = dml.set_where(documents, (F.col("status") == "O") & (F.col("amount") > 200000), {"is_verified": F.lit(1)})
    return done.select("id", F.col("is_verified").cast("int").alias("is_verified"))


def _select(columns: str, source: str) -> str:
    return f"WITH {SQL_ALL} SELECT {columns} FROM {source}"


_PAGE = "row_number() OVER (PARTITION BY {key} ORDER BY {order})::INT AS place, greatest(count(*) OVER (PARTITION BY {key}) - {n}, 0)::BIGINT AS hidden_count"
_SUMMARY = f"""WITH {SQL_POINTS}, summary AS (SELECT patient_id, test_key, count(*)::BIGINT AS n_points, max(CASE WHEN rn = 1 THEN value_num END) AS latest, max(CASE WHEN rn = 2 THEN value_num END) AS previous,
  round(max(CASE WHEN rn = 1 THEN value_num END) - max(CASE WHEN rn = 2 THEN value_num END), 2) AS delta, max(CASE WHEN rn = 1 THEN flag END) AS latest_flag FROM points WHERE rn <= 5 GROUP BY ALL)"""
_TIMELINE = f"""WITH {SQL_ALL}, items AS (SELECT patient_id, 'doc-' || id AS item_id, 'document' AS item_type, test_date AS item_at, sec AS title FROM full_docs
  UNION ALL SELECT patient_id, 'event-' || id, 'event', admitted_at, event_type FROM ev)"""
_FLAG_LIST = "[" + ", ".join(f"'{w}'" for w in FLAG_WORDS) + "]"

QUERIES = {f.__name__: f for f in (
    trend_last5, trend_latest_delta, trend_ordered, worklist_counts, worklist_top3_abnormal, worklist_care_context, patient_cards, profile_section_counts, document_payload_counts,
    patients_visible, patient_search, assignments_named, access_request_state, recent_jobs, abnormal_flags, any_abnormal_per_document, needs_review, unreviewed_anti, reviewed_semi,
    timeline_union, timeline_by_day, facet_options, first_page, dml_delete_cascade, dml_replace_labs, dml_mark_reviewed, dml_verify,
)}
ORACLE = {
    "trend_last5": f"WITH {SQL_POINTS} SELECT patient_id, test_key, document_id, strftime(test_date, '%Y-%m-%d') AS point_date, value_num AS point_value, flag, rn::INT AS recency FROM points WHERE rn <= 5",
    "trend_latest_delta": f"{_SUMMARY} SELECT * FROM summary",
    "trend_ordered": f"{_SUMMARY} SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY latest_flag = 'Normal', test_key)::INT AS place FROM summary",
    "worklist_counts": f"""WITH {SQL_ALL} SELECT a.doctor_user_id, a.patient_id, count(*) FILTER (r.document_id IS NULL) AS new_records_count,
      sum(CASE WHEN r.document_id IS NULL THEN n_abnormal ELSE 0 END)::BIGINT AS abnormal_count, count(*) FILTER (r.document_id IS NULL) > 0 AS has_new_records
      FROM access a JOIN full_docs d ON a.patient_id = d.patient_id LEFT JOIN reviews r ON r.document_id = d.id AND r.doctor_user_id = a.doctor_user_id GROUP BY 1, 2""",
    "worklist_top3_abnormal": f"""WITH {SQL_ALL}, ranked AS (SELECT a.doctor_user_id, a.patient_id, l.document_id, l.test_key, l.flag, row_number() OVER (PARTITION BY a.doctor_user_id, a.patient_id
      ORDER BY l.document_id DESC, line_no, part_id, l.doctor_user_id, quantity, price, discount, tax, ship_date)::INT AS place
      FROM access a JOIN docs d ON a.patient_id = d.patient_id JOIN labs l ON l.document_id = d.id AND l.flag <> 'Normal'
      LEFT JOIN reviews r ON r.document_id = d.id AND r.doctor_user_id = a.doctor_user_id WHERE r.document_id IS NULL) SELECT * FROM ranked WHERE place <= 3""",
    "worklist_care_context": f"""WITH {SQL_ALL}, l AS (SELECT patient_id, max(id) FILTER (status = 'active') AS act, max(id) AS lst FROM ev GROUP BY 1)
      SELECT c_custkey AS patient_id, CASE WHEN act IS NOT NULL THEN 'active' WHEN lst IS NOT NULL THEN 'past' ELSE 'outpatient' END AS care_context, coalesce(act, lst) AS event_id, e.event_type
      FROM customer LEFT JOIN l ON c_custkey = l.patient_id LEFT JOIN ev e ON e.id = coalesce(act, lst)""",
    "patient_cards": _select("id, patient_id, sec AS section, is_verified = 1 AS is_verified, n_abnormal > 0 AS has_abnormal", "full_docs"),
    "profile_section_counts": _select("patient_id, " + ", ".join(f"count(*) FILTER (sec = '{s}') AS n_{s}" for s in bindings.SECTIONS), "full_docs GROUP BY 1"),
    "document_payload_counts": _select("id, n_labs, n_abnormal, categories", "full_docs"),
    "patients_visible": _select("c_custkey AS id, c_name AS full_name", f"customer WHERE c_custkey IN (SELECT patient_id FROM access WHERE doctor_user_id = {DOCTOR})"),
    "patient_search": _select("c_custkey AS id, c_name AS full_name, doctor_user_id IS NOT NULL AS has_access", f"customer LEFT JOIN access ON patient_id = c_custkey AND doctor_user_id = {DOCTOR} WHERE contains(lower(c_name || ' ' || c_mktsegment), '{TERM}')"),
    "assignments_named": _select("doctor_user_id, patient_id, s.full_name AS doctor_name, hospital_name, c_name AS patient_name", "access LEFT JOIN doctors s ON s.id = doctor_user_id LEFT JOIN customer ON c_custkey = patient_id"),
    "access_request_state": _select("patient_id, arg_max(id, (admitted_at, id)) AS request_id, CASE arg_max(event_type, (admitted_at, id)) WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'denied' ELSE 'pending' END AS request_status", "ev GROUP BY 1"),
    "recent_jobs": f"SELECT * FROM (SELECT user_id AS patient_id, event_id AS job_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS place FROM events) WHERE place <= 30",
    "abnormal_flags": f"""WITH f AS (SELECT nullif({_FLAG_LIST}[(l_linenumber * 7 + l_partkey) % {len(FLAG_WORDS)} + 1], '-') AS flag FROM lineitem), w AS (SELECT flag, lower(trim(flag)) AS x FROM f)
      SELECT flag, coalesce(x NOT IN ('', 'normal', 'none', 'n', 'ok', 'within range'), false) AS worklist, coalesce(x NOT IN ('', 'normal', 'none', 'ok'), false) AS trend,
      coalesce(x IN ('high', 'low', 'abnormal', 'critical', 'borderline'), false) AS ui,
      CASE WHEN x IN ('high', 'h', 'crescut', 'mare', '↑', '▲') THEN 'High' WHEN x IN ('low', 'l', 'scazut', 'scăzut', 'mic', '↓', '▼') THEN 'Low' WHEN x IN ('normal', 'n') THEN 'Normal' END AS normal_form,
      count(*) AS n FROM w GROUP BY ALL""",
    "any_abnormal_per_document": _select("document_id, bool_or(flag <> 'Normal') AS any_abnormal", "labs GROUP BY 1"),
    "needs_review": _select("patient_id, count(*) AS n_to_review", f"full_docs WHERE n_abnormal > 0 AND id NOT IN (SELECT document_id FROM reviews WHERE doctor_user_id = {DOCTOR}) GROUP BY 1"),
    "unreviewed_anti": _select("id, patient_id", "docs WHERE id NOT IN (SELECT document_id FROM reviews)"),
    "reviewed_semi": _select("id, patient_id", f"docs WHERE id IN (SELECT document_id FROM reviews WHERE doctor_user_id = {DOCTOR})"),
    "timeline_union": f"{_TIMELINE} SELECT patient_id, item_id, item_type, title, place, hidden_count FROM (SELECT *, {_PAGE.format(key='patient_id', order='item_at DESC, item_id DESC', n=8)} FROM items) WHERE place <= 8",
    "timeline_by_day": f"""{_TIMELINE}, days AS (SELECT patient_id, item_at::DATE AS day, count(*) AS n_items FROM items GROUP BY ALL)
      SELECT patient_id, concat_ws('-', year(day), month(day), day(day)) AS date_key, n_items, (lag(year(day)) OVER (PARTITION BY patient_id ORDER BY day DESC)) IS DISTINCT FROM year(day) AS starts_year FROM days""",
    "facet_options": _select("patient_id, string_agg(DISTINCT year(test_date)::VARCHAR, ',' ORDER BY year(test_date)::VARCHAR DESC) AS years, string_agg(DISTINCT sec, ',' ORDER BY sec) AS sections", "full_docs GROUP BY 1"),
    "first_page": _select("patient_id, id, place, hidden_count", f"(SELECT *, {_PAGE.format(key='patient_id', order='test_date DESC, id DESC', n=10)} FROM docs) WHERE place <= 10"),
    "dml_delete_cascade": f"WITH {SQL_ALL}, gone AS (SELECT id FROM docs WHERE status = 'P') SELECT 'documents' AS table_name, count(*) AS n_rows FROM docs WHERE id NOT IN (FROM gone) UNION ALL SELECT 'labs', count(*) FROM labs WHERE document_id NOT IN (FROM gone) UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE document_id NOT IN (FROM gone)",
    "dml_replace_labs": f"WITH {SQL_ALL}, big AS (SELECT document_id, max(quantity) AS q FROM labs GROUP BY 1 HAVING count(*) > 5) SELECT document_id, test_key, quantity FROM labs WHERE document_id NOT IN (SELECT document_id FROM big) UNION ALL SELECT document_id, 'SUMMARY', q FROM big",
    "dml_mark_reviewed": f"WITH {SQL_ALL} SELECT doctor_user_id::BIGINT AS doctor_user_id, document_id FROM reviews UNION SELECT {DOCTOR}::BIGINT, id FROM docs WHERE status = 'O'",
    "dml_verify": _select("id, CASE WHEN status = 'O' AND amount > 200000 THEN 1 ELSE is_verified END::INT AS is_verified", "docs"),
}
