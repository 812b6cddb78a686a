"""The logical chart tables, bound to the driver's star-schema tables.

Each function gives one logical table as a lazy frame with only the columns the read models use, so that
column pruning reaches the Parquet scan. Row order inside a document is the stated tie-break list: the lab
table has no key of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ["notes", "bloodwork", "medications", "scans", "hospitalizations", "other"]
LAB_ORDER = ["test_date", "document_id", "line_no", "part_id", "doctor_user_id", "quantity", "price", "discount", "tax", "ship_date"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files to a task, about half a million lab lines.
TASK_BYTES = 8 << 20


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Size of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(at).getLength()


def dealt(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """df by keys in as many tasks as size bytes of input need, where these are more than the session's: a task's rows stay as many when tables grow."""
    n = size // TASK_BYTES
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("patient_identifier"),
        F.col("c_nationkey").alias("nation_id"), F.col("c_acctbal").alias("balance"),
    )


def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("hospital_name"))
    joined = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), "hospital_name", F.lit("doctor").alias("role"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doctors as user accounts."""
    name = F.col("full_name")
    return doctors(spark, sf_dir).select("id", "full_name", F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"), "role", F.lit(None).cast("string").alias("department"), "hospital_name", F.md5(name).alias("password_hash"))


def section_of_order():
    """Priorities 1-3 are bloodwork; 5-LOW is dealt by key; 4 stays unmapped, for the fallback to `other`."""
    p = F.col("o_orderpriority")
    dealt = F.element_at(F.array(*[F.lit(s) for s in ("scans", "notes", "medications", "hospitalizations")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return F.when(p.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.lit("bloodwork")).when(p == "5-LOW", dealt).otherwise(F.lit("unmapped"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), section_of_order().alias("section"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_verified"), F.col("o_orderdate").alias("test_date"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 120).alias("uploaded_by"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("scan_"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).alias("filename"),
        F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("Report "), F.col("o_orderkey").cast("string"))).alias("report_name"), F.when(F.col("o_orderkey") % 5 == 0, F.repeat(F.lit("note "), (F.col("o_orderkey") % 60).cast("int"))).alias("note"),
    )


def lab_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labs without what their tests are called: no join."""
    return _lab_lines(spark, sf_dir)


def lab_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(_lab_lines(spark, sf_dir), spark, sf_dir)


def named(labs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labs with what their tests are called; for rows that have been joined and filtered, so that fewer and thinner ones are moved."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("test_key"), F.col("p_brand").alias("category"), F.col("p_name").alias("display_name"))
    return labs.join(part, F.col("part_id") == F.col("p_partkey")).drop("p_partkey")


def _lab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "High").when(F.col("l_returnflag") == "R", "Low").otherwise("Normal")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("doctor_user_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("ship_date"),
        F.col("l_linestatus").alias("line_status"), F.col("l_quantity").cast("string").alias("value"), flag.alias("flag"),
    )


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doctor-patient bridge, one row per pair. Lines, orders and pairs are dealt to tasks by the size of the lines' table."""
    size = table_bytes(spark, sf_dir, "lineitem")
    lines = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("doctor_user_id")), size, "l_orderkey")
    orders = dealt(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id")), size, "o_orderkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("doctor_user_id", "patient_id")
    return dealt(pairs, size, "doctor_user_id", "patient_id").distinct()


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review receipts, one row per (doctor, document)."""
    return read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("doctor_user_id"), F.col("l_orderkey").alias("document_id")).distinct()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), "event_type", F.col("ts").alias("admitted_at"), "value", "props",
        F.when(F.col("event_type").isin("signup", "purchase"), "active").otherwise("discharged").alias("status"), (F.col("event_id") % 120).alias("doctor_user_id"),
        F.when(~F.col("event_type").isin("signup", "purchase") & (F.col("event_id") % 3 == 0), F.date_format(F.date_add("ts", 2), "yyyy-MM-dd")).alias("discharged_on"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access requests: one for each event."""
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "denied").otherwise("pending")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 120).alias("doctor_user_id"), F.col("user_id").alias("patient_id"), status.alias("status"), F.col("ts").alias("requested_at"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log: an entry for each line that has come back."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    action = F.when(F.col("l_returnflag") == "A", "edited").otherwise("verified")
    return lines.select(F.col("l_orderkey").alias("document_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), action.alias("action"), F.col("l_suppkey").cast("string").alias("actor")).distinct()
