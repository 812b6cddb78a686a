"""Scalar functions over strings made from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions import dates, flags, numbers, texts
from clinframe.sources.bindings import read

#: Strings with {q} (whole number), {d} (two decimals) and {e} (one decimal) filled in.
VALUE_FORMS = ["{q}", "{d}", "<{d}", " {q} mg/dL ", "{q},5", "--", "nil", "−{q}", "+{q}", "1.{q}.3", ".{q}", "positive", "{q}-{q}", "n/a", "", "absent"]
RANGE_FORMS = ["{d} - {q}99.50", "{q}–{d}", "<{q}", "{q}", "({d}-{q})", "-{q} - {q}", "{q},5 - 9{q}", "", "x"]
FUSED_FORMS = ["{d}9{d}", "{e}8{e}", "{d}", "{d}-{d}", "{q}"]
UNIT_FORMS = ["G/DL", "10^3 / uL", "10 3/ul", "ui/ml", "foo {q}", "%", " fl ", "mmol/L", "10^12/L", "", "U/l", "10^9/l"]
DATE_FORMS = ["%Y-%m-%d", "%d.%m.%Y", "%-d/%-m/%Y", "%d %b %Y", "%d.%m.%Y 08:41", "%Y-%m-%dT08:00:00+00:00", "martie", "%Y-%m-%d 10:30"]


def _filled(form: str):
    out, rest = [], form
    while rest:
        cut = min((i for i in (rest.find("{q}"), rest.find("{d}"), rest.find("{e}")) if i >= 0), default=-1)
        if cut < 0:
            out.append(F.lit(rest))
            break
        if cut:
            out.append(F.lit(rest[:cut]))
        out.append(F.col({"q": "__q", "d": "__d", "e": "__e"}[rest[cut + 1]]))
        rest = rest[cut + 3 :]
    return F.concat(*out) if out else F.lit("")


def made(spark: SparkSession, sf_dir: str, forms: list[str]) -> DataFrame:
    """(text, n) of the distinct strings that the forms give over lineitem."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("int").cast("string").alias("__q"), (F.col("l_discount") * 7 + F.col("l_tax")).cast("decimal(10,2)").cast("string").alias("__d"),
        F.col("l_tax").cast("decimal(10,1)").cast("string").alias("__e"),
    ).distinct()
    return lines.select(F.explode(F.array(*[_filled(f) for f in forms])).alias("text")).distinct()


def _sql_made(forms: list[str]) -> str:
    def sql(form: str) -> str:
        text = form.replace("'", "''")
        for key, name in (("{q}", "q"), ("{d}", "d"), ("{e}", "e")):
            text = text.replace(key, f"' || {name} || '")
        return f"'{text}'"

    return f"""lines AS (SELECT DISTINCT l_quantity::INT::VARCHAR AS q, (l_discount * 7 + l_tax)::DECIMAL(10,2)::VARCHAR AS d, l_tax::DECIMAL(10,1)::VARCHAR AS e FROM lineitem),
made AS (SELECT DISTINCT unnest([{', '.join(map(sql, forms))}]) AS text FROM lines)"""


def num_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, VALUE_FORMS).select("text", numbers.lab_value(F.col("text")).alias("number"))


def value_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = numbers.normalise_value(F.col("text"))
    return made(spark, sf_dir, VALUE_FORMS).select("text", value.alias("value"), numbers.exact_number(value).alias("number"))


def range_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, RANGE_FORMS).select("text", numbers.normalise_range(F.col("text")).alias("reference_range"))


def range_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, FUSED_FORMS).select("text", numbers.split_fused(F.col("text")).alias("reference_range"))


def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, UNIT_FORMS).select("text", numbers.normalise_unit(F.col("text")).alias("unit"))


def flag_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, low, high = F.col("l_quantity"), F.col("l_discount") * 200, F.when(F.col("l_linenumber") > 1, F.col("l_tax") * 500)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", flags.infer(value, low, high).alias("flag")).groupBy("l_orderkey", "flag").agg(F.count(F.lit(1)).alias("n"))


def date_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark_forms = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%-d": "d", "%-m": "M", "%b": "MMM"}
    day = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    pieces = []
    for form in DATE_FORMS:
        pattern = "d 'martie' yyyy" if form == "martie" else form
        for a in ("%-d", "%-m", "%Y", "%m", "%d", "%b"):
            pattern = pattern.replace(a, spark_forms[a])
        for quoted in ("T08:00:00+00:00", " 08:41", " 10:30"):
            pattern = pattern.replace(quoted, f"'{quoted}'")
        pieces.append(F.date_format("day", pattern))
    return day.select(F.explode(F.array(*pieces)).alias("text")).distinct().select("text", dates.display(F.col("text")).alias("shown"))


def date_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    some = lambda k: F.when(key % k == 0, day).when(key % k == 1, F.lit(""))
    best = dates.best_document_date(some(3), some(4), some(5), F.lit(None).cast("string"), some(7), F.lit("created"))
    return o.select("o_orderkey", best.alias("best"), dates.clinical_date(some(4), some(3), some(5), some(7), F.lit("")).alias("clinical"))


def age_from_dob(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = dates.age(F.to_date("o_orderdate"), F.to_date(F.lit("1996-02-29")))
    return read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("born"), a["years"].alias("years"), a["months"].alias("months")).distinct()


def report_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("categories"))
    return per.select("l_orderkey", dates.report_title(F.col("categories"), F.to_date(F.lit("2024-03-02"))).alias("title"))


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts.clean(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("clean_md5"), F.length(texts.compact_key(F.col("text"))).alias("key_length"), texts.preview(F.col("text")).alias("preview"))


def string_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored strings of the first words of texts, with broken encoding and signs around them."""
    broken = F.concat(F.lit(" ;: Â"), F.substring("text", 1, 60), F.lit(" â€ 3–5\ufffd \u00a0 \ufeff:"))
    return read(spark, sf_dir, "documents").select("doc_id", texts.clean_string(broken).alias("cleaned"), texts.clean_string(F.lit(" Â\ufffd;")).alias("nothing"))


KEYWORDS = ["result", "the", "test", "que", "die"]


def ocr_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "documents").select("doc_id", texts.ocr_quality(F.col("text"), KEYWORDS).alias("q"))
    return q.select("doc_id", "q.score", "q.level", "q.warning")


_PLAIN = "translate(text, ',−–—', '.---')"
_RANGE = f"""found AS (SELECT text, regexp_extract_all({_PLAIN}, '[-+]?[0-9]+(?:\\.[0-9]+)?') AS f FROM made),
ab AS (SELECT text, f[1] AS a, CASE WHEN f[2] LIKE '-%' AND f[1] NOT LIKE '-%' THEN substr(f[2], 2) ELSE f[2] END AS b FROM found)"""
_UNIT_CASES = " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{n}'" for p, n in numbers.POWER_UNITS) + " " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in numbers.UNITS.items())
_NIL = ", ".join(f"'{x}'" for x in numbers.VALUE_NIL)
_SOME = "CASE WHEN o_orderkey % {k} = 0 THEN day WHEN o_orderkey % {k} = 1 THEN '' END"
_SQL_FORMS = ", ".join("strftime(day, '%-d') || ' martie ' || strftime(day, '%Y')" if f == "martie" else f"strftime(day, '{f}')" for f in DATE_FORMS)
_FILL = lambda *ks: ", ".join(f"nullif({_SOME.format(k=k)}, '')" for k in ks)

QUERIES = {f.__name__: f for f in (num_parse, value_normalize, range_normalize, range_fused, unit_normalize, flag_infer, date_display, date_best, age_from_dob, report_titles, text_clean, string_clean, ocr_quality_score)}
ORACLE = {
    "num_parse": f"WITH {_sql_made(VALUE_FORMS)}, x AS (SELECT text, lower(trim({_PLAIN})) AS t FROM made) SELECT text, CASE WHEN t NOT IN ('', '-', '--', '---', 'nil', 'n/a', 'na', 'null', 'none') THEN nullif(regexp_extract(t, '[-+]?[0-9]+(?:\\.[0-9]+)?'), '')::DOUBLE END AS number FROM x",
    "value_normalize": f"""WITH {_sql_made(VALUE_FORMS)}, x AS (SELECT text, regexp_replace({_PLAIN}, '[^0-9.+-]', '', 'g') AS k FROM made), y AS (SELECT text, CASE WHEN k LIKE '.%' THEN '0' || k ELSE k END AS k FROM x),
      z AS (SELECT text, CASE WHEN NOT (lower(trim(text)) IN ({_NIL}) OR k IN ('', '+', '-', '.', '+.', '-.', {_NIL})) THEN k END AS value FROM y)
      SELECT text, value, CASE WHEN regexp_matches(value, '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN try_cast(value AS DOUBLE) END AS number FROM z""",
    "range_normalize": f"WITH {_sql_made(RANGE_FORMS)}, {_RANGE} SELECT text, CASE WHEN b::DOUBLE < a::DOUBLE THEN b || ' - ' || a ELSE a || ' - ' || b END AS reference_range FROM ab",
    "range_fused": f"""WITH {_sql_made(FUSED_FORMS)}, p AS (SELECT text, regexp_extract(text, '{numbers.FUSED[0]}', 1) AS a, regexp_extract(text, '{numbers.FUSED[0]}', 2) AS b, regexp_extract(text, '{numbers.FUSED[1]}', 1) AS c, regexp_extract(text, '{numbers.FUSED[1]}', 2) AS d FROM made)
      SELECT text, CASE WHEN try_cast(b AS DOUBLE) > try_cast(a AS DOUBLE) THEN a || ' - ' || b WHEN try_cast(d AS DOUBLE) > try_cast(c AS DOUBLE) THEN c || ' - ' || d END AS reference_range FROM p""",
    "unit_normalize": f"WITH {_sql_made(UNIT_FORMS)}, x AS (SELECT text, lower(replace(trim(text), ' ', '')) AS c FROM made) SELECT text, CASE WHEN trim(text) = '' THEN NULL {_UNIT_CASES} WHEN c = '%' THEN '%' ELSE trim(text) END AS unit FROM x",
    "flag_infer": """WITH x AS (SELECT l_orderkey, l_quantity AS v, l_discount * 200 AS a, CASE WHEN l_linenumber > 1 THEN l_tax * 500 END AS b FROM lineitem)
      SELECT l_orderkey, CASE WHEN b IS NULL THEN NULL WHEN v < least(a, b) THEN 'Low' WHEN v > greatest(a, b) THEN 'High' ELSE 'Normal' END AS flag, count(*) AS n FROM x GROUP BY 1, 2""",
    "date_display": f"""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), t AS (SELECT DISTINCT day, unnest([{_SQL_FORMS}]) AS text FROM d),
      s AS (SELECT DISTINCT text, CASE WHEN text LIKE '%+00:00' THEN NULL WHEN text LIKE '%martie%' THEN split_part(text, ' ', 1).lpad(2, '0') || ' Mar ' || strftime(day, '%Y')
        WHEN text LIKE '%:%' THEN strftime(day, '%d %b %Y') || ' ' || right(text, 5) ELSE strftime(day, '%d %b %Y') END AS shown FROM t)
      SELECT text, shown FROM s""",
    "date_best": f"WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) SELECT o_orderkey, coalesce({_FILL(3, 4, 5, 7)}, 'created') AS best, coalesce({_FILL(4, 3, 5, 7)}, '') AS clinical FROM o",
    "age_from_dob": """WITH b AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), m AS (SELECT d, (1996 - year(d)) * 12 + 2 - month(d) - (29 < day(d))::INT AS m FROM b)
      SELECT strftime(d, '%Y-%m-%d') AS born, CASE WHEN m >= 0 THEN (m // 12)::INT END AS years, CASE WHEN m >= 0 THEN (m % 12)::INT END AS months FROM m""",
    "report_titles": """WITH c AS (SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
      SELECT l_orderkey, CASE WHEN len(c) = 1 THEN c[1] ELSE array_to_string(c[1:len(c) - 1], ', ') || ' & ' || c[len(c)] END || ' 02 Mar 2024' AS title FROM c""",
    "text_clean": """SELECT doc_id, md5(trim(regexp_replace(translate(replace(translate(text, chr(65279) || '�Â', ''), 'â€', ''), 'µμ−–—＃％︱|ΜΟΝ', 'uu---#%  MON'), '[ \\t\\r\\n\\f\\x0B\\x{A0}]+', ' ', 'g'))) AS clean_md5,
      length(regexp_replace(lower(text), '[^a-z0-9%#]', '', 'g'))::INT AS key_length, CASE WHEN length(text) > 180 THEN left(text, 180) || '...' ELSE nullif(text, '') END AS preview FROM documents""",
    "string_clean": """SELECT doc_id, nullif(regexp_replace(regexp_replace(replace(translate(' ;: Â' || substr(text, 1, 60) || ' â€ 3–5' || chr(65533) || ' ' || chr(160) || ' ' || chr(65279) || ':', '−–—' || chr(65279) || 'Â' || chr(65533), '---'), 'â€', ''),
      '[ \\t\\r\\n\\f\\x0B\\x{A0}]+', ' ', 'g'), '^[ ;:]+|[ ;:]+$', '', 'g'), '') AS cleaned, NULL::VARCHAR AS nothing FROM documents""",
    "ocr_quality_score": f"""WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents), y AS (SELECT doc_id, t, length(t) AS n, length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters,
        length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits, len(list_filter(string_split(t, chr(10)), lambda l: trim(l) <> '')) AS lines, {' + '.join(f"contains(lower(t), '{k}')::INT" for k in KEYWORDS)} AS hits FROM x),
      s AS (SELECT doc_id, t, CASE WHEN t = '' THEN 0 ELSE CASE WHEN n >= 200 THEN 25 WHEN n >= 80 THEN 15 ELSE 0 END + CASE WHEN letters >= 80 THEN 20 ELSE 0 END + CASE WHEN digits >= 10 THEN 20 ELSE 0 END + CASE WHEN lines >= 5 THEN 15 ELSE 0 END
        + CASE WHEN hits >= 3 THEN 20 WHEN hits >= 1 THEN 10 ELSE 0 END END AS k FROM y)
      SELECT doc_id, round(k / 100.0::DOUBLE, 2) AS score, CASE WHEN t = '' THEN 'empty' WHEN k >= 70 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS level,
      CASE WHEN t = '' THEN 'No text could be extracted from this document.' WHEN k < 40 THEN 'Text quality appears low. Manual review is recommended.' WHEN k < 70 THEN 'Text quality is moderate. Some fields may need review.' END AS warning FROM s""",
}
