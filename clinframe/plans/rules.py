"""Queries over text rules, each answered by stated examples: forms with numbers of the driver's rows, and what they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.functions import cells, dates, flags, header, keys, payloads, texts
from clinframe.operators import extraction
from clinframe.plans.scalars import _filled, made
from clinframe.sources import files
from clinframe.sources.bindings import read

#: Forms, and for each column what the form means; {q} is a whole number from 1, {d} two decimals, {e} one decimal below 1.
KEY_FORMS = {
    "WBC": ("WBC", "WBC"), "hgb {q}": ("HGB", "HGB"), "Hemoglobina (HGB)": (None, None), "RDW SD": ("RDW-SD", "RDW-SD"), "rdw_cv:{q}": ("RDW-CV", "RDW-CV"), "P LCR": ("P-LCR", "P-LCR"), "LCR {q}": ("P-LCR", None),
    "Neut # {q}": ("NEUT#", "NEUT#"), "NEUT#": ("NEUT#", "NEUT#"), "Lymph abs %": ("LYMPH%", "LYMPH%"), "M0N0%": ("MONO%", "MONO%"), "BAS0#": ("BASO#", None), "EOS": ("EO", "EO"), "eos#/x": ("EO#", "EO#"),
    "Glucoza {q}": ("GLUCOZA", "GLUCOZA"), "{q}": (None, None), "": (None, None), "foo|TSH": ("TSH", "TSH"), "ΜΟΝΟ#": ("MONO#", "MONO#"), "IG％": ("IG%", "IG%"), "A.L.T": ("ALT", "ALT"),
}
RANGE_FORMS = {
    # form: (table range, text range, table result, unit)
    "{q} - 99": ("{q} - 99", "{q} - 99", None, None), "{d}–99,5 g/dL": ("{d} - 99.5", "{d} - 99.5", None, "g/dL"), "99 - {q} %": ("{q} - 99", "{q} - 99", None, "%"), "-{q} - 60": ("-{q} - 60", "{q} - 60", None, None),
    "3.936.08": ("3.93 - 6.08", "3.93 - 6.08", None, None), "34.151.0 fL": ("34.1 - 51.0", "34.1 - 51.0", None, "fL"), "6.083.93": ("3.93 - 6.08", "6.083 - 93", None, None), "{q} 99": (None, "{q} - 99", None, None),
    "{q} 99 pg": ("{q} - 99", "{q} - 99", None, "pg"), "{q}": (None, None, "{q}", None), "+{q},5": (None, None, "{q}.5", None), "{d} mg / dl": (None, None, "{d}", "mg/dL"), "nil": (None, None, None, None), "--": (None, None, None, None),
    "10^3/uL": (None, None, None, "10^3/uL"), "{q} 10 3/ul": (None, None, "{q}", "10^3/uL"), "103": (None, None, "103", None), "99 U/L": (None, None, "99", "U/L"), "2023 {q}": (None, None, None, None), "text {q} more": (None, None, "{q}", None),
    "text": (None, None, None, None), "": (None, None, None, None), "{q} umol/L": (None, None, "{q}", "umol/L"), "10^12/L": (None, None, None, "10^12/L"), "9 mIU/L": (None, None, "9", "mIU/L"),
}
LINE_FORMS = {
    # form: (nil, nil in text, header, unit only, explicit flag)
    "Denumire analiza": (False, False, True, False, None), "Validat de Dr {q}": (False, False, True, False, None), "": (True, True, True, False, None), "{q} ↑": (False, False, False, False, "High"), "{q} scăzut x": (False, False, False, False, "Low"),
    "high": (False, False, False, False, "High"), "highest": (False, False, False, False, None), "g/dL": (False, False, False, True, None), "{q} g/dL": (False, False, False, False, None), "-----": (False, True, False, False, None),
    "__": (False, True, False, False, None), "N/A": (True, True, False, False, None), "absent": (True, True, False, False, None), "UM": (False, False, True, False, None), "see http://{q}": (False, False, True, False, None), "%": (False, False, False, True, None),
}
DATE_FORMS = {
    # form: (shown, title time, strict key is set)
    "{q2}.03.2023 08:41": ("{q2} Mar 2023 08:41", "2023-03-{q2} 08:41:00"), "{q2} martie 2023": ("{q2} Mar 2023", None), "{q2} MAR, 2023": ("{q2} Mar 2023", None), "2023-3-{q2}": ("{q2} Mar 2023", "2023-03-{q2} 00:00:00"),
    "2023-03-{q2}T08:00:00+00:00": (None, "2023-03-{q2} 08:00:00"), "2023-03-{q2}T08:00:00.123Z": (None, "2023-03-{q2} 08:00:00"), "{q2}/12/1899": (None, "1899-12-{q2} 00:00:00"), "sometime in {q2}": ("sometime in {q2}", None),
    "{q2}-01-2020 7:05": ("{q2} Jan 2020 07:05", "2020-01-{q2} 07:05:00"), "": (None, None), " : ": (None, None), "{q2} noiembrie 2019 10:30": ("{q2} Nov 2019 10:30", None), "{q2}/02/2021 10:30:15": ("{q2}/02/2021 10:30:15", "2021-02-{q2} 10:30:15"),
}


def _fill(form: str) -> str:
    """SQL of a form over q, q2, d and e."""
    text = form.replace("'", "''")
    for key in ("q2", "q", "d", "e"):
        text = text.replace("{" + key + "}", f"' || {key} || '")
    return f"'{text}'"


_SQL_LINES = "SELECT DISTINCT l_quantity::INT::VARCHAR AS q, (l_quantity::INT % 28 + 1)::VARCHAR.lpad(2, '0') AS q2, (l_discount * 7 + l_tax)::DECIMAL(10,2)::VARCHAR AS d, l_tax::DECIMAL(10,1)::VARCHAR AS e FROM lineitem"


def _examples(forms: dict[str, tuple], names: list[str]) -> str:
    value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else _fill(v)
    rows = ", ".join("{text: " + _fill(f) + ", " + ", ".join(f"{n}: {value(v)}" for n, v in zip(names, want)) + "}" for f, want in forms.items())
    return f"WITH l AS ({_SQL_LINES}) SELECT DISTINCT x.* FROM (SELECT unnest([{rows}]) AS x FROM l)"


def key_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return made(spark, sf_dir, list(KEY_FORMS)).select("text", keys.detect_key(c).alias("in_table"), keys.detect_token_key(c).alias("in_text"))


def range_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return made(spark, sf_dir, list(RANGE_FORMS)).select("text", cells.range_of(c).alias("in_table"), cells.text_range(c).alias("in_text"), cells.result_of(c).alias("result"), cells.unit_of(c).alias("unit"))


def line_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return made(spark, sf_dir, list(LINE_FORMS)).select("text", cells.is_nil(c).alias("nil"), cells.is_nil_text(c).alias("nil_in_text"), cells.is_header(c).alias("header"), cells.is_unit_only(c).alias("unit_only"), cells.explicit_flag(c).alias("flag"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.lpad((F.col("l_quantity").cast("int") % 28 + 1).cast("string"), 2, "0").alias("__q")).distinct()
    made_ = lines.select(F.explode(F.array(*[_filled(f.replace("{q2}", "{q}")) for f in DATE_FORMS])).alias("text")).distinct()
    c = F.col("text")
    return made_.select("text", dates.display(c).alias("shown"), F.date_format(dates.title_time(c), "yyyy-MM-dd HH:mm:ss").alias("title_time"))


HEADERS = [
    "BULETIN ANALIZE MEDICALE\nNume: {name} CNP: {cnp}\nSex: F Varsta: {age} ani\nCod pacient: P-{id}\nMedic: IONESCU DAN Sectie ATI\nData si ora recoltarii: {d1} 08:41 Data validare: {d2}\nHemograma\nSynevo Iasi",
    "Patient ID: X{id} Name: {name}\nAge {age} years Gender: M\nCollected on: the morning of {d1}\nReported on {d2}\nSample type: Blood",
    "Telefon 0722 Pacient - {name}\nGen: Masculin\nRegina Maria Iasi\nDr. Popa Ion Data {d1}\nRezultate biochimie",
    "no header at all {age}",
    "Medical numeric note: seen {d1}, then {d2} and {d1}",
]
_META = ["patient_name", "age", "sex", "cnp", "patient_identifier", "lab_name", "sample_type", "referring_doctor", "report_name", "source_language", "test_date", "collected_on", "reported_on", "registered_on"]
_META_WANT = [
    ("{name}", "{age} ani", "Female", "{cnp}", "P-{id}", "Synevo Iasi", None, "IONESCU DAN", "Hematologie {s1} 08:41", "ro", "{s1} 08:41", "{s1} 08:41", "{s2}", None),
    ("{name}", "{age} years", None, None, "X{id}", None, "Blood", None, "Analize medicale {s1}", "en", "{s1}", "{s1}", "{s2}", None),
    ("{name}", None, "Male", None, None, "Regina Maria Iasi", None, "Popa Ion", "Biochimie {s1}", "en", "{s1}", "{s1}", None, None),
    (None, None, None, None, None, None, None, None, "Analize medicale", "en", None, None, None, None),
    (None, None, None, None, None, None, None, None, "Analize medicale {s1}", "ro", "{s1}", "{s1}", None, None),
]


def meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of reports in five layouts, one for each order."""
    # A file of narrow rows makes few tasks, and each row is a text to be searched.
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    parts = {
        "name": F.concat(F.lit("POP ANA "), F.element_at(F.array(*[F.lit(x) for x in ("MARIA", "IOANA", "ELENA")]), (F.col("o_custkey") % 3 + 1).cast("int"))), "cnp": F.lpad(F.col("o_orderkey").cast("string"), 13, "2"),
        "age": (F.col("o_custkey") % 80 + 10).cast("string"), "id": F.concat(F.lit("A"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")), "d1": F.date_format("o_orderdate", "dd.MM.yyyy"), "d2": F.date_format(F.date_add("o_orderdate", 3), "d MMM yyyy"),
    }
    text = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (F.col("o_orderkey") % len(HEADERS) + 1).cast("int"))
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    found = o.select("o_orderkey", header.metadata(text).alias("m"))
    return found.select("o_orderkey", *[F.col(f"m.{f}").alias(f) for f in _META])


def _sql_meta() -> str:
    def sql(v: str | None) -> str:
        if v is None:
            return "NULL"
        for key in ("name", "cnp", "age", "id", "s1", "s2"):
            v = v.replace("{" + key + "}", f"' || {key} || '")
        return f"'{v}'"

    columns = ", ".join(f"CASE o_orderkey % {len(HEADERS)} " + " ".join(f"WHEN {i} THEN {sql(w[k])}" for i, w in enumerate(_META_WANT)) + f" END AS {f}" for k, f in enumerate(_META))
    return f"""WITH p AS (SELECT o_orderkey, 'POP ANA ' || ['MARIA','IOANA','ELENA'][(o_custkey % 3 + 1)] AS name, lpad(o_orderkey::VARCHAR, 13, '2') AS cnp, (o_custkey % 80 + 10)::VARCHAR AS age, 'A' || lpad(o_custkey::VARCHAR, 6, '0') AS id,
      strftime(o_orderdate, '%d %b %Y') AS s1, strftime(o_orderdate + INTERVAL 3 DAY, '%d %b %Y') AS s2 FROM orders) SELECT o_orderkey, {columns} FROM p"""


ANSWERS = {
    # answer: (object found, name, value, flag, range, category, confidence)
    '{"labs":[{"test":"WBC","value":"{q},5","flag":"crescut","reference_range":"1–2","confidence":0.5}]}': ("WBC", "{q}.5", "High", "1-2", "Hematologie", 0.5),
    '```json\n{"labs":[{"name":"TSH","value":"{q}","flag":"normal","category":"Endocrinologie"}]}\n```': ("TSH", "{q}", None, None, "Endocrinologie", 0.86),
    'Here: {"labs":[{"raw_test_name":"","display_name":"K","value":" nil ","flag":"low","reference_range":"3 - 5"}]} done': ("K", None, None, "3 - 5", "Hematologie", 0.86), "no object {q}": (None, None, None, None, None, None),
    '{"labs":[{"name":"Na","value":"{q}","flag":"Normal","reference_range":" 1 - 2 ","unit":" ","confidence":0}]}': ("Na", "{q}", "Normal", "1 - 2", "Hematologie", 0.86), "{q} {broken": (None, None, None, None, None, None),
}


def json_ai_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of answers in JSON, with or without fences and words around them."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("q")).distinct()
    pieces = lambda f: [x for part in f.split("{q}") for x in (F.lit(part), F.col("q"))][:-1]
    texts_ = lines.select(F.explode(F.array(*[F.concat(*pieces(f)) for f in ANSWERS])).alias("text")).distinct()
    labs = F.from_json(payloads.object_in(F.col("text")), payloads.ANSWER)["labs"]
    row = texts_.select("text", F.when(F.size(labs) > 0, payloads.lab_row(labs[0])).alias("r"))
    return row.select("text", F.col("r.raw_test_name").alias("name"), "r.value", "r.flag", "r.reference_range", "r.category", "r.confidence")


def _sql_answers() -> str:
    def value(v) -> str:
        if v is None:
            return "NULL"
        return f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("{q}", "' || q || '") + "'"

    rows = ", ".join("{text: " + value(f) + ", " + ", ".join(f"{n}: {value(v)}" for n, v in zip(("name", "value", "flag", "reference_range", "category", "confidence"), w)) + "}" for f, w in ANSWERS.items())
    return f"WITH l AS (SELECT DISTINCT l_quantity::INT::VARCHAR AS q FROM lineitem) SELECT DISTINCT x.* FROM (SELECT unnest([{rows}]) AS x FROM l)"


def warning_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of each order, trimmed, without empty and repeated ones, in order."""
    o = read(spark, sf_dir, "orders")
    w = F.array(F.lit(" low quality "), F.when(F.col("o_orderkey") % 2 == 0, "low quality").otherwise(""), F.col("o_orderstatus"), F.lit(None).cast("string"), F.concat(F.col("o_orderstatus"), F.lit(" ")), F.col("o_orderpriority"))
    return o.select("o_orderkey", F.array_join(extraction.distinct_warnings(w), "|").alias("warnings"))


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-empty field over an order's lines, as over a report's pages."""
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page")).agg(F.max("l_returnflag").alias("f"), F.min("l_partkey").alias("p"))
    pages = l.select("document", "page", F.when(F.col("p") % 3 == 0, "").when(F.col("p") % 3 == 1, F.concat("f", F.col("p").cast("string"))).alias("name"), F.when(F.col("p") % 2 == 0, F.col("p").cast("string")).alias("sex"))
    return extraction.first_filled_fields(pages, ["name", "sex"])


def distinct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an order's lines, the first of equal name, value and unit."""
    l = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("n"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.lower(F.concat(F.lit(" "), "l_returnflag"))).alias("raw_test_name"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_linestatus")).alias("value"), F.lit(None).cast("string").alias("unit"),
    )
    return extraction.distinct_rows(l).select("document", "page", "n", F.trim("raw_test_name").alias("raw_test_name"), "value")


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, names and sizes of uploads made from orders."""
    names = ["a/b.PDF", "scan.jpeg", "note", "x.tar.png", "", "c\\d.tiff"]
    o = read(spark, sf_dir, "orders")
    name, size = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names) + 1).cast("int")), (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 0.001).when(F.col("o_orderkey") % 3 == 1, 1).otherwise(100)).cast("long")
    return o.select("o_orderkey", files.mime_type(name).alias("content_type"), files.landing_name(name, F.timestamp_seconds(F.col("o_orderkey"))).alias("stored_name"), files.badge(name).alias("badge"), files.size_label(size).alias("size"))


def text_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut down to what stands around their markers."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(files.compact(F.col("text"), ["the", "PLT", "que"])).alias("digest"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clean blocks of lines; length of the normalised and of the spaced form."""
    c = F.col("text")
    lines = texts.lines_of(c)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.split(texts.clean_block(c), "\n")).alias("n_block_lines"), F.size(lines).alias("n_lines"), F.length(texts.clean_spaces(c)).alias("n_spaced"))


FLAG_FORMS = ["High", "normal", " Normal ", "", None, "critical", "ok", "--"]


def ui_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pages show flags: abnormal by list (not for missing values), by difference from normal, and the style of a value."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.element_at(F.array(*[F.lit(f).cast("string") for f in FLAG_FORMS]), (F.col("l_partkey") % len(FLAG_FORMS) + 1).cast("int")).alias("flag"), F.element_at(F.array(F.lit("5"), F.lit("--"), F.lit("nil"), F.lit(" ")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("value"),
        F.when(F.col("l_linenumber") % 2 == 0, "1 - 2").alias("reference_range"),
    )
    v, f, r = F.col("value"), F.col("flag"), F.col("reference_range")
    shown = rows.select("value", "flag", "reference_range", flags.page_abnormal(v, f).alias("abnormal"), flags.differs_from_normal(f).alias("differs"), flags.differs_from_normal(f, exact=True).alias("differs_exactly"), flags.style(v, f).alias("style"), flags.shown_value(v).alias("shown"), flags.saved_flag(v, r, f).alias("saved"))
    return shown.groupBy(*shown.columns).agg(F.count(F.lit(1)).alias("n"))


def report_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of orders, their marks as anchors and polygons, rendered as tables, lines and tokens and joined to one text; and what was found, as a sentence."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    word = F.concat(F.lit("w"), F.col("p").cast("string"))
    full = F.concat(word, F.lit(" x"))
    mark = lambda start, end: F.struct(F.array(F.struct(start.alias("start"), end.alias("end"))).alias("segments"), F.array(*[F.struct(F.lit(x).alias("x"), (F.lit(y) - F.col("l_linenumber") * 0.1).alias("y")) for x, y in ((0.1, 0.7), (0.2, 0.8))]).alias("vertices"))
    pages = l.select(F.col("l_orderkey").alias("document"), F.lit(0).alias("page"), full.alias("full_text"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), F.array(mark(F.lit(0), F.length(word)), mark(F.length(word), F.length(word))).alias("tokens"))
    tokens = extraction.flatten_marks(pages, "tokens")
    cells_ = l.select(F.col("l_orderkey").alias("document"), F.lit(0).alias("page"), F.lit(0).alias("table_no"), F.col("l_linenumber").alias("row_no"), F.posexplode(F.array(word, F.lit("x"))).alias("cell_no", "text"))
    marks, tables = extraction.reading_orders(tokens, lines="\n", tokens=" "), extraction.rendered_tables(cells_).toDF("d3", "tables")
    both = marks.join(tables, F.col("document") == F.col("d3"))
    text = extraction.assembled(F.when(F.col("document") % 2 == 0, "plain"), F.col("lines"), F.col("tables"), F.col("tokens"))
    n = F.size(F.split("lines", "\n"))
    return both.select("document", text.alias("text"), extraction.counts_line(n, F.lit(1), n, n).alias("found"), F.size(texts.lines_of(text, "--- TOKENS ---")).alias("n_token_lines"))


AGES = ["years", "months"]


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pages read, sort, key and label dates: day first, two-digit years, ISO only for strict keys; ages in words."""
    o = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    forms = F.array(F.date_format(day, "d.M.yy"), F.date_format(day, "d/M/yyyy"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd MMM yyyy"), F.lit("soon"))
    text = F.element_at(forms, (F.col("o_orderkey") % 5 + 1).cast("int"))
    age = dates.age(F.to_date(day), F.to_date(F.lit("2002-06-15")))
    none = F.lit(None).cast("string")
    label = dates.date_label(F.when(F.col("o_orderkey") % 4 == 0, text), F.when(F.col("o_orderkey") % 4 == 1, text), F.when(F.col("o_orderkey") % 4 == 2, text), none)
    return o.select("o_orderkey", dates.page_time(text).alias("page_time"), dates.iso_key(text).alias("iso_key"), dates.date_key(F.when(F.col("o_orderkey") % 3 > 0, day)).alias("date_key"), label.alias("label"), dates.age_label(age).alias("age"))


def name_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a lab's names worklists, trends and pages show, its trend key and its merge key."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    some = lambda n, word: F.when(F.col("k") % n == 0, None).when(F.col("k") % n == 1, "").otherwise(F.concat(F.lit(word), (F.col("k") % 10).cast("string")))
    raw, canonical, display = F.when(F.col("k") % 7 == 3, "rdw sd").otherwise(some(3, "r")), some(4, "C"), some(5, "d")
    return l.select(
        "k", texts.first_filled(display, raw, canonical).alias("worklist"), texts.first_filled(canonical, display, raw).alias("trend_key"), texts.first_filled(display, canonical, raw).alias("page"), keys.identity(raw, canonical, display).alias("identity"),
        keys.merge_key(raw, canonical, display).alias("merge_key"),
    )


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of responses: their own, or their parts line by line."""
    q = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("q")).distinct()
    forms = ['{"output_text": "a{q}"}', '{"output": [{"content": [{"type": "text", "text": "b{q}"}, {"type": "image", "text": "no"}, {"type": "output_text", "text": "c"}]}, {"content": null}]}', '{"other": "{q}"}', "no json {q}"]
    pieces = lambda f: [x for part in f.split("{q}") for x in (F.lit(part), F.col("q"))][:-1]
    made_ = q.select(F.explode(F.array(*[F.concat(*pieces(f)) for f in forms])).alias("response"))
    return made_.select("response", F.coalesce(payloads.answer_text(F.col("response")), F.lit("")).alias("text"))


def ui_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials, pretty names, dashes and titles of pages."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(F.lit("mark_reviewed_late"), F.lit(" "), F.lit("edited")), (k % 3 + 1).cast("int"))
    name = F.element_at(F.array(F.lit("ana maria pop"), F.lit(" dan "), F.lit("")), (k % 3 + 1).cast("int"))
    return o.select(
        "o_orderkey", texts.initials(name).alias("initials"), texts.pretty(F.trim(status)).alias("action"), texts.or_dash(status).alias("shown"), texts.document_title(F.when(k % 2 == 0, "R"), F.when(k % 3 == 0, "f.pdf").otherwise(""), k).alias("title"),
        texts.joined(F.when(k % 2 == 0, "A"), F.when(k % 3 == 0, "B")).alias("uploader"), texts.title_of(F.lit("lab_notes")).alias("section"),
    )


QUERIES = {f.__name__: f for f in (
    key_detect, range_extract, line_class, date_forms, meta_fields, json_ai_rows, warning_dedup, page_fields, distinct_answers, file_labels, text_compact, text_blocks, ui_flags, report_assembly, page_dates, name_orders, answer_texts, ui_texts,
)}
_FLAGS = "[" + ", ".join("NULL" if f is None else f"'{f}'" for f in FLAG_FORMS) + "]"
ORACLE = {
    "key_detect": _examples(KEY_FORMS, ["in_table", "in_text"]), "range_extract": _examples(RANGE_FORMS, ["in_table", "in_text", "result", "unit"]),
    "line_class": _examples(LINE_FORMS, ["nil", "nil_in_text", "header", "unit_only", "flag"]), "date_forms": _examples(DATE_FORMS, ["shown", "title_time"]), "meta_fields": _sql_meta(), "json_ai_rows": _sql_answers(),
    "warning_dedup": "SELECT o_orderkey, 'low quality|' || o_orderstatus || '|' || o_orderpriority AS warnings FROM orders",
    "page_fields": """WITH l AS (SELECT l_orderkey AS document, l_linenumber AS page, max(l_returnflag) AS f, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)
      SELECT document, arg_min(f || p, page) FILTER (p % 3 = 1) AS name, arg_min(p::VARCHAR, page) FILTER (p % 2 = 0) AS sex FROM l GROUP BY 1""",
    "distinct_answers": """SELECT l_orderkey AS document, l_linenumber AS page, l_partkey * 1000 + l_suppkey AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE lower(l_returnflag) END AS raw_test_name, l_linestatus AS value
      FROM lineitem WHERE l_linestatus <> 'F' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey * 1000 + l_suppkey) = 1""",
    "file_labels": """WITH f AS (SELECT *, ['a/b.PDF', 'scan.jpeg', 'note', 'x.tar.png', '', 'c\\d.tiff'][(o_orderkey % 6 + 1)] AS name, trunc(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 0.001::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 100::DOUBLE END)::BIGINT AS size FROM orders)
      SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 3 THEN 'image/png' WHEN 5 THEN 'image/tiff' ELSE 'application/octet-stream' END AS content_type,
      o_orderkey || '_' || CASE o_orderkey % 6 WHEN 0 THEN 'a_b.PDF' WHEN 4 THEN 'uploaded_document' WHEN 5 THEN 'c_d.tiff' ELSE name END AS stored_name, CASE o_orderkey % 6 WHEN 0 THEN 'PDF' WHEN 2 THEN 'FILE' WHEN 4 THEN 'FILE' ELSE 'IMG' END AS badge,
      CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN round(size / 1024.0::DOUBLE)::BIGINT || ' KB' ELSE printf('%.1f MB', size / 1048576.0::DOUBLE) END AS size FROM f""",
    "text_compact": """WITH m AS (SELECT doc_id, coalesce(text, '') AS t, unnest(['the', 'plt', 'que']) AS w, unnest([0, 1, 2]) AS i FROM documents), c AS (SELECT doc_id, t, i, strpos(lower(t), w) AS p FROM m),
      j AS (SELECT doc_id, any_value(t) AS t, string_agg(substr(t, greatest(p - 1200, 1), p + 14000 - greatest(p - 1200, 1)), chr(10) || chr(10) ORDER BY i) FILTER (p > 0) AS joined FROM c GROUP BY 1)
      SELECT doc_id, md5(left(coalesce(joined, t), 24000)) AS digest FROM j""",
    "text_blocks": """WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(regexp_replace(x, '[ \\t\\f\\x0B\\x{A0}\\x{FEFF}]+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents)
      SELECT doc_id, CASE WHEN text IS NULL THEN -1 ELSE greatest(len(b), 1) END::INT AS n_block_lines, len(list_filter(b, lambda x: trim(replace(replace(x, '|', ' '), 'Â', '')) <> ''))::INT AS n_lines,
      length(nullif(regexp_replace(regexp_replace(translate(text, '|−–—', ' ---'), '[\\s\\x{A0}\\x{FEFF}]+', ' ', 'g'), '^[ :;-]+|[ :;-]+$', '', 'g'), ''))::INT AS n_spaced FROM l""",
    "ui_flags": f"""WITH r AS (SELECT {_FLAGS}[(l_partkey % {len(FLAG_FORMS)} + 1)] AS flag, ['5', '--', 'nil', ' '][(l_suppkey % 4 + 1)] AS value, CASE WHEN l_linenumber % 2 = 0 THEN '1 - 2' END AS reference_range FROM lineitem),
      x AS (SELECT *, value <> '5' AS nil, lower(trim(coalesce(flag, ''))) AS w FROM r)
      SELECT value, flag, reference_range, NOT nil AND w IN ('high', 'low', 'abnormal', 'critical', 'borderline') AS abnormal, coalesce(flag, '') <> '' AND lower(flag) <> 'normal' AS differs, coalesce(flag, '') <> '' AND flag <> 'Normal' AS differs_exactly,
      CASE WHEN nil THEN 'nil' WHEN w = '' THEN 'none' WHEN w = 'normal' THEN 'normal' WHEN w IN ('high', 'low', 'abnormal', 'critical', 'borderline') THEN 'abnormal' ELSE 'other' END AS style, CASE WHEN nil THEN 'nil' ELSE value END AS shown,
      CASE WHEN NOT nil AND reference_range IS NOT NULL THEN flag END AS saved, count(*) AS n FROM x GROUP BY ALL""",
    "report_assembly": """WITH l AS (SELECT l_orderkey AS document, l_linenumber AS n, 'w' || min(l_partkey) AS w FROM lineitem GROUP BY 1, 2),
      t AS (SELECT document, string_agg(w, chr(10) ORDER BY n DESC) AS lines, string_agg(w, ' ' ORDER BY n DESC) AS tokens, string_agg(w || ' | x', chr(10) ORDER BY n) AS rows, count(*) AS k FROM l GROUP BY 1)
      SELECT document, concat_ws(chr(10), CASE WHEN document % 2 = 0 THEN '--- PLAIN TEXT ---' || chr(10) || 'plain' END, '--- LINES ---' || chr(10) || lines, '--- TABLE page=1 table=1 ---' || chr(10) || rows, '--- TOKENS ---' || chr(10) || tokens) AS text,
      format('{} structured lab rows from 1 tables, {} lines, and {} tokens.', k, k, k) AS found, 1 AS n_token_lines FROM t""",
    "page_dates": """WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%-d.%-m.%y') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d %b %Y') ELSE 'soon' END AS t FROM orders),
      a AS (SELECT *, (2002 - year(d)) * 12 + 6 - month(d) - (15 < day(d))::INT AS m, CASE WHEN k % 5 = 0 AND year(d) < 2000 THEN d + INTERVAL 100 YEAR ELSE d END AS read_as FROM o)
      SELECT k AS o_orderkey, CASE WHEN k % 5 = 4 THEN 0 ELSE epoch(read_as)::BIGINT END AS page_time, CASE WHEN k % 5 = 2 THEN epoch(d)::BIGINT ELSE 0 END AS iso_key, CASE WHEN k % 3 > 0 THEN concat_ws('-', year(d), month(d), day(d)) ELSE 'unknown' END AS date_key,
      CASE k % 4 WHEN 0 THEN 'Collected ' || t WHEN 1 THEN 'Test date ' || t WHEN 2 THEN 'Reported ' || t ELSE 'No date' END AS label,
      CASE WHEN m < 0 THEN '' WHEN m = 0 THEN '0 months' ELSE concat_ws(', ', CASE WHEN m >= 12 THEN (m // 12) || ' year' || CASE WHEN m // 12 = 1 THEN '' ELSE 's' END END, CASE WHEN m % 12 > 0 THEN (m % 12) || ' month' || CASE WHEN m % 12 = 1 THEN '' ELSE 's' END END) END AS age FROM a""",
    "name_orders": """WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem), n AS (SELECT k, CASE WHEN k % 7 = 3 THEN 'rdw sd' WHEN k % 3 > 1 THEN 'r' || k % 10 END AS r, CASE WHEN k % 4 > 1 THEN 'C' || k % 10 END AS c, CASE WHEN k % 5 > 1 THEN 'd' || k % 10 END AS d FROM l)
      SELECT k, coalesce(d, r, c) AS worklist, coalesce(c, d, r) AS trend_key, coalesce(d, c, r) AS page, CASE WHEN k % 7 = 3 THEN 'cbc:rdw-sd' ELSE lower(coalesce(r, c, d, '')) END AS identity,
      CASE WHEN k % 7 = 3 THEN 'rdw-sd' ELSE replace(lower(coalesce(r, c, d, '')), '0', 'o') END AS merge_key FROM n""",
    "answer_texts": """WITH q AS (SELECT DISTINCT l_quantity::INT::VARCHAR AS q FROM lineitem), x AS (SELECT unnest([
        {r: '{"output_text": "a' || q || '"}', t: 'a' || q}, {r: '{"output": [{"content": [{"type": "text", "text": "b' || q || '"}, {"type": "image", "text": "no"}, {"type": "output_text", "text": "c"}]}, {"content": null}]}', t: 'b' || q || chr(10) || 'c'},
        {r: '{"other": "' || q || '"}', t: ''}, {r: 'no json ' || q, t: ''}]) AS x FROM q) SELECT x.r AS response, x.t AS text FROM x""",
    "ui_texts": """SELECT o_orderkey, ['AM', 'D', ''][(o_orderkey % 3 + 1)] AS initials, ['Mark Reviewed Late', '', 'Edited'][(o_orderkey % 3 + 1)] AS action, ['mark_reviewed_late', '—', 'edited'][(o_orderkey % 3 + 1)] AS shown,
      CASE WHEN o_orderkey % 2 = 0 THEN 'R' WHEN o_orderkey % 3 = 0 THEN 'f.pdf' ELSE 'Document ' || o_orderkey END AS title, CASE WHEN o_orderkey % 6 = 0 THEN 'A · B' WHEN o_orderkey % 2 = 0 THEN 'A' WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'Unknown' END AS uploader, 'Lab Notes' AS section FROM orders""",
}
