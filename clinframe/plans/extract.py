"""Extraction, catalogue and stream queries over reports made from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinframe.functions import keys
from clinframe.operators import catalog, extraction, parsers
from clinframe.sources.bindings import patients, read
from clinframe.streaming import jobs

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_KEYS = keys.CBC_ORDER


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, n, code, result, reference, unit): each order is a report, each of its lines a test."""
    l = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    code = F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (F.col("l_partkey") % len(_KEYS) + 1).cast("int"))
    q = F.col("l_quantity").cast("int")
    return l.select(
        F.col("l_orderkey").alias("document"), (F.row_number().over(w) - 1).alias("n"), code.alias("code"), q.cast("string").alias("result"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(" - "), (F.col("l_suppkey") % 40 + 5).cast("string")).alias("reference"), F.when(F.col("l_linenumber") % 2 == 0, "g/dL").otherwise("fL").alias("unit"),
    )


_SQL_ITEMS = f"""items AS (SELECT l_orderkey AS document, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1)::INT AS n, {_KEYS}[(l_partkey % {len(_KEYS)} + 1)] AS code,
  l_quantity::INT::VARCHAR AS result, l_linenumber || ' - ' || (l_suppkey % 40 + 5) AS reference, l_linenumber::INT AS lo, (l_suppkey % 40 + 5)::INT AS hi, CASE WHEN l_linenumber % 2 = 0 THEN 'g/dL' ELSE 'fL' END AS unit FROM lineitem)"""
_FLAG = "CASE WHEN result::INT < least(lo, hi) THEN 'Low' WHEN result::INT > greatest(lo, hi) THEN 'High' ELSE 'Normal' END"
_RANGE = "least(lo, hi) || ' - ' || greatest(lo, hi)"


#: Cells of a table in the order of its first turn, and their headings.
_HEADS = ["Denumire analiza", "Rezultat", "Interval", "UM"]
_SPELLED = "CASE n % 3 WHEN 0 THEN code WHEN 1 THEN lower(code) || ':' ELSE 'Test ' || code END"
_NIL, _SHORT = "n % 5 = 4", "n % 6 = 5"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a heading, whose columns are turned round by the document's number. Some results are nil, some rows lack their last cell."""
    it = _items(spark, sf_dir).select("document", (F.col("n") + 1).alias("row_no"), F.expr(_SPELLED).alias("code"), F.expr(f"IF({_NIL}, 'nil', result)").alias("result"), "reference", "unit", F.expr(_SHORT).alias("short"))
    heads = it.select("document").distinct().select("document", F.lit(0).alias("row_no"), *[F.lit(h).alias(c) for h, c in zip(_HEADS, ("code", "result", "reference", "unit"))], F.lit(False).alias("short"))
    cells = F.array(*[F.struct(F.pmod(F.col("document") + i, F.lit(4)).cast("int").alias("cell_no"), F.col(c).alias("text")) for i, c in enumerate(("code", "result", "reference", "unit"))])
    return it.unionByName(heads).select("document", F.lit(0).alias("table_no"), "row_no", "short", F.explode(cells).alias("c")).where("NOT (short AND c.cell_no = 3)").select("document", "table_no", "row_no", "c.cell_no", "c.text")


def table_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.column_roles(_cells(spark, sf_dir)).select("document", "test", "result", "reference", "unit", "flag")


def table_lab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.table_rows(_cells(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of reports in three orders, by document: code, note, result, fillers, range; range, code, result; code, footer, nil, range."""
    it = _items(spark, sf_dir)
    filler = F.array_repeat(F.lit("see note"), (F.col("n") % 3) * 3)
    orders = [F.concat(F.array("code", F.lit("see note"), "result"), filler, F.array("reference")), F.array("reference", "code", "result"), F.array("code", F.lit("Telefon 021"), F.lit("--"), "reference")]
    spaced = F.element_at(F.array(*orders), F.pmod("document", F.lit(3)).cast("int") + 1)
    return it.select("document", "n", F.posexplode(spaced).alias("k", "text")).select("document", (F.col("n") * 100 + F.col("k")).alias("line_no"), "text")


def lines_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.lines_nearby(_lines(spark, sf_dir))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of tables with a heading, a little uneven."""
    it = _items(spark, sf_dir).withColumn("top", F.col("n") * 20.0 + 20).withColumn("code", F.expr(_SPELLED))
    heads = it.select("document").distinct().select("document", F.lit(0.0).alias("top"), *[F.lit(h).alias(c) for h, c in zip(_HEADS, ("code", "result", "reference", "unit"))])
    boxes = F.array(*[F.struct((F.lit(200.0 * i) + F.pmod(F.col("document") + F.col("top").cast("int") + i, F.lit(9)) * 10).alias("left"), (F.col("top") + i).alias("top"), F.col(c).alias("text")) for i, c in enumerate(("code", "result", "reference", "unit"))])
    tokens = it.select("document", "top", "code", "result", "reference", "unit").unionByName(heads).select("document", F.explode(boxes).alias("b"))
    return parsers.token_rows(tokens.select("document", F.lit(0).alias("page"), "b.left", "b.top", F.lit(30.0).alias("width"), F.lit(10.0).alias("height"), "b.text"))


def pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _items(spark, sf_dir).select("document", F.col("n").alias("line_no"), F.expr(f"concat_ws(' | ', {_SPELLED}, IF({_NIL}, '---', IF(n % 2 = 0, result, concat(result, ' ↑'))), IF({_SHORT}, NULL, reference))").alias("text"))
    heads = lines.select("document", F.lit(-1).alias("line_no"), F.lit("Analiza | Rezultat | Interval").alias("text")).distinct()
    return parsers.pipe_rows(lines.unionByName(heads))


def flat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running texts of the first codes, which hold neither # nor %."""
    it = _items(spark, sf_dir).withColumn("code", F.element_at(F.array(*[F.lit(k) for k in _KEYS[:14]]), (F.col("n") * 5 + F.col("document")).cast("int") % 14 + 1))
    piece = F.expr(f"concat_ws(' ', code, IF({_NIL}, '--', result), IF({_SHORT}, NULL, reference), IF(document % 2 = 0, 'g/dL', 'fL'))")
    docs = it.select("document", "n", piece.alias("piece")).groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "\n").alias("text"))
    return parsers.flat_scan(docs)


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parsers' rows of each report: plain text without ranges, lines with some values, tables with some ranges."""
    it = _items(spark, sf_dir)
    row = lambda value, range_, unit, confidence: it.select("document", (F.col("n") + 1).alias("seq"), F.col("code").alias("key"), F.expr(value).alias("value"), F.expr(range_).alias("reference_range"), F.expr(unit).alias("unit"), F.expr("IF(n % 2 = 0, 'High', NULL)").alias("flag"), F.lit(confidence).alias("confidence"))
    return parsers.merge_candidates([row("result", "CAST(NULL AS STRING)", "unit", 0.7), row("IF(n % 3 = 0, NULL, concat(result, '1'))", "'1 - 2'", "CAST(NULL AS STRING)", 0.935), row("IF(n % 2 = 0, NULL, concat(result, '2'))", "IF(n % 4 < 2, NULL, '3 - 4')", "'g/dL'", 0.995)])


def merge_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the parsers and rows of a second extraction: the better ones of each test, the second's at equal weight."""
    it = _items(spark, sf_dir)
    row = lambda value, range_, flag, category: it.select("document", F.col("n").alias("seq"), F.expr("IF(n % 4 = 0, concat('Test ', l), code)").alias("key"), F.expr(value).alias("value"), F.expr(range_).alias("reference_range"), "unit", F.expr(flag).alias("flag"), F.lit(category).alias("category"), F.lit(0.9).alias("confidence"))
    it = it.withColumn("l", F.col("n").cast("string"))
    return extraction.merge_stored([row("result", "IF(n % 2 = 0, reference, NULL)", "'N'", "Coagulare"), row("IF(n % 3 = 0, 'nil', concat(result, ',5'))", "IF(n % 2 = 0, reference, NULL)", "'crescut'", "")])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = _items(spark, sf_dir)
    score = F.when(F.col("n") % 3 == 0, 0.8).otherwise(1.0)
    return it.select("document", "code", "n", "result", score.alias("score"))


def merge_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.merge_best(_candidates(spark, sf_dir), ["document", "code"], F.col("score"), F.col("n"), "first")


def merge_last_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.merge_best(_candidates(spark, sf_dir), ["document", "code"], F.col("score"), F.col("n"), "last")


def needs_help_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges stand beside missing values too; four of a report's rows become one long one, so that some reports have enough rows; some have none."""
    it = _items(spark, sf_dir).where("document % 7 <> 3").withColumn("many", F.explode(F.expr("sequence(1, IF(document % 3 = 0, 8, 1))")))
    rows = it.select("document", F.expr("IF(document % 5 = 0, concat('Test ', n), code)").alias("key"), F.expr("IF(many % 3 = 0, NULL, result)").alias("value"), F.expr("IF((many + n) % 4 = 0, NULL, reference)").alias("reference_range"))
    documents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    gate = extraction.needs_help(documents, rows)
    return gate.select("document", "needs_help", "n_rows", "n_values", "n_references", extraction.range_warning(F.col("n_values"), F.col("n_references")).alias("warn"))


NAMES = [
    "Hemoglobina", "HGB", "colesterol", "LDL-colesterol seric", "TSH (ultrasensibil)", "T.S.H.", "Glicemie", "zzz", "proteina C reactivă", "uree serica", "", "ft4", "I N R", "trombocitele", "glucozat", "hormon", "creatin",
    "xalatx", "liber", "#", "colesterol total seric", "Uree_", "prothrombin", "fibrinogenul",
]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): of each part, a name of the list, or a term of the catalogue with something around it."""
    terms = [t for _, n, _, t in _TERMS]
    pool = [*NAMES, *terms, *[f"x{t}" for t in terms], *[f"{t} seric" for t in terms], *[t[:-1] for t in terms]]
    return read(spark, sf_dir, "part").select(F.element_at(F.array(*[F.lit(x) for x in pool]), (F.col("p_partkey") % len(pool) + 1).cast("int")).alias("name"))


_TERMS = [(i, n, c, t) for i, (n, c, syn) in enumerate(catalog.DEFINITIONS) for t in [n, *syn]]


def catalog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.match(_names(spark, sf_dir), catalog.default_catalogue(spark)).groupBy("name", "canonical_name", "category", "score").agg(F.count(F.lit(1)).alias("n"))


def synonym_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.name_by_synonyms(_names(spark, sf_dir), catalog.default_catalogue(spark))


CONTEXTS = [
    ("Hemograma completa", "Hematologie"), ("profil lipide si INR", "Coagulare"), ("subhormonii", "Endocrinologie"), ("profilhormoni", "Endocrinologie"), ("cultura urina", None), ("adnexa", "Biologie moleculara generala"), ("", None), ("Chimie clinică", "Biochimie generala"),
    ("psax crp", "Imunologie"), ("mycea", "Markeri tumorali"), ("D-DIMER", "Coagulare"), ("foo", None), ("hemoculturi", "Microbiologie"), ("rt pcr ft4", "Endocrinologie"),
]


def category_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of a test from its report's heading; rows on urine are left out, and names of the catalogue have their own."""
    heading = F.element_at(F.array(*[F.lit(c) for c, _ in CONTEXTS]), (F.col("p_partkey") % len(CONTEXTS) + 1).cast("int"))
    name = F.element_at(F.array(F.lit("Glucoza"), F.lit("Test nou"), F.lit("glucoza urinara"), F.lit(" ")), (F.col("p_size") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_partkey", name.alias("raw_name"), heading.alias("context"))
    return catalog.normalise_rows(rows, catalog.default_catalogue(spark)).select("p_partkey", "context", "canonical_name", "category")


def category_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per category of each report, categories in the order of reports; and the report's title by them."""
    names = F.array(*[F.lit(c) for c in [*reversed(catalog.CATEGORY_ORDER), "", "Zzz"]])
    rows = _items(spark, sf_dir).select("document", "n", "code", F.element_at(names, (F.col("document") + F.col("n") * 3).cast("int") % 11 + 1).alias("category"))
    groups = catalog.by_category(rows, "document", ["n"])
    return groups.select("document", "place", "category", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["n"].cast("string"), r["code"])), ",").alias("rows"))


def detected_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in [*reversed(catalog.CATEGORY_ORDER), "", "Zzz"]])
    rows = _items(spark, sf_dir).select("document", "n", F.element_at(names, (F.col("document") + F.col("n") * 3).cast("int") % 11 + 1).alias("category"))
    per = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("n", "category"))).alias("r"))
    return per.select("document", F.array_join(catalog.in_order(F.transform("r", lambda r: r["category"])), ",").alias("categories"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k long")
    return read(spark, sf_dir, "events").select("event_type", props["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("k").alias("n"))


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_upsert(jobs.read_events(spark, sf_dir), "job-state").select("user_id", "event_id", "state", "n_events")


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued, processing, done, error and stuck, as a stream with keyed state and timers gives them out."""
    return jobs.run_stateful(jobs.transitions(jobs.read_events(spark, sf_dir)), "transitions")


def audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log that verifying, editing and deleting leave, appended by batches."""
    return jobs.run_audit(jobs.read_events(spark, sf_dir), "audit").drop("batch")


def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has passed at the end of the stream; later ones are still open."""
    return jobs.run_append(jobs.tumbling(jobs.read_events(spark, sf_dir)), "tumbling")


def ext_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_append(jobs.sliding(jobs.read_events(spark, sf_dir)), "sliding")


def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_append(jobs.sessions(jobs.read_events(spark, sf_dir)), "session")


def ext_stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = jobs.with_names(jobs.read_events(spark, sf_dir), patients(spark, sf_dir))
    return jobs.run_append(named.select("event_id", "user_id", "full_name"), "named")


def ext_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some are broken on the way, counted by reason; well-formed ones too."""
    k = F.col("event_id")
    broken = jobs.read_events(spark, sf_dir).withColumns({"event_type": F.when(k % 11 == 0, "??").otherwise(F.col("event_type")), "user_id": F.when(k % 13 == 0, None).otherwise(F.col("user_id"))})
    bad = jobs.run_append(jobs.quarantined(broken).select("event_id", "reason"), "quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    good = jobs.run_append(jobs.valid(broken).select("event_id"), "valid").groupBy().agg(F.count(F.lit(1)).alias("n"))
    return bad.unionByName(good.select(F.lit("valid").alias("reason"), "n"))


def job_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = jobs.run_upsert(jobs.read_events(spark, sf_dir), "latest")
    return jobs.stuck(states, F.to_timestamp(F.lit("2024-06-01 00:00:00"))).select("user_id", "event_id", "state")


def job_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = jobs.read_events(spark, sf_dir)
    return jobs.run_append(jobs.first_completions(twice.select("event_id", "ts", "user_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("sent"))).select("event_id", "user_id"), "completions")


_NORMAL = "trim(regexp_replace(regexp_replace(translate(lower(strip_accents({})), '_:', '  '), '[^a-z0-9%+#./ -]', ' ', 'g'), ' +', ' ', 'g'))"
_COMPACT = "regexp_replace({}, '[^a-z0-9%#]', '', 'g')"
#: RE2 has no lookaround; a boolean test does without.
_WORD = "regexp_matches({}, '(^|[^a-z0-9])' || regexp_replace({}, '([.+/#%-])', '\\\\\\1', 'g') || '([^a-z0-9]|$)')"
_SQL_CATALOG = "cat AS (SELECT ord, canonical_name, category, " + _NORMAL.format("term") + " AS t FROM (VALUES " + ", ".join(f"({i}, '{n}', '{c}', '{t}')" for i, n, c, t in _TERMS) + ") v(ord, canonical_name, category, term))"


def _sql_names() -> str:
    terms = [t for _, _, _, t in _TERMS]
    pool = [*NAMES, *terms, *[f"x{t}" for t in terms], *[f"{t} seric" for t in terms], *[t[:-1] for t in terms]]
    return f"names AS (SELECT {pool}[(p_partkey % {len(pool)} + 1)] AS name FROM part)"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_UNIT_CASE = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in keys.CBC_UNITS.items()) + " END"
_NO_RANGE = "code IN ('NRBC#', 'NRBC%', 'IG#', 'IG%')"
_PLACE = "coalesce(nullif(list_position(" + _sql_list(_KEYS) + ", {}), 0), 999)"
_SEQ = "row_number() OVER (PARTITION BY document ORDER BY n)::INT AS seq"
_FLAGGED = "CASE WHEN value IS NULL OR lo IS NULL THEN NULL WHEN value::DOUBLE < least(lo, hi) THEN 'Low' WHEN value::DOUBLE > greatest(lo, hi) THEN 'High' ELSE 'Normal' END AS flag"
_RANGED = "CASE WHEN lo IS NOT NULL THEN least(lo, hi) || ' - ' || greatest(lo, hi) END AS reference_range"


QUERIES = {f.__name__: f for f in (table_roles, table_lab_rows, lines_nearby, token_rows, pipe_rows, flat_scan, merge_candidates, merge_stored, merge_first_tie, merge_last_tie, needs_help_gate, catalog_match, synonym_names, category_infer, category_group, detected_categories, json_props, job_latest_state, job_transitions, audit_sink, ext_tumbling, ext_sliding, ext_session, ext_stream_static, ext_quarantine, job_stuck, job_completions)}
_MERGE = "WITH {items}, c AS (SELECT document, code, n, result, CASE WHEN n % 3 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS score FROM items) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document, code ORDER BY score DESC, n {tie}) = 1"
ORACLE = {
    "table_roles": f"WITH {_SQL_ITEMS} SELECT DISTINCT document, (document % 4)::INT AS test, ((document + 1) % 4)::INT AS result, ((document + 2) % 4)::INT AS reference, ((document + 3) % 4)::INT AS unit, NULL::INT AS flag FROM items",
    # gone: which of code, result, reference, unit stands in the last column, and is missing in short rows.
    "table_lab_rows": f"""WITH {_SQL_ITEMS}, r AS (SELECT document, n, code AS key, CASE WHEN {_SHORT} THEN (3 - document % 4) END AS gone, result, lo, hi, unit, code FROM items),
      x AS (SELECT document, n, key, CASE WHEN NOT ({_NIL}) AND gone IS DISTINCT FROM 1 THEN result END AS value, CASE WHEN gone IS DISTINCT FROM 2 AND NOT {_NO_RANGE} THEN lo END AS lo, hi,
        CASE WHEN gone = 3 THEN {_UNIT_CASE.format('key')} ELSE unit END AS unit FROM r WHERE gone IS DISTINCT FROM 0)
      SELECT document, {_SEQ}, key, value, {_RANGED}, unit, {_FLAGGED}, 0.995::DOUBLE AS confidence FROM x""",
    # A range right before a key line is nearer than any behind it: that of the test before, unless ranges come first.
    "lines_nearby": f"""WITH {_SQL_ITEMS}, p AS (SELECT *, lag(lo) OVER w AS plo, lag(hi) OVER w AS phi FROM items WINDOW w AS (PARTITION BY document ORDER BY n)),
      c AS (SELECT document, n, code, CASE WHEN document % 3 <> 2 THEN result END AS value, CASE WHEN document % 3 = 1 THEN lo WHEN n > 0 THEN plo WHEN document % 3 = 2 OR n % 3 = 0 THEN lo END AS lo,
        CASE WHEN document % 3 = 1 THEN hi WHEN n > 0 THEN phi ELSE hi END AS hi FROM p),
      x AS (SELECT document, n, code AS key, value, CASE WHEN NOT {_NO_RANGE} THEN lo END AS lo, hi FROM c)
      SELECT document, {_SEQ}, key, value, {_RANGED}, {_UNIT_CASE.format('key')} AS unit, {_FLAGGED}, 0.935::DOUBLE AS confidence FROM x""",
    "token_rows": f"""WITH {_SQL_ITEMS}, x AS (SELECT document, n, code AS key, result AS value, CASE WHEN NOT {_NO_RANGE} THEN lo END AS lo, hi, unit FROM items)
      SELECT document, {_SEQ}, key, value, {_RANGED}, unit, {_FLAGGED}, 0.965::DOUBLE AS confidence FROM x""",
    "pipe_rows": f"""WITH {_SQL_ITEMS}, f AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY document, code ORDER BY n) = 1),
      x AS (SELECT document, n, code AS key, CASE WHEN NOT ({_NIL}) THEN result END AS value, CASE WHEN NOT ({_SHORT}) THEN lo END AS lo, hi FROM f)
      SELECT document, {_SEQ}, key, value, {_RANGED}, {_UNIT_CASE.format('key')} AS unit, CASE WHEN value IS NOT NULL AND lo IS NOT NULL AND n % 2 = 1 THEN 'High' ELSE {_FLAGGED.removesuffix(' AS flag')} END AS flag,
      CASE WHEN value IS NULL THEN 0.98 WHEN lo IS NOT NULL THEN 0.96 ELSE 0.82 END::DOUBLE AS confidence FROM x""",
    # A code that comes again is no end of its first place, so its later range counts if no other code lies between; codes of a text follow each other in steps of 5 of 14.
    "flat_scan": f"""WITH {_SQL_ITEMS}, c AS (SELECT document, n, {_sql_list(_KEYS[:14])}[((n * 5 + document) % 14 + 1)] AS key, result, lo, hi FROM items),
      f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document, key ORDER BY n) = 1),
      x AS (SELECT document, n, key, CASE WHEN NOT ({_NIL}) THEN result END AS value, CASE WHEN NOT ({_SHORT}) THEN lo END AS lo, hi FROM f)
      SELECT document, row_number() OVER (PARTITION BY document ORDER BY {_PLACE.format('key')})::INT AS seq, key, value, {_RANGED}, CASE WHEN document % 2 = 0 THEN 'g/dL' ELSE 'fL' END AS unit, {_FLAGGED},
      CASE WHEN value IS NULL THEN 0.78 WHEN lo IS NOT NULL THEN 0.72 ELSE 0.55 END::DOUBLE AS confidence FROM x""",
    "merge_candidates": f"""WITH {_SQL_ITEMS}, g AS (
        SELECT 0 AS g, *, result AS value, NULL AS range0, unit AS u, 0.7::DOUBLE AS confidence FROM items UNION ALL
        SELECT 1, *, CASE WHEN n % 3 = 0 THEN NULL ELSE result || '1' END, '1 - 2', NULL, 0.935::DOUBLE FROM items UNION ALL
        SELECT 2, *, CASE WHEN n % 2 = 0 THEN NULL ELSE result || '2' END, CASE WHEN n % 4 < 2 THEN NULL ELSE '3 - 4' END, 'g/dL', 0.995::DOUBLE FROM items),
      r AS (SELECT *, CASE WHEN NOT {_NO_RANGE} THEN range0 END AS range1, coalesce(u, CASE WHEN {_NO_RANGE} THEN {_UNIT_CASE.format('code')} END) AS unit1, {_UNIT_CASE.format('code')} AS own FROM g),
      w AS (SELECT *, confidence + CASE WHEN value IS NULL THEN 0 ELSE 0.8 END + CASE WHEN range1 IS NULL THEN 0 ELSE 0.55 END + CASE WHEN unit1 IS NULL THEN 0 ELSE 0.2 END
        + CASE WHEN range1 IS NULL OR unit1 IS NULL OR own = unit1 THEN 0.25 ELSE -1 END AS weight FROM r),
      b AS (SELECT *, row_number() OVER (PARTITION BY document, code ORDER BY round(weight, 6) DESC, g, n) AS rn FROM w)
      SELECT document, row_number() OVER (PARTITION BY document ORDER BY {_PLACE.format('code')})::INT AS place, code AS key, value, range1 AS reference_range, unit1 AS unit,
      CASE WHEN range1 IS NOT NULL AND n % 2 = 0 THEN 'High' END AS flag, confidence FROM b WHERE rn = 1""",
    "merge_stored": f"""WITH {_SQL_ITEMS}, k AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'Test ' || n ELSE code END AS name, n % 4 <> 0 AS cbc, CASE WHEN n % 2 = 0 THEN {_RANGE} END AS range1 FROM items),
      g AS (SELECT 0 AS g, *, result AS value, CASE WHEN n % 2 = 0 THEN 'Normal' END AS flag, 'Coagulare' AS cat FROM k UNION ALL
        SELECT 1, *, CASE WHEN n % 3 = 0 THEN NULL ELSE result || '.5' END, CASE WHEN n % 3 = 0 THEN NULL ELSE 'High' END, 'Alte analize' FROM k),
      w AS (SELECT *, 0.9 + CASE WHEN value IS NULL THEN 0 ELSE 0.4 END + CASE WHEN range1 IS NULL THEN 0 ELSE 0.4 END + CASE WHEN flag = 'High' THEN 0.08 ELSE 0 END AS weight FROM g),
      b AS (SELECT *, row_number() OVER (PARTITION BY document, name ORDER BY weight DESC, g DESC, n DESC) AS rn, min(g * 100000 + n) OVER (PARTITION BY document, name) AS seen FROM w)
      SELECT document, row_number() OVER (PARTITION BY document ORDER BY CASE WHEN cbc THEN {_PLACE.format('name')} ELSE 999 END, seen)::INT AS place, name AS key, value, range1 AS reference_range, unit, flag,
      CASE WHEN cbc THEN 'Hematologie' ELSE cat END AS category, 0.9::DOUBLE AS confidence FROM b WHERE rn = 1""",
    "merge_first_tie": _MERGE.format(items=_SQL_ITEMS, tie="ASC"),
    "merge_last_tie": _MERGE.format(items=_SQL_ITEMS, tie="DESC"),
    "needs_help_gate": f"""WITH {_SQL_ITEMS}, m AS (SELECT *, unnest(range(1, CASE WHEN document % 3 = 0 THEN 9 ELSE 2 END)) AS many FROM items WHERE document % 7 <> 3),
      a AS (SELECT document, count(*) AS n_rows, count(*) FILTER (document % 5 <> 0) AS counts, count(*) FILTER (many % 3 <> 0) AS n_values, count(*) FILTER (many % 3 <> 0 AND (many + n) % 4 <> 0) AS n_references FROM m GROUP BY 1),
      d AS (SELECT o_orderkey AS document, coalesce(n_rows, 0) AS n_rows, coalesce(counts, 0) AS counts, coalesce(n_values, 0) AS n_values, coalesce(n_references, 0) AS n_references FROM orders LEFT JOIN a ON o_orderkey = a.document)
      SELECT document, n_rows = 0 OR (counts > 0 AND counts < 24) OR n_rows < 20 OR n_values = 0 OR n_references < greatest(5, floor(n_values * 0.65)) AS needs_help, n_rows, n_values, n_references,
      n_values > 0 AND n_references < greatest(3, floor(n_values * 0.6)) AS warn FROM d""",
    "catalog_match": f"""WITH {_sql_names()}, {_SQL_CATALOG}, d AS (SELECT DISTINCT name, {_NORMAL.format('name')} AS n FROM names),
      s AS (SELECT name, canonical_name, category, ord, CASE WHEN n = t THEN 100 WHEN {_COMPACT.format('n')} <> '' AND {_COMPACT.format('n')} = {_COMPACT.format('t')} THEN 98 WHEN length(t) >= 3 AND {_WORD.format('n', 't')} THEN 90
        WHEN length(t) >= 4 AND contains(n, t) THEN 75 WHEN length(n) >= 4 AND contains(t, n) THEN 65 END AS score FROM d, cat WHERE n <> ''),
      b AS (SELECT * FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, ord) = 1)
      SELECT names.name, canonical_name, category, score::INT AS score, count(*) AS n FROM names LEFT JOIN b ON names.name = b.name GROUP BY ALL""",
    "synonym_names": f"""WITH {_sql_names()}, {_SQL_CATALOG}, d AS (SELECT DISTINCT name, {_NORMAL.format('name')} AS n FROM names),
      b AS (SELECT name, canonical_name, category FROM d, cat WHERE {_WORD.format('n', 't')} QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1)
      SELECT d.name, coalesce(canonical_name, nullif(replace(n, ' ', '_'), ''), 'unknown_test') AS canonical_name, coalesce(canonical_name, nullif(trim(d.name), ''), 'Unknown Test') AS display_name, coalesce(category, 'other') AS category
      FROM d LEFT JOIN b ON d.name = b.name""",
    "category_infer": f"""WITH c AS (SELECT unnest({_sql_list([c for c, _ in CONTEXTS])}) AS context, unnest([{', '.join(f"'{x}'" if x else 'NULL' for _, x in CONTEXTS)}]) AS named, unnest(range({len(CONTEXTS)})) AS i)
      SELECT p_partkey, context, CASE WHEN p_size % 4 = 0 THEN 'Glucose' ELSE 'Test nou' END AS canonical_name, CASE WHEN p_size % 4 = 0 THEN 'Biochimie generala' ELSE coalesce(named, 'Alte analize') END AS category
      FROM part JOIN c ON p_partkey % {len(CONTEXTS)} = i WHERE p_size % 4 < 2""",
    "category_group": f"""WITH {_SQL_ITEMS}, r AS (SELECT document, n, code, coalesce(nullif({_sql_list([*reversed(catalog.CATEGORY_ORDER), '', 'Zzz'])}[((document + n * 3) % 11 + 1)], ''), 'Alte analize') AS category FROM items),
      g AS (SELECT document, category, string_agg(n || ':' || code, ',' ORDER BY n) AS rows, min(n) AS first FROM r GROUP BY 1, 2)
      SELECT document, row_number() OVER (PARTITION BY document ORDER BY coalesce(nullif(list_position({_sql_list(catalog.CATEGORY_ORDER)}, category), 0), 999), first)::INT AS place, category, rows FROM g""",
    "detected_categories": f"""WITH {_SQL_ITEMS}, r AS (SELECT document, n, coalesce(nullif({_sql_list([*reversed(catalog.CATEGORY_ORDER), '', 'Zzz'])}[((document + n * 3) % 11 + 1)], ''), 'Alte analize') AS category FROM items),
      g AS (SELECT document, category, min(n) AS first FROM r GROUP BY 1, 2)
      SELECT document, string_agg(category, ',' ORDER BY coalesce(nullif(list_position({_sql_list(catalog.CATEGORY_ORDER)}, category), 0), 999), first) AS categories FROM g GROUP BY 1""",
    "json_props": "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(props->>'k') AS n FROM events GROUP BY 1",
    "job_latest_state": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY 1",
    # Each user's events one after the other; the watermark of the end decides what has come out.
    "job_transitions": """WITH RECURSIVE w AS (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 10 minute AS now FROM events),
      e AS (SELECT user_id, event_id, date_trunc('millisecond', ts) AS ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS said,
        row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), event_id) AS i FROM events, w WHERE date_trunc('millisecond', ts) < now),
      j AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, ''::VARCHAR AS state, NULL::TIMESTAMP AS since, false AS moved, NULL::TIMESTAMP AS was_stuck FROM e
        UNION ALL SELECT user_id, e.i, e.event_id, CASE WHEN said = 'queued' OR j.state IN ('queued', 'processing', 'stuck') THEN said ELSE j.state END, CASE WHEN said = 'queued' OR j.state IN ('queued', 'processing', 'stuck') THEN ts ELSE since END,
          said = 'queued' OR j.state IN ('queued', 'processing', 'stuck'), CASE WHEN j.state IN ('queued', 'processing') AND since + INTERVAL 1 hour < ts THEN since + INTERVAL 1 hour END FROM j JOIN e USING (user_id) WHERE e.i = j.i + 1)
      SELECT user_id, event_id, state, since AS at FROM j WHERE moved UNION ALL SELECT user_id, NULL, 'stuck', was_stuck FROM j WHERE was_stuck IS NOT NULL
      UNION ALL SELECT user_id, NULL, 'stuck', since + INTERVAL 1 hour FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1), w WHERE state IN ('queued', 'processing') AND since + INTERVAL 1 hour < now""",
    "audit_sink": "SELECT event_id AS document_id, user_id AS actor_id, CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'click' THEN 'edited' ELSE 'deleted' END AS action, ts AS at, props->>'k' AS detail FROM events WHERE event_type IN ('purchase', 'click', 'error')",
    "ext_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minute FROM events) GROUP BY 1, 2",
    "ext_sliding": """WITH e AS (SELECT *, unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS w FROM events)
      SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE w + INTERVAL 2 hour <= (SELECT max(ts) - INTERVAL 10 minute FROM events) GROUP BY 1, 2""",
    "ext_session": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minute THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 minute <= (SELECT max(ts) - INTERVAL 10 minute FROM events)""",
    "ext_stream_static": "SELECT event_id, user_id, c_name AS full_name FROM events LEFT JOIN customer ON c_custkey = user_id",
    "ext_quarantine": "SELECT CASE WHEN event_id % 13 = 0 THEN 'no user' WHEN event_id % 11 = 0 THEN 'unknown type' ELSE 'valid' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "job_stuck": "SELECT * FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 1 hour) WHERE state IN ('click', 'view')",
    "job_completions": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'",
}
