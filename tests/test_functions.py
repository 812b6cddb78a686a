"""Small expected results of scalar functions, and the shape of plans."""

import pytest
from clinframe import registry
from clinframe.functions import cells, dates, flags, header, keys, numbers, payloads, texts
from clinframe.operators import catalog, dml, extraction, parsers
from clinframe.sources import files
from pyspark.sql import functions as F


def values(spark, expression, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("expression,cases", [
    (numbers.lab_value, {"5,2": 5.2, "<0.5": 0.5, "--": None, "1.2.3": 1.2, "12 mg": 12.0, "−3": -3.0, ".5": 5.0, "+7": 7.0, "positive": None, "5-10": 5.0, None: None}),
    (numbers.normalise_value, {"5,2": "5.2", "<0.5": "0.5", ".5": "0.5", "12 mg/dL": "12", "10^3": "103", "3-5": "3-5", "absent": None, "negativ": None, "---": None, None: None}),
    (numbers.normalise_range, {"3,98–10,00": "3.98 - 10.00", "10.00-3.98": "3.98 - 10.00", "<5": None, None: None}),
    (numbers.split_fused, {"3.936.08": "3.93 - 6.08", "34.151.0": "34.1 - 51.0", "11.217.5": "11.2 - 17.5", "35.146.3": "35.1 - 46.3", "0.040.54": "0.04 - 0.54", "3.98-10.00": None}),
    (numbers.normalise_unit, {"G/DL": "g/dL", "10^3 / uL": "10^3/uL", "ui/ml": "uIU/mL", "foo": "foo", " ": None}),
    (flags.normalise, {"H": "High", "crescut": "High", "↑": "High", "l": "Low", "scăzut": "Low", "▼": "Low", "n": "Normal", "Abnormal": None}),
    (keys.token_key, {"rdw sd": "RDW-SD", "Neut %": "NEUT%", "M0N0%": "MONO%", "EOS#": "EO#", "eos": "EO", "P-LCR%": "P-LCR", "wbc": "WBC", "foo": "FOO", "5": "5"}),
    (keys.normal_key, {"L C R": "P-LCR", "PLCR": "P-LCR", "BAS0 #": "BASO#", "rdw_cv": "RDW-CV", "10": "10"}),
    (keys.cbc_code, {"rdw cv": "RDW-CV", "neut#": "NEUT#", "NEUT abs #": None, "HB": None, "Plcr": "P-LCR", "": None}),
    (keys.detect_key, {"Hemoglobina HGB": "HGB", "Hemoglobina (HGB)": None, "RDW SD": "RDW-SD", "5.2": None, "": None}),
    (cells.clean_number, {"+5,2": "5.2", "7-8": "7", "x": None, "3": "3"}),
    (cells.reference_number, {"-5": "5", "5.1": "5.1", "": None}),
    (cells.explicit_flag, {"5 ↑": "High", "5 ▼": "Low", "a high b": "High", "highest": None, "mic": "Low"}),
    (lambda c: cells.clean_unit(c, F.lit("HGB")), {"G / DL": "g/dL", "10^3/ul": "10^3/uL", "x/y": "x/y", "foo": "g/dL", "": "g/dL"}),
    (lambda c: cells.is_urine(c, F.lit("")), {"Glucoza Urinară": True, "Nitriți": True, "Glucoza": False}),
    (files.mime_type, {"a.PDF": "application/pdf", "b.jpeg": "image/jpeg", "c": "application/octet-stream", "d.tar.webp": "image/webp"}),
    (texts.clean_string, {" a :;": "a", "": None, "3–5": "3-5", "Âµ â€x\ufffd": "µ x", "Â": None}),
    (texts.clean_spaces, {"- x | y:": "x y", " ": None}),
    (texts.clean_block, {"a  b\r\n\n c ": "a b\nc", "": ""}),
    (dates.iso_key, {"1970-01-02": 86400, "1970-01-01T00:00:05+00:00": 5, "02 Mar 2023": 0, "": 0}),
    (dates.page_time, {"2.1.70": 3155846400, "02 Jan 1970": 86400, "1970-01-01T00:01:00Z": 60, "x": 0, None: 0}),
    (dates.display, {"02.03.2023 08:41": "02 Mar 2023 08:41", "2 martie 2023": "02 Mar 2023", "2026-04-29T18:55:41.792880+00:00": None, "01.01.1800": None, "": None, "sometime in May": "sometime in May", "02 Mar, 2023": "02 Mar 2023", "3 sept 2021 7:05": "03 Sep 2021 07:05"}),
    (texts.preview, {"": None, "a": "a", "x" * 181: "x" * 180 + "..."}),
    (texts.initials, {"ana maria pop": "AM", " ": ""}),
    (texts.clean, {"﻿a  b|c": "a b c", "5 µmol−1": "5 umol-1"}),
])
def test_values(spark, expression, cases):
    assert values(spark, expression, list(cases)) == list(cases.values())


def test_flags(spark):
    df = spark.createDataFrame([(3.97,), (3.98,), (10.0,), (10.01,), (None,)], "v double")
    assert [r[0] for r in df.select(flags.infer(F.col("v"), F.lit(3.98), F.lit(10.0))).collect()] == ["Low", "Normal", "Normal", "High", None]


def test_flatten_and_reading_order(spark):
    nested = spark.createDataFrame([(1, [(1, [([("WBC",), ("5",)],), ([("HGB",), ("14",)],)])])], "document int, tables array<struct<page:int,rows:array<struct<cells:array<struct<text:string>>>>>>")
    flat = extraction.flatten_tables(nested)
    assert sorted((r.row_no, r.cell_no, r.text) for r in flat.collect()) == [(0, 0, "WBC"), (0, 1, "5"), (1, 0, "HGB"), (1, 1, "14")]
    rows = {r.key: (r.value, r.unit, r.flag) for r in parsers.table_rows(flat).collect()}
    assert rows == {"WBC": ("5", "10^3/uL", None), "HGB": ("14", "g/dL", None)}
    tokens = spark.createDataFrame([(1, 2, 0.0, 0.0, "c"), (1, 1, 5.0, 9.0, "b"), (1, 1, 5.0, 1.0, "a")], "document int, page int, top double, left double, text string")
    assert extraction.reading_order(tokens).first().text == "a b c"


def test_catalogue(spark):
    names = spark.createDataFrame([("hemoglobina",), ("T.S.H.",), ("colesterol",), ("zzz",), (None,)], "name string")
    got = {r.name: (r.canonical_name, r.score) for r in catalog.match(names, catalog.default_catalogue(spark)).collect()}
    assert got == {"hemoglobina": ("Hemoglobin", 100), "T.S.H.": ("TSH", 98), "colesterol": ("Total Cholesterol", 65), "zzz": (None, None), None: (None, None)}


def test_term_within_name_beats_name_within_term(spark):
    catalogue = spark.createDataFrame([(0, "A", "x", "total sodium serum"), (1, "B", "x", "sodiu")], "ord int, canonical_name string, category string, term string")
    assert catalog.match(spark.createDataFrame([("sodium",)], "name string"), catalogue).first()["canonical_name"] == "B"


def test_header_fields(spark):
    text = "Nume: POP ANA CNP: 2900101123456\nSex: F Varsta: 33 ani\nMedic: IONESCU DAN Sectie X\nCod numeric personal\nBULETIN ANALIZE MEDICALE\nData si ora recoltarii setului de analize: 02 Mar 2023 08:41 Data validare: 3.3.2023\nSynevo Bucuresti"
    df = spark.createDataFrame([(1, text), (2, None), (3, "numeric value of MEDICALE 5. Collected on: 05.04.2023")], "i int, x string")
    got = {r.i: r.m.asDict() for r in df.select("i", header.metadata(F.col("x")).alias("m")).collect()}
    known = {k: v for k, v in got[1].items() if v is not None}
    assert known == {
        "patient_name": "POP ANA", "age": "33 ani", "sex": "Female", "cnp": "2900101123456", "lab_name": "Synevo Bucuresti", "referring_doctor": "IONESCU DAN", "report_name": "Analize medicale 02 Mar 2023 08:41",
        "report_type": "Bloodwork", "source_language": "ro", "test_date": "02 Mar 2023 08:41", "collected_on": "02 Mar 2023 08:41", "reported_on": "03 Mar 2023",
    }
    assert {k: v for k, v in got[2].items() if v is not None} == {"report_name": "Analize medicale", "report_type": "Bloodwork", "source_language": "en"}
    assert (got[3]["patient_name"], got[3]["referring_doctor"], got[3]["collected_on"]) == (None, None, "05 Apr 2023")
    loose = df.where("i = 3").select(header.metadata(F.col("x"), compat=True).alias("m")).first().m
    assert loose.patient_name is not None and loose.referring_doctor is not None


def test_answers(spark):
    rows = [('```json\n{"labs": [{"test": "WBC", "value": "5,2", "flag": "h"}]}\n```',), ('so: {"labs": []} ok',), ("no object",), (None,), ("{broken",)]
    df = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in df.select(payloads.object_in(F.col("x"))).collect()] == ['{"labs": [{"test": "WBC", "value": "5,2", "flag": "h"}]}', '{"labs": []}', None, None, None]
    lab = df.select(payloads.lab_row(F.from_json(payloads.object_in(F.col("x")), payloads.ANSWER)["labs"][0]).alias("l")).first().l
    assert (lab.raw_test_name, lab.value, lab.flag, lab.category, lab.confidence) == ("WBC", "5.2", "High", "Hematologie", 0.86)
    said = spark.createDataFrame([('{"output_text": "a"}',), ('{"output": [{"content": [{"type": "text", "text": "b"}, {"type": "x", "text": "no"}, {"type": "output_text", "text": "c"}]}]}',)], "x string")
    assert [r[0] for r in said.select(payloads.answer_text(F.col("x"))).collect()] == ["a", "b\nc"]


def test_anchors_boxes_and_renderings(spark):
    df = spark.createDataFrame([("Hello world", [(None, 5), (6, 11), (3, 2)], [(0.1, 0.2), (0.5, 0.25)]), ("x", None, None)], "full string, seg array<struct<start:int,end:int>>, v array<struct<x:double,y:double>>")
    got = df.select(extraction.anchored(F.col("full"), F.col("seg")).alias("t"), extraction.box(F.col("v"), F.lit(100.0), F.lit(10.0)).alias("b")).collect()
    assert [(r.t, tuple(r.b)) for r in got] == [("Helloworld", (10.0, 2.0, 40.0, 1.0)), ("", (0.0, 0.0, 1.0, 1.0))]
    cells_ = spark.createDataFrame([(1, 0, 0, 0, 0, "a"), (1, 0, 0, 0, 1, None), (1, 0, 0, 1, 0, "c")], "document int, page int, table_no int, row_no int, cell_no int, text string")
    assert extraction.rendered_tables(cells_).first().text == "--- TABLE page=1 table=1 ---\na | \nc"


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    got = files.read_files(spark, str(tmp_path)).select("name", "size", "content_type", files.data_url(F.col("content"), F.col("name")).alias("u")).first()
    assert tuple(got) == ("a.pdf", 3, "application/pdf", "data:application/pdf;base64,YWJj")
    up = spark.createDataFrame([("bloodwork", "a/b.pdf", "1970-01-01 00:00:09"), ("nowhere", "c.pdf", "1970-01-01 00:00:09")], "section string, filename string, at string").withColumn("at", F.col("at").cast("timestamp"))
    files.land(up, str(tmp_path / "in"))
    assert [r.stored_name for r in spark.read.parquet(str(tmp_path / "in")).collect()] == ["9_a_b.pdf"]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "")], "id int, x string, y string")
    more = spark.createDataFrame([(2, "z", "z"), (3, "c", "c"), (3, "c", "c")], t.schema)
    assert sorted(r.id for r in dml.upsert_missing(t, more, ["id"]).collect()) == [1, 2, 3]
    assert sorted((r.id, r.y) for r in dml.fill_missing(t, more, "id", ["y"]).collect() if r.id == 2) == [(2, "z")]
    assert {r.id: r.x for r in dml.set_where(t, F.col("id") == 1, {"x": F.lit("new")}).collect()} == {1: "new", 2: "b"}
    assert dml.audit(t, "edited", "me", "2024").count() == 2


@pytest.mark.parametrize("name", ["trend_last5", "worklist_top3_abnormal", "worklist_counts", "timeline_union"])
def test_plans(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan
    if name in ("trend_last5", "worklist_top3_abnormal"):
        assert "WindowGroupLimit" in plan
