"""JSON answers of extraction services: finding the object in a text, and its rows in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinframe.functions import texts

#: What an answer writes where there is no result, and the confidence it has if it says none.
NIL = ["nil", "null", "none", "n/a", "na", "-", "--", "---", "—", ""]
CONFIDENCE = 0.86
LAB = "raw_test_name string, test string, name string, test_name string, display_name string, canonical_name string, category string, value string, result string, unit string, reference_range string, range string, flag string, confidence string"
PATIENT = "full_name string, name string, date_of_birth string, age string, sex string, cnp string, patient_identifier string, patient_id string"
REPORT = (
    "lab_name string, sample_type string, referring_doctor string, doctor string, report_name string, title string, report_type string, source_language string, test_date string, collected_on string, "
    "reported_on string, validated_on string, registered_on string, generated_on string, released_on string"
)
ANSWER = f"patient struct<{PATIENT.replace(' ', ':').replace(',:', ',')}>, report struct<{REPORT.replace(' ', ':').replace(',:', ',')}>, labs array<struct<{LAB.replace(' ', ':').replace(',:', ',')}>>"
PARTS = "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>"


def is_object(text: Column) -> Column:
    """Is text one JSON object?"""
    return F.coalesce(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.lit(False))


def object_in(text: Column) -> Column:
    """The JSON object that text is, or else its widest part from { to }; null for none. Code fences are dropped."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "(?i)^```(json)?", ""), "```$", ""))
    widest = lambda t: F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    return texts.let(bare, lambda t: F.when(is_object(t), t).otherwise(texts.let(widest(t), lambda w: F.when(is_object(w), w))))


def answer_text(response: Column) -> Column:
    """A response's own text, or its text parts, one a line."""
    r = F.from_json(response, PARTS)
    items = F.flatten(F.transform(F.coalesce(r["output"], F.array().cast("array<struct<content:array<struct<type:string,text:string>>>>")), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    kept = F.filter(items, lambda c: c["type"].isin("output_text", "text") & c["text"].isNotNull())
    return F.coalesce(r["output_text"], F.trim(F.array_join(F.transform(kept, lambda c: c["text"]), "\n")))


def _filled(*columns: Column) -> Column:
    return texts.first_filled(*columns)


def _clean(*columns: Column) -> Column:
    return F.nullif(F.trim(_filled(*columns)), F.lit(""))


def lab_row(lab: Column) -> Column:
    """One row of an answer: nil words are no value, a flag needs a value, Normal needs a range."""
    name = _filled(lab["raw_test_name"], lab["test"], lab["name"], lab["display_name"])
    value = F.replace(F.trim(lab["value"]), F.lit(","), F.lit("."))
    value = F.when(~F.lower(value).isin(*NIL), value)
    range_ = F.nullif(F.trim(F.translate(lab["reference_range"], "–—", "--")), F.lit(""))
    word = F.lower(F.trim(lab["flag"]))
    flag = F.when(word.isin("high", "h", "crescut", "mare"), "High").when(word.isin("low", "l", "scazut", "scăzut", "mic"), "Low").when((word == "normal") & range_.isNotNull(), "Normal")
    given = F.when(lab["confidence"].rlike(r"^[0-9]*\.?[0-9]+$"), lab["confidence"].try_cast("double"))
    return F.struct(
        name.alias("raw_test_name"), F.coalesce(_filled(lab["canonical_name"]), name).alias("canonical_name"), F.coalesce(_filled(lab["display_name"], lab["test"]), name).alias("display_name"),
        F.coalesce(_filled(lab["category"]), F.lit("Hematologie")).alias("category"), value.alias("value"), F.when(value.isNotNull(), flag).alias("flag"), range_.alias("reference_range"),
        F.nullif(F.trim(lab["unit"]), F.lit("")).alias("unit"), F.coalesce(F.nullif(given, F.lit(0.0)), F.lit(CONFIDENCE)).alias("confidence"),
    )


def page_rows(labs: Column) -> Column:
    """The rows of a page's answer that have a name and a value; a missing flag is Normal."""
    row = lambda lab: F.struct(
        _clean(lab["raw_test_name"], lab["test_name"], lab["name"]).alias("raw_test_name"), _clean(lab["value"], lab["result"]).alias("value"), F.coalesce(_clean(lab["unit"]), F.lit("")).alias("unit"),
        F.coalesce(_clean(lab["reference_range"], lab["range"]), F.lit("")).alias("reference_range"), F.coalesce(_clean(lab["flag"]), F.lit("Normal")).alias("flag"),
    )
    return F.filter(F.transform(labs, row), lambda r: r["raw_test_name"].isNotNull() & r["value"].isNotNull())


def page_fields(answer: Column) -> dict[str, Column]:
    """Header fields of a page's answer (patient, report)."""
    p, r = answer["patient"], answer["report"]
    return {
        "patient_name": _clean(p["full_name"], p["name"]), "date_of_birth": _clean(p["date_of_birth"]), "age": _clean(p["age"]), "sex": _clean(p["sex"]), "cnp": _clean(p["cnp"]),
        "patient_identifier": _clean(p["patient_identifier"], p["patient_id"]), "lab_name": _clean(r["lab_name"]), "sample_type": _clean(r["sample_type"]), "referring_doctor": _clean(r["referring_doctor"], r["doctor"]),
        "report_name": _clean(r["report_name"], r["title"]), "report_type": _clean(r["report_type"]), "source_language": F.coalesce(_clean(r["source_language"]), F.lit("unknown")),
        "test_date": _clean(r["test_date"], r["collected_on"]), "collected_on": _clean(r["collected_on"]), "reported_on": _clean(r["reported_on"], r["validated_on"]), "registered_on": _clean(r["registered_on"]),
        "generated_on": _clean(r["generated_on"], r["released_on"]),
    }
