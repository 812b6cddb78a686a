"""Recognition of blood-count codes and of what a cell or line of a report is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinframe.functions import texts

#: Codes in report order, and the default unit of each.
CBC_UNITS = {
    "WBC": "10^3/uL", "RBC": "10^6/uL", "HGB": "g/dL", "HCT": "%", "MCV": "fL", "MCH": "pg", "MCHC": "g/dL", "PLT": "10^3/uL", "RDW-SD": "fL", "RDW-CV": "%",
    "PDW": "fL", "MPV": "fL", "P-LCR": "%", "PCT": "%", "NRBC#": "10^3/uL", "NRBC%": "%", "NEUT#": "10^3/uL", "NEUT%": "%", "LYMPH#": "10^3/uL", "LYMPH%": "%",
    "MONO#": "10^3/uL", "MONO%": "%", "EO#": "10^3/uL", "EO%": "%", "BASO#": "10^3/uL", "BASO%": "%", "IG#": "10^3/uL", "IG%": "%",
}
CBC_ORDER = list(CBC_UNITS)
#: What codes are called where that isn't the code itself.
CBC_LABELS = {
    "WBC": "White Blood Cell Count", "RBC": "Red Blood Cell Count", "HGB": "Hemoglobin", "HCT": "Hematocrit", "MCV": "Mean Corpuscular Volume", "MCH": "Mean Corpuscular Hemoglobin",
    "MCHC": "Mean Corpuscular Hemoglobin Concentration", "PLT": "Platelet Count", "RDW-SD": "Red Cell Distribution Width - SD", "RDW-CV": "Red Cell Distribution Width - CV", "PDW": "Platelet Distribution Width",
    "MPV": "Mean Platelet Volume", "PCT": "Plateletcrit", "NRBC#": "Nucleated Red Blood Cells Absolute", "NRBC%": "NRBC Percent", "NEUT#": "Neutrophils Absolute", "NEUT%": "Neutrophils Percent",
    "LYMPH#": "Lymphocytes Absolute", "LYMPH%": "Lymphocytes Percent", "MONO#": "Monocytes Absolute", "MONO%": "Monocytes Percent", "EO#": "Eosinophils Absolute", "EO%": "Eosinophils Percent",
    "BASO#": "Basophils Absolute", "BASO%": "Basophils Percent", "IG#": "Immature Granulocytes Absolute", "IG%": "Immature Granulocytes Percent",
}
#: Other spellings that name a test by themselves, and prefixes of the differential count.
ALIASES = [
    "HB", "RDW", "RDWSD", "RDWCV", "PLCR", "NRBC", "NEUT", "LYMPH", "MONO", "EO", "EOS#", "EOS", "EOS%", "BASO", "IG", "GLU", "GLUCOSE", "GLUCOZA", "GLICEMIE", "CREATININA",
    "CREATININE", "UREE", "UREA", "BUN", "ALT", "ALAT", "TGP", "AST", "ASAT", "TGO", "GGT", "TSH", "CRP", "HDL", "LDL",
]
PREFIXES = ["NRBC", "NEUT", "LYMPH", "MONO", "EO", "BASO", "IG"]
#: Codes that have no reference range.
NO_REFERENCE = ["NRBC#", "NRBC%", "IG#", "IG%"]
#: Units of spellings that aren't in report order.
MORE_UNITS = {"HB": "g/dL", "RDW": "%", "NRBC": "10^3/uL", "NEUT": "10^3/uL", "LYMPH": "10^3/uL", "MONO": "10^3/uL", "EO": "10^3/uL", "BASO": "10^3/uL", "IG": "10^3/uL"}
RANGE = r"[0-9]+(?:\.[0-9]+)? *- *[0-9]+(?:\.[0-9]+)?"


def _differential(t: Column) -> Column:
    """Prefix and sign of a differential count, whatever stands between or behind them."""
    prefix = F.regexp_extract(t, f"^({'|'.join(PREFIXES)})", 1)
    sign = F.when(t.contains("#"), "#").otherwise("%")
    return F.when(t.rlike("[#%]") & (prefix != ""), F.concat(prefix, sign)).when(t == "EOS", "EO").otherwise(t)


def _token_forms(parts: Column) -> Column:
    """A test token without blanks and points, its usual misreadings mended."""
    plain = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.translate(F.upper(x), "_", "-"), "[ .]", ""), "M0N[0O]|MON0", "MONO"))
    return F.transform(plain, lambda t: F.when(t == "RDWSD", "RDW-SD").when(t == "RDWCV", "RDW-CV").when(t.isin("PLCR", "P-LCR%"), "P-LCR").otherwise(_differential(t)))


def _cell_forms(parts: Column) -> Column:
    """As _token_forms, but for table cells: also zeros read for O, and parts of P-LCR cut off."""
    plain = F.transform(parts, lambda x: F.regexp_replace(F.translate(F.upper(x), "_", "-"), "[ .]", ""))
    letters = F.transform(plain, lambda t: F.when(t.rlike("[A-Z]"), F.translate(t, "0", "O")).otherwise(t))
    for fused, whole in (("RDWSD", "RDW-SD"), ("RDWCV", "RDW-CV"), ("PLCR", "P-LCR")):
        letters = F.transform(letters, lambda t: F.replace(t, F.lit(fused), F.lit(whole)))  # noqa: B023
    return F.transform(letters, lambda t: F.when(t.isin("-LCR", "LCR", "P-LCR%"), "P-LCR").otherwise(_differential(t)))


def token_key(text: Column) -> Column:
    """The form in which a test token of running text is known."""
    return _token_forms(F.array(texts.clean(text)))[0]


def normal_key(text: Column) -> Column:
    """The form in which a test token of a table is known."""
    return _cell_forms(F.array(texts.normal(text)))[0]


def first_known(t: Column, forms: Callable[[Column], Column]) -> Column:
    """The form of the whole text if it is a known test, else of the first of its parts that is one. t: cleaned text."""
    parts = forms(F.concat(F.array(t), F.split(t, r"[\s:;|/]+")))
    return F.try_element_at(F.filter(parts, lambda k: k.isin(*CBC_ORDER, *ALIASES)), F.lit(1))


def detect_key(text: Column) -> Column:
    """The test that a cell or line of a table names, else null."""
    return texts.let(texts.normal(text), lambda t: first_known(t, _cell_forms))


def detect_token_key(text: Column) -> Column:
    """The test that a piece of plain text names, else null."""
    return texts.let(texts.clean(text), lambda t: first_known(t, _token_forms))


def merge_key(raw_name: Column, canonical: Column, display: Column) -> Column:
    """What competing rows of one test share."""
    return F.when(raw_name.isin(*CBC_ORDER), F.lower(raw_name)).otherwise(F.lower(normal_key(F.coalesce(texts.first_filled(raw_name, canonical, display), F.lit("")))))


def identity(raw_name: Column, canonical: Column, display: Column) -> Column:
    """cbc:<code> for blood-count codes, else the first name that isn't empty, in lower case."""
    return F.coalesce(F.concat(F.lit("cbc:"), F.lower(cbc_code(raw_name))), F.lower(F.trim(F.coalesce(texts.first_filled(raw_name, canonical, display), F.lit("")))))


def cbc_code(text: Column) -> Column:
    """The blood-count code that text is, however it is spaced, else null."""
    t = F.translate(F.regexp_replace(F.upper(texts.clean_string(text)), "[ .]", ""), "_＃％", "-#%")
    t = texts.let(t, lambda x: F.when(x == "RDWSD", "RDW-SD").when(x == "RDWCV", "RDW-CV").when(x.isin("PLCR", "P-LCR%"), "P-LCR").otherwise(x))
    return texts.let(t, lambda x: F.when(x.isin(*CBC_ORDER), x))


def code_of(key: Column) -> Column:
    """cbc_code(), which the codes themselves don't need."""
    return F.when(key.isin(*CBC_ORDER), key).otherwise(cbc_code(key))


def order_of(key: Column) -> Column:
    """Place of a code in report order; 999 for others."""
    at = F.array_position(F.array(*[F.lit(k) for k in CBC_ORDER]), key)
    return F.when(at > 0, at).otherwise(F.lit(999)).cast("int")


def default_unit(key: Column, more: dict[str, str] = MORE_UNITS) -> Column:
    """The unit that a test has where none is named; with more = {} of codes in report order only."""
    pairs = [F.lit(x) for kv in {**CBC_UNITS, **more}.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def label(code: Column) -> Column:
    """What a blood-count code is called."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CBC_LABELS.items() for x in pair]), code), code)
