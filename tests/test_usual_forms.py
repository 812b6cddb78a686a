"""What passes as it is, or without a search, is what the whole rule gives."""

import pytest
from clinframe.functions import keys, numbers, texts
from clinframe.operators import extraction
from pyspark.sql import functions as F


NONE = lambda: F.lit(None).cast("string")
FORMS = [
    (keys.code_of, keys.cbc_code, [*keys.CBC_ORDER, *keys.ALIASES, "wbc", "RDW_SD", " HGB ", "Neut %", None, ""]),
    (lambda c: keys.merge_key(c, NONE(), NONE()), lambda c: F.lower(keys.normal_key(F.coalesce(c, F.lit("")))), [*keys.CBC_ORDER, *keys.ALIASES, "wbc", "M0N0%", "LCR", None, ""]),
    (numbers.stored_value, numbers.normalise_value, ["5", "5.2", "4,9", "0", "00.50", "+7", "5\n", "5.", ".5", "nil", "12 / 3", None, ""]),
    (numbers.stored_range, numbers.normalise_range, ["3 - 9", "3.5 - 3.50", "9 - 3", "10 - 9.5", "3-9", "-2 - 3", "3 - 9\n", "3 - 9 - 12", "1 -  2", None, ""]),
    (lambda c: numbers.stored_unit(c, texts.clean_string(c)), lambda c: numbers.normalise_unit(texts.clean_string(c)), [*numbers.USUAL_UNITS, "mg / dl", "10^3/ul", "G/DL", "x", None, ""]),
]


@pytest.mark.parametrize("fast,whole,forms", FORMS)
def test_usual_forms(spark, fast, whole, forms):
    df = spark.createDataFrame([(x,) for x in forms], "x string")
    for r in df.select("x", fast(F.col("x")).alias("fast"), whole(F.col("x")).alias("whole")).collect():
        assert r.fast == r.whole, r


def test_codes_are_not_spelled_again(spark):
    row = spark.createDataFrame([("WBC", 1, "5", "3 - 9", "fL", None, None, 0.9, 1)], "key string, document int, value string, reference_range string, unit string, flag string, category string, confidence double, seq int")
    r = extraction.merge_stored([row]).first()
    assert (r.key, r.value, r.reference_range, r.unit, r.flag, r.category) == ("WBC", "5", "3 - 9", "fL", "Normal", "Hematologie")
