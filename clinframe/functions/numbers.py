"""Numbers, reference ranges and units in laboratory text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinframe.functions.texts import let

#: What counts as "no result" for a trend point, and for a stored value.
TREND_NIL = ["", "-", "--", "---", "nil", "n/a", "na", "null", "none"]
VALUE_NIL = ["", "-", "--", "---", "----", "-----", "------", "—", "–", "nil", "n/a", "na", "null", "none", "absent", "negativ"]
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"
#: Units by their lower-case spelling without blanks.
UNITS = {
    "g/dl": "g/dL", "g/l": "g/L", "mg/dl": "mg/dL", "mg/l": "mg/L", "mmol/l": "mmol/L", "umol/l": "umol/L", "µmol/l": "umol/L", "μmol/l": "umol/L",
    "uiu/ml": "uIU/mL", "ui/ml": "uIU/mL", "miu/l": "mIU/L", "iu/l": "IU/L", "u/l": "U/L", "fl": "fL", "pg": "pg",
}
#: Units with a power of ten, by pattern.
POWER_UNITS = [(r"10\^?3/?u?l", "10^3/uL"), (r"10\^?6/?u?l", "10^6/uL"), (r"10\^?9/?l", "10^9/L"), (r"10\^?12/?l", "10^12/L")]


def plain_signs(text: Column) -> Column:
    """Decimal commas and the various dashes made plain."""
    return F.translate(text, ",−–—", ".---")


def first_number(text: Column) -> Column:
    """The first decimal number in text, else null."""
    return F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double")


def lab_value(value: Column) -> Column:
    """A trend point's number; nil words give null."""
    return let(F.lower(F.trim(plain_signs(value))), lambda t: F.when(~t.isin(*TREND_NIL), first_number(t)))


def normalise_value(value: Column) -> Column:
    """A result as decimal text: only digits, signs and points; null if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(plain_signs(value), "[^0-9.+-]", ""), r"^\.", "0.")
    nil = F.lower(F.trim(value)).isin(*VALUE_NIL)
    return let(kept, lambda k: F.when(~nil & ~k.isin("", "+", "-", ".", "0.", "+.", "-.", *VALUE_NIL), k))


def exact_number(text: Column) -> Column:
    """The number that the whole text is, else null (3-5 is none)."""
    return let(text, lambda t: F.when(t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), t.try_cast("double")))


def bounds(text: Column) -> Column:
    """low and high of a reference range as text: its first two numbers, in order of size."""

    def pair(found: Column) -> Column:
        a, b = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(2))
        # In 3-5 the second number's sign is the dash between them.
        return F.struct(a.alias("a"), F.when(b.startswith("-") & ~a.startswith("-"), F.substring(b, 2, 100)).otherwise(b).alias("b"))

    def ordered(p: Column) -> Column:
        swap = p["b"].try_cast("double") < p["a"].try_cast("double")
        return F.when(p["b"].isNotNull(), F.struct(F.when(swap, p["b"]).otherwise(p["a"]).alias("low"), F.when(swap, p["a"]).otherwise(p["b"]).alias("high")))

    return let(F.regexp_extract_all(plain_signs(text), F.lit(f"({NUMBER})"), F.lit(1)), lambda found: let(pair(found), ordered))


def normalise_range(text: Column) -> Column:
    return let(bounds(text), lambda b: F.concat(b["low"], F.lit(" - "), b["high"]))


FUSED = [r"^([0-9]+\.[0-9]{2})([0-9]+\.[0-9]{2})$", r"^([0-9]+\.[0-9])([0-9]{2}\.[0-9])$"]


def split_fused(text: Column) -> Column:
    """Two decimals printed without a gap (3.936.08) as a range; both have as many decimals, and the second is larger."""
    out = F.lit(None).cast("string")
    for pattern in reversed(FUSED):
        a, b = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        fits = (a != "") & (b.try_cast("double") > a.try_cast("double"))
        out = F.when(fits, F.concat(a, F.lit(" - "), b)).otherwise(out)
    return out


def normalise_unit(unit: Column) -> Column:
    """The usual spelling of a unit; unknown ones are kept."""

    def spelled(low: Column) -> Column:
        out = F.when(F.trim(unit) == "", None)
        for pattern, name in POWER_UNITS:
            out = out.when(low.rlike(pattern), name)
        known = F.create_map(*[F.lit(x) for kv in {**UNITS, "%": "%"}.items() for x in kv])
        return out.otherwise(F.coalesce(F.try_element_at(known, low), F.trim(unit)))

    return let(F.lower(F.translate(F.trim(unit), " ", "")), spelled)


# Stored forms: what is in the usual form already passes as it is, everything else goes through the rule.


def stored_value(value: Column) -> Column:
    """normalise_value(); plain decimals only have their comma made a point."""
    return F.when(value.rlike(r"^[0-9]+([.,][0-9]+)?\z"), F.translate(value, ",", ".")).otherwise(normalise_value(value))


def stored_range(text: Column) -> Column:
    """normalise_range()."""
    side = lambda i: F.try_element_at(F.split(text, " - ", 2), F.lit(i)).try_cast("double")
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)? - [0-9]+(\.[0-9]+)?\z") & (side(1) <= side(2)), text).otherwise(normalise_range(text))


def stored_unit(unit: Column, cleaned: Column) -> Column:
    """normalise_unit() of the cleaned unit."""
    return F.when(unit.isin(*USUAL_UNITS), unit).otherwise(normalise_unit(cleaned))


USUAL_UNITS = sorted({*UNITS.values(), *[u for _, u in POWER_UNITS], "%"})
