"""Abnormality: three predicates, which differ on purpose, and result flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinframe.functions.texts import let

#: What each predicate's word list holds.
WORKLIST_NORMAL = ["", "normal", "none", "n", "ok", "within range"]
TREND_NORMAL = ["", "normal", "none", "ok"]
UI_ABNORMAL = ["high", "low", "abnormal", "critical", "borderline"]
HIGH_WORDS = ["high", "h", "crescut", "mare", "↑", "▲"]
LOW_WORDS = ["low", "l", "scazut", "scăzut", "mic", "↓", "▼"]
NORMAL_WORDS = ["normal", "n"]


def _word(flag: Column) -> Column:
    return F.lower(F.trim(flag))


def worklist_abnormal(flag: Column) -> Column:
    return F.coalesce(~_word(flag).isin(*WORKLIST_NORMAL), F.lit(False))


def trend_abnormal(flag: Column) -> Column:
    return F.coalesce(~_word(flag).isin(*TREND_NORMAL), F.lit(False))


def ui_abnormal(flag: Column) -> Column:
    return F.coalesce(_word(flag).isin(*UI_ABNORMAL), F.lit(False))


def normalise(flag: Column) -> Column:
    w = _word(flag)
    return F.when(w.isin(*HIGH_WORDS), "High").when(w.isin(*LOW_WORDS), "Low").when(w.isin(*NORMAL_WORDS), "Normal")


def infer(value: Column, low: Column, high: Column) -> Column:
    """Low, Normal (bounds included) or High; null without a number or bounds. Reversed bounds are swapped."""


    def judged(x: Column) -> Column:
        known = x["v"].isNotNull() & x["a"].isNotNull() & x["b"].isNotNull()
        return F.when(known, F.when(x["v"] < F.least(x["a"], x["b"]), "Low").when(x["v"] > F.greatest(x["a"], x["b"]), "High").otherwise("Normal"))

    return let(F.struct(value.alias("v"), low.alias("a"), high.alias("b")), judged)


#: What pages take for no result.
PAGE_NIL = ["", "nil", "null", "none", "n/a", "na", "-", "--", "---", "—", "–"]


def page_nil(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return v.isin(*PAGE_NIL) | v.rlike("^-+$")


def page_abnormal(value: Column, flag: Column) -> Column:
    """Abnormal on a document's page: by its word, and never where there is no value."""
    return ~page_nil(value) & ui_abnormal(flag)


def differs_from_normal(flag: Column, exact: bool = False) -> Column:
    """Abnormal on a trend: any flag but Normal; exact compares the case too."""
    f = F.coalesce(flag, F.lit(""))
    return (f != "") & ((f != "Normal") if exact else (F.lower(f) != "normal"))


def style(value: Column, flag: Column) -> Column:
    """nil, none, normal, abnormal or other."""
    w = _word(F.coalesce(flag, F.lit("")))
    return F.when(page_nil(value), "nil").when(w == "", "none").when(w == "normal", "normal").when(w.isin(*UI_ABNORMAL), "abnormal").otherwise("other")


def shown_value(value: Column) -> Column:
    return F.when(page_nil(value), "nil").otherwise(value)


def saved_flag(value: Column, reference: Column, flag: Column) -> Column:
    """A flag is saved only beside a value and a range."""
    return F.when(~page_nil(value) & (F.trim(F.coalesce(reference, F.lit(""))) != ""), flag)
