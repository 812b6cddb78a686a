"""Text cleaning for laboratory reports, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\r\n\f\x0B\x{A0}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def clean(text: Column) -> Column:
    """One-line text: dashes and full-width signs made plain, broken encoding dropped, blanks collapsed."""
    t = F.translate(text, "﻿�Â", "")
    t = F.replace(t, F.lit("â€"), F.lit(""))
    t = F.translate(t, "µμ−–—＃％︱|ΜΟΝ", "uu---#%  MON")
    return F.trim(F.regexp_replace(t, BLANKS, " "))


def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form (NFKC) is one other character, and that form: Latin, superscript, full-width, blanks."""
    ranges = [range(0xA0, 0x250), range(0x2000, 0x200B), range(0x2070, 0x20A0), range(0xFF01, 0xFF5F)]
    pairs = [(chr(i), unicodedata.normalize("NFKC", chr(i))) for r in ranges for i in r]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normal(text: Column) -> Column:
    """clean() with compatibility forms made plain, and Greek capitals that look like Latin ones replaced."""
    t = F.translate(clean(text), *_compatible())
    t = F.translate(t, "ΜΟΝΑΒΕΙΚΡΤΧμον", "MONABEIKPTXuov")
    return F.trim(F.regexp_replace(t, BLANKS, " "))


def clean_string(text: Column) -> Column:
    """Plain dashes, broken encoding dropped, collapsed blanks, no blanks, colons or semicolons at the ends; null for nothing."""
    t = F.replace(F.translate(text, "−–—\ufeffÂ\ufffd", "---"), F.lit("â€"), F.lit(""))
    t = F.regexp_replace(t, r"[\s\x{A0}]+", " ")
    return F.nullif(F.regexp_replace(t, r"^[ ;:]+|[ ;:]+$", ""), F.lit(""))


def clean_spaces(text: Column) -> Column:
    """Header text on one line: pipes as blanks, no blanks, colons, semicolons or dashes at the ends; null for nothing."""
    t = F.regexp_replace(F.translate(text, "|−–—", " ---"), r"[\s\x{A0}\x{FEFF}]+", " ")
    return F.nullif(F.regexp_replace(t, r"^[ :;-]+|[ :;-]+$", ""), F.lit(""))


def clean_block(text: Column) -> Column:
    """Each line cleaned; empty lines dropped."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda l: F.trim(F.regexp_replace(l, r"[ \t\f\x0B\x{A0}\x{FEFF}]+", " ")))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def section_of(blob: Column, marker: str) -> Column:
    """What follows a marker line, up to the next one (--- WORDS ---); the whole text where the marker is missing."""
    t = F.coalesce(blob, F.lit(""))
    rest = F.element_at(F.split(t, _quoted(marker), 2), -1)
    return F.when(t.contains(marker), F.element_at(F.split(rest, r"\n--- [A-Z ]+ ---", 2), 1)).otherwise(t)


def _quoted(words: str) -> str:
    return "\\Q" + words + "\\E"


def lines_of(blob: Column, marker: str | None = None) -> Column:
    """The non-empty normalised lines of a text, or of its section after a marker."""
    t = section_of(blob, marker) if marker else F.coalesce(blob, F.lit(""))
    return F.filter(F.transform(F.split(t, "\r\n|\r|\n"), normal), lambda l: l != "")


def compact_key(text: Column) -> Column:
    """Only what tells names apart: a-z, 0-9, % and #."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9%#]", "")


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(text, "ăâîșşțţĂÂÎȘŞȚŢáàäãåéèêëíìïóòôöõúùûüñçÁÀÄÃÅÉÈÊËÍÌÏÓÒÔÖÕÚÙÛÜÑÇ", "aaissttAAISSTTaaaaaeeeeiiiooooouuuuncAAAAAEEEEIIIOOOOOUUUUNC")


def strip_accents_ro(text: Column) -> Column:
    """Romanian letters without their accents, case kept."""
    return F.translate(text, "ăĂâÂîÎșȘşŞțȚţŢ", "aAaAiIsSsStTtT")


def catalogue_name(text: Column) -> Column:
    """A test name for matching: no accents, lower case, only letters, digits, % + # . / and dashes."""
    t = F.regexp_replace(F.translate(F.lower(strip_accents(text)), "_:", "  "), r"[^a-z0-9%+#./ -]", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def preview(text: Column, n: int = 180) -> Column:
    """The first n characters, with dots if there are more; null for empty."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(F.nullif(text, F.lit("")))


def initials(name: Column, most: int = 2) -> Column:
    words = F.filter(F.split(F.trim(name), " +"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.substring(w, 1, 1)), ""))


def title_of(section: Column) -> Column:
    return F.initcap(F.replace(section, F.lit("_"), F.lit(" ")))


#: Words that laboratory reports hold.
LAB_WORDS = [
    "hemoglobin", "hemoglobina", "hemoglobină", "leucocyte", "leukocyte", "leucocite", "eritrocite", "creatinina", "creatinine", "glucoza", "glucose", "colesterol", "cholesterol", "trigliceride", "triglycerides",
    "tsh", "alt", "ast", "wbc", "rbc", "hgb", "hct", "plt", "mcv", "mch", "mchc", "neut", "lymph", "mono",
]


def ocr_quality(text: Column, keywords: list[str] = LAB_WORDS) -> Column:
    """score (0 .. 1), level and warnings of a scanned text: steps of length, letters, digits, lines and words of reports."""

    def judged(t: Column) -> Column:
        count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
        lines = F.size(F.filter(F.split(t, "\r\n|\r|\n"), lambda x: F.trim(x) != ""))
        hits = texts_hits(F.lower(t), keywords)
        step = lambda *cases: F.coalesce(*[F.when(c, F.lit(n)) for c, n in cases], F.lit(0.0))
        n = F.length(t)
        score = step((n >= 200, 0.25), (n >= 80, 0.15)) + step((count(r"\p{L}") >= 80, 0.2)) + step((count("[0-9]") >= 10, 0.2)) + step((lines >= 5, 0.15)) + let(hits, lambda h: step((h >= 3, 0.2), (h >= 1, 0.1)))
        return let(F.when(t == "", F.lit(0.0)).otherwise(F.round(score, 2)), lambda s: F.struct(s.alias("score"), level_of(t, s).alias("level"), warning_of(t, s).alias("warning")))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), judged)


def texts_hits(low: Column, keywords: list[str]) -> Column:
    return sum((F.when(low.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))


def level_of(t: Column, score: Column) -> Column:
    return F.when(t == "", "empty").when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def warning_of(t: Column, score: Column) -> Column:
    low, moderate = "Text quality appears low. Manual review is recommended.", "Text quality is moderate. Some fields may need review."
    return F.when(t == "", "No text could be extracted from this document.").when(score < 0.4, low).when(score < 0.7, moderate)


def pretty(words: Column) -> Column:
    """Underscores as blanks, words capitalised."""
    return F.initcap(F.replace(words, F.lit("_"), F.lit(" ")))


def or_dash(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("—"))


def document_title(report_name: Column, filename: Column, id_: Column) -> Column:
    return F.coalesce(first_filled(report_name, filename), F.concat(F.lit("Document "), id_.cast("string")))


def joined(*parts: Column, none: str = "Unknown") -> Column:
    """Parts that aren't empty, with dots between them; `none` for none."""
    return F.coalesce(F.nullif(F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " · "), F.lit("")), F.lit(none))
