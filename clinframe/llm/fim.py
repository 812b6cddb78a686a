"""Fill-in-the-middle rearrangement, in DataFrame functions only.

A text is cut into units: a word with the white space before it, or the white space at the end. A hash of seed and
doc_id gives two cuts between units, whether the document is rearranged at all, and in which order:

  plain  the text as it is
  psm    <P> prefix <S> suffix <M> middle
  spm    <S> suffix <P> prefix <M> middle

restore() takes the output apart at its sentinels and puts the text together again. That is exact: a text that holds
a sentinel stays plain, and no sentinel can arise where two parts meet, because its only `<` is its first character
and its only `>` its last.

Everything is a map over rows: nothing is shuffled, and the array of units of one text is the largest thing held.

Defined cases: a null text is empty, and an empty text is plain; a null doc_id is hashed as `null`; repeated rows have
equal outputs, as the cuts depend on doc_id alone; white space alone is one unit; an empty table gives an empty table;
other columns pass through, and added names get underscores where they are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import common

#: The white space of a unit is ASCII's. `*+` and `++` never give back what they took, which changes no match here.
SPACE = r"\x20\x09-\x0D"
UNIT = rf"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "fim_text")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs without text, with n_units, form, prefix_chars, middle_chars (null if plain) and fim_text.

    rate: of a hundred documents so many are rearranged; spm: of a hundred of those so many suffix first.
    """
    names = {c: common.free_name(docs, c) for c in (*ADDED, "fim_units", "fim_draws", "fim_first", "fim_second")}
    n, form, units, drawn, first, second = (names[c] for c in ("n_units", "form", "fim_units", "fim_draws", "fim_first", "fim_second"))
    text, rest = F.col("text"), [c for c in docs.columns if c != "text"]
    whole = docs.select(*rest, common.text_or_empty(docs).alias("text"))
    cut = whole.withColumns({units: F.regexp_extract_all("text", F.lit(UNIT), 0), drawn: F.array(*draws(F.col("doc_id"), seed))}).withColumn(n, F.size(units).cast("long"))
    h = [F.col(drawn)[i] for i in range(4)]
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= rate)
    a, b = h[0] % (F.col(n) + 1), h[1] % (F.col(n) + 1)
    cut = cut.withColumns({
        form: F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"),
        first: F.least(a, b).cast("int"), second: F.greatest(a, b).cast("int"),
    })
    part = lambda start, size: F.array_join(F.slice(units, start, size), "")
    start, end = F.col(first), F.col(second)
    # The parts of plain texts aren't made: each is under the condition.
    moved = lambda c: F.when(F.col(form) != "plain", c)
    prefix, middle, suffix = (common.free_name(docs, f"fim_{c}") for c in ("prefix", "middle", "suffix"))
    parts = cut.withColumns({
        prefix: moved(part(F.lit(1), start)), middle: moved(part(start + 1, end - start)), suffix: moved(part(end + 1, F.size(units) - end)),
    })
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_text = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = F.when(F.col(form) == "plain", text).when(F.col(form) == "spm", spm_text).otherwise(psm)
    return parts.select(
        *rest, n, form, F.char_length(prefix).cast("long").alias(names["prefix_chars"]), F.char_length(middle).cast("long").alias(names["middle_chars"]), out.alias(names["fim_text"])
    )


def restore(output: Column, form: Column) -> Column:
    """The text that rearrange() made output and form of."""
    parts = F.split(output, "<[PSM]>", 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))


def op13_fim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rearrange(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restore(F.col("fim_text"), F.col("form"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL_OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
