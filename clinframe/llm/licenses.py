"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to canonical form: lower case; copyright lines and the marks of list items removed; equivalent
spellings replaced by one; everything but letters, digits and marks turned into single spaces. Its SHA-256 is joined
with the digests of known licences, made in the same way. So a licence is found whatever its line breaks, bullets,
quotes, years and holders, and nothing else is: the whole text must be equal. A first line may be left out if it is
the licence's title, that is, if it has no words but those of the licence's own names and id, `the`, `license` and
`version`; so each text is looked up with its first line and without. Each line of a text is looked up too, for notices of
one line; only lines as long as some known text can match, so only those are digested.

A copyright line begins with the sign or `(c)`, or with the word before a year, sign or holder (not before words that
follow it inside licences, such as notice, holder or owner); it goes on while it ends in a comma or a joining word, or
the next line begins with one.

The built-in catalogue holds the short licences and common notices, and the long ones (Apache-2.0, CC0, GPL, LGPL, MPL) as files
in license_texts; read_catalogue() adds those of a folder. A catalogue is a frame (license_id, text) and perhaps names (an array), counted before it is broadcast; a larger one is joined by a salted
shuffle. Digests come once from the scan; they are kept in a scratch table and the texts aren't shuffled.

Defined cases: null texts and texts whose canonical form is empty have a null digest and match nothing; repeated
rows are looked up each; equal canonical forms in the catalogue count as the smallest license_id; an empty table or
catalogue gives no matches; other columns pass through; added names get underscores where they are taken.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import common

#: Spellings that licence matching treats as equal; each is replaced wherever it stands.
EQUIVALENTS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authoris", "authoriz"), ("behaviour", "behavior"),
    ("categoris", "categoriz"), ("customis", "customiz"), ("defence", "defense"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"),
    ("non-commercial", "noncommercial"), ("organis", "organiz"), ("per cent", "percent"), ("recognis", "recogniz"),
    ("sub-license", "sublicense"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
    ("https://", "http://"), ("copyright owner", "copyright holder"),
]
#: What follows the word inside a licence's own sentences, where a line may begin with it: no holder.
NO_HOLDER = r"copyright([ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]es?|and|or|in|is|as|of|on|to|for|with|over|that|interests?|statements?|protection|permissions?|patents?|disclaimers?|treat(?:y|ies)|status|claims?|rights?|ownership|infringements?)\b)"
GUARD = "\x01"
#: A line, with those before it that end in a comma or joining word, and those after it that begin with one.
_LINE = r"(?:[^\n]*(?:,|\band|\bby|&)[ \t]*\n)*[^\n]*(?:\n[ \t]*(?:and|&)[ \t][^\n]*)*"
COPYRIGHT_LINE = rf"(^|\n)[^a-z0-9\n©(]*(?:copyright[ \t]+(?:by[ \t]+)?(?:\(c\)|©|[0-9<\[{{]|\p{{L}})|copyright[ \t]*©|\(c\)[ \t]*(?:copyright|[0-9<\[{{])|©|all rights reserved[. \t]*(?:\n|$)){_LINE}"
MARK = r"(^|\n)[ \t]*(?:[*•-]+|\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)])[ \t]+"
NOT_KEPT = r"[^a-z0-9\p{L}\p{N}\p{M}\n]+"
#: A first line longer than this is no title; words that any title may have.
TITLE_CHARS = 120
TITLE_WORDS = ["the", "license", "licenses", "version", "v"]

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts without their copyright lines, and common notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

""" + _WARRANTY,
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so.

""" + _WARRANTY,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

""" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
""" + _BSD_END,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


#: Names under which licences are known, beside their ids.
NAMES = {
    "MIT": ["MIT", "Expat"], "MIT-0": ["MIT No Attribution"], "ISC": ["ISC"], "0BSD": ["BSD Zero Clause"],
    "BSD-2-Clause": ["BSD 2-Clause Simplified", "FreeBSD"], "BSD-3-Clause": ["BSD 3-Clause New or Revised", "Modified BSD"],
    "Zlib": ["zlib/libpng"], "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Apache-2.0": ["Apache License, Version 2.0"], "MPL-2.0": ["Mozilla Public License Version 2.0"], "CC0-1.0": ["Creative Commons Legal Code"],
    "GPL-2.0": ["GNU General Public License, GPL version 2"], "GPL-3.0": ["GNU General Public License, GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, LGPL version 2.1"], "LGPL-3.0": ["GNU Lesser General Public License, LGPL version 3"],
}


def known_texts() -> dict[str, str]:
    """The short texts and notices above, and the long ones that lie beside this module."""
    folder = resources.files(__package__) / "license_texts"
    files = sorted((f for f in folder.iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return KNOWN | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files}


def canonical_lines(text: Column) -> Column:
    """Canonical form with its line breaks."""
    t = F.lower(text)
    marked = t.contains("copyright") | t.contains("(c)") | t.contains("©") | t.contains("all rights reserved")
    t = F.when(marked, F.regexp_replace(F.regexp_replace(t, NO_HOLDER, f"copyright{GUARD}$1"), COPYRIGHT_LINE, "$1")).otherwise(t)
    t = F.regexp_replace(t, MARK, "$1")
    for a, b in EQUIVALENTS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, NOT_KEPT, " ")


def apart(lines: Column) -> tuple[Column, Column]:
    """The words of what may be a title (null if there is none), and what follows it."""
    body = F.ltrim(F.regexp_replace(lines, "^[ \n]+", ""))
    first = F.substring_index(body, "\n", 1)
    rest = one_line(F.substr(body, F.char_length(first) + 1))
    words = F.filter(F.array_distinct(F.split(F.trim(first), " +")), lambda w: ~w.isin(*TITLE_WORDS))
    titled = (F.char_length(first) <= TITLE_CHARS) & (rest != "") & ((F.size(words) > 0) | first.contains("license"))
    return F.when(titled, words), rest


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit(" ")), " {2,}", " "))


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_digests(catalogue: DataFrame) -> DataFrame:
    """(digest, license_id, size, title_words) of a catalogue (license_id, text) or (license_id, text, names)."""
    given = F.coalesce(F.col("names"), F.array().cast("array<string>")) if "names" in catalogue.columns else F.array().cast("array<string>")
    own = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.array_join(F.array_append(given, F.col("license_id")), " ")), NOT_KEPT, " ")), " +"))
    title, rest = apart(F.col("lines"))
    rows = catalogue.select("license_id", own.alias("own"), canonical_lines(F.col("text")).alias("lines")).withColumns({"title": title, "rest": rest})
    form = F.when(F.size(F.array_except("title", "own")) == 0, F.col("rest")).otherwise(one_line(F.col("lines")))
    rows = rows.select(digest(form).alias("digest"), F.length(form).alias("size"), "license_id", "own").where("digest IS NOT NULL")
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("size").alias("size"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("title_words"))


def default_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, NAMES.get(k)) for k, v in known_texts().items()], "license_id string, text string, names array<string>")


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The built-in texts and those of a folder of files <license_id>.txt."""
    files = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("license_id"), F.col("value").alias("text"))
    return default_catalogue(spark).unionByName(files, allowMissingColumns=True)


def scan(docs: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """docs without their text, with text_digest, license_id and line_licenses (sorted, comma-joined; '' for none).

    text_digest is that of the text without its first line where that is the title of the licence found.
    """
    spark = docs.sparkSession
    known = common.materialise(known_digests(catalogue if catalogue is not None else default_catalogue(spark)), "licenses")
    n, least, most = known.agg(F.count(F.lit(1)), F.min("size"), F.max("size")).first()
    fits = lambda x: F.length(x).between(least or 1, most or 0)
    rest = [c for c in docs.columns if c != "text"]
    out_digest, out_license, out_lines = (common.free_name(docs, c) for c in ("text_digest", "license_id", "line_licenses"))
    text, forms_at, parts_at, found, doc, hash_, title, titled, under, words = (common.free_name(docs, f"scan_{c}") for c in ("text", "lines", "parts", "license", "doc", "hash", "title", "titled", "under", "words"))
    lines = docs.select(*rest, canonical_lines(F.col("text")).alias(forms_at), F.xxhash64("text").alias(text))
    parts = F.filter(F.transform(F.split(forms_at, "\n"), lambda x: F.trim(x)), fits)
    digests = F.coalesce(F.array_distinct(F.transform(parts, lambda x: F.sha2(x, 256))), F.array().cast("array<string>"))
    heads, bodies = apart(F.col(forms_at))
    forms = lines.select(*rest, text, digest(one_line(F.col(forms_at))).alias(out_digest), digests.alias(parts_at), heads.alias(title), F.when(fits(bodies), digest(bodies)).alias(titled))
    forms = common.materialise(forms, "license-digests")
    spread = F.xxhash64("doc_id")
    known = known.drop("size").withColumnsRenamed({"license_id": found, "title_words": words})
    single = forms.select("doc_id", text, F.explode(parts_at).alias("digest"))
    hits = common.bounded_join(single, known.drop(words), ["digest"], spread, n, 128, "inner").groupBy("doc_id", text).agg(F.array_join(F.array_sort(F.collect_set(found)), ",").alias(out_lines))
    hits = hits.withColumnsRenamed({"doc_id": doc, text: hash_})
    whole = common.bounded_join(forms.drop(parts_at), known.drop(words).withColumnRenamed("digest", out_digest), [out_digest], spread, n, 128).withColumnRenamed(found, out_license)
    # Without its first line, where that has no words but those of a title.
    below = known.withColumnsRenamed({"digest": titled, found: under})
    both = common.bounded_join(whole, below, [titled], spread, n, 512)
    named = F.col(out_license).isNull() & F.col(under).isNotNull() & (F.size(F.array_except(title, words)) == 0)
    both = both.withColumns({out_license: F.when(named, F.col(under)).otherwise(F.col(out_license)), out_digest: F.when(named, F.col(titled)).otherwise(F.col(out_digest))})
    joined = both.join(hits, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(text) == F.col(hash_)), "left")
    return joined.drop(doc, hash_, text, title, titled, under, words).fillna("", [out_lines])


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_form(text: str) -> str:
    t = f"regexp_replace(lower({text}), '{NO_HOLDER}', 'copyright' || chr(1) || '\\1', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{COPYRIGHT_LINE}', '\\1', 'g'), '{MARK}', '\\1', 'g')"
    for a, b in EQUIVALENTS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"regexp_replace({t}, '{NOT_KEPT}', ' ', 'g')"


def _sql_one(lines: str) -> str:
    return f"trim(regexp_replace(replace({lines}, chr(10), ' '), ' {{2,}}', ' ', 'g'))"


def _sql_apart(source: str) -> str:
    """source (id, f, ...) with title (a list of words or null) and the digests of the whole and of what follows."""
    words = f"list_filter(list_distinct(regexp_split_to_array(trim(head), ' +')), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in TITLE_WORDS)}))"
    return f"""(SELECT *, CASE WHEN {_sql_one('f')} <> '' THEN sha256({_sql_one('f')}) END AS whole, CASE WHEN rest <> '' THEN sha256(rest) END AS below, CASE WHEN length(head) <= {TITLE_CHARS} AND rest <> '' AND (len({words}) > 0 OR contains(head, 'license')) THEN {words} END AS title
  FROM (SELECT *, {_sql_one('substr(body, length(head) + 1)')} AS rest FROM (SELECT *, regexp_extract(body, '^[^\n]*') AS head FROM (SELECT *, regexp_replace(f, '^[ \n]+', '') AS body FROM {source}))))"""


def _sql_values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(k)}, {quoted(v)}, {quoted(' '.join([*NAMES.get(k, []), k]))})" for k, v in known_texts().items())


SQL_OP6 = f"""
WITH texts AS (SELECT id, {_sql_form('t')} AS f, list_distinct(regexp_split_to_array(trim(regexp_replace(lower(names), '{NOT_KEPT}', ' ', 'g')), ' +')) AS own FROM (VALUES {_sql_values()}) v(id, t, names)),
known AS (SELECT CASE WHEN len(list_filter(title, lambda w: NOT list_contains(own, w))) = 0 THEN below ELSE whole END AS digest, min(id) AS license_id, list_distinct(flatten(list(own))) AS own FROM {_sql_apart('texts')} GROUP BY 1),
forms AS (SELECT doc_id, {_sql_form('text')} AS f FROM documents),
found AS (SELECT d.doc_id, CASE WHEN k.digest IS NULL AND b.digest IS NOT NULL THEN below ELSE whole END AS text_digest, coalesce(k.license_id, b.license_id) AS license_id
  FROM {_sql_apart('forms')} d LEFT JOIN known k ON d.whole = k.digest LEFT JOIN known b ON d.below = b.digest AND len(list_filter(d.title, lambda w: NOT list_contains(b.own, w))) = 0),
lines AS (SELECT DISTINCT doc_id, trim(unnest(string_split(f, chr(10)))) AS line FROM forms),
hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM lines JOIN known ON sha256(line) = digest WHERE line <> '' GROUP BY doc_id)
SELECT d.doc_id, text_digest, license_id, coalesce(line_licenses, '') AS line_licenses
FROM found d LEFT JOIN hits h ON d.doc_id = h.doc_id
"""
