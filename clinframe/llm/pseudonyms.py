"""Format-preserving pseudonyms: validated numbers and dates are permuted, with a key, within their format.

A value found in a text is checked (Luhn, IBAN mod 97, octets, calendar ...), written as a number below the size
of its format's domain, sent through a keyed Feistel network over that domain (cycle walking keeps it inside),
and written back in the same layout: separators, country prefix, letter case and date order stay, check digits
are made anew. The permutation depends on key and format alone, so equal values get equal pseudonyms in all
documents, also where their layout differs, and different values never meet.

  kind    found                                              domain
  card    13-19 digits, blanks or hyphens between, Luhn      digits but the last, which is made to fit
  account other runs of 12-19 digits                         digits
  iban    country, check digits, 11-30 letters and digits    letters and digits after the check digits
  ssn     ddd-dd-dddd with a valid area, group and serial    valid triples
  phone   + and 8-15 digits, or (ddd) ddd-dddd and the like  digits after the country prefix
  ipv4    four octets                                        2^32
  date    y-m-d, d.m.y, d/m/y or m/d/y, 1900-2099            days
  email   local part and first label                         letters and digits in place

Map-only, one pass over whole texts. Defined cases: null stays null with no findings, empty stays empty; repeated
rows are treated alike; empty tables give empty tables; all columns pass through, the result is a struct column.
Where findings would overlap, the one that starts first counts, at the same start the kind that stands first in
KINDS.

A run may hold more than the value: a word, an amount, an expiry date. So its parts at blanks and hyphens are tried too,
and the first that validates is taken: an IBAN by its country's length, then the whole run (for countries without a
known length, also shorter parts); a card by its issuer's length, also behind leading groups, then from 19 to 13 digits,
and only then the run as an account; a phone number from the longest part.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinframe.llm import common

ROUNDS = 10
KINDS = ["date", "ssn", "ipv4", "iban", "phone", "card", "account", "email"]
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("pseudonym", T.StringType())])
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-Za-z/-]))"
    r"|(?P<ipv4>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]))"
    r"|(?P<number>(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){11,18}(?![0-9A-Za-z]))",
    re.ASCII,
)
HINT = re.compile(r"[0-9@]")
#: Lengths of IBANs by country.
IBAN_LENGTHS = {country: int(n) for n, countries in {
    "15": "NO", "16": "BE", "18": "DK FO FI FK GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST",
    "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HN HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU YE",
    "31": "MT SC", "32": "LC", "33": "RU",
}.items() for country in countries.split()}
#: Digits of a card of its issuer's length.
ISSUED = re.compile(r"(?:4[0-9]{15}|(?:5[1-5]|2[2-7]|6[05]|35)[0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12})", re.ASCII)


class Feistel:
    """A keyed permutation of 0 .. n - 1 for each tweak (the format)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _once(self, x: int, half: int, tweak: bytes) -> int:
        mask = (1 << half) - 1
        left, right = x >> half, x & mask
        size = (half + 7) // 8
        for r in range(ROUNDS):
            mixed = hashlib.blake2b(right.to_bytes(size, "big"), key=self.key, digest_size=min(64, size + 8), salt=bytes([r]), person=tweak).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        return left << half | right

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        person = hashlib.blake2b(f"{tweak}/{n}".encode(), digest_size=16).digest()
        x = self._once(x, half, person)
        while x >= n:
            x = self._once(x, half, person)
        return x


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def relayout(layout: str, symbols: str) -> str:
    """layout with its letters and digits replaced, in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def spell(f: Feistel, symbols: str, tweak: str) -> str:
    """symbols permuted among the strings with digits, lower and upper case letters in the same places."""
    sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in symbols]
    x, n = 0, 1
    for c, s in zip(symbols, sets):
        x, n = x * len(s) + s.index(c), n * len(s)
    x = f.permute(x, n, tweak + "".join(s[0] for s in sets))
    out = []
    for s in reversed(sets):
        x, r = divmod(x, len(s))
        out.append(s[r])
    return "".join(reversed(out))


def card(f: Feistel, found: str) -> str | None:
    digits = re.sub("[ -]", "", found)
    if len(digits) < 13 or luhn_sum(digits) % 10 or not digits.strip("0"):
        return None
    body = spell(f, digits[:-1], "card")
    return relayout(found, body + str(-luhn_sum(body + "0") % 10))


def account(f: Feistel, found: str) -> str | None:
    return relayout(found, spell(f, re.sub("[ -]", "", found), "account"))


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def iban(f: Feistel, found: str) -> str | None:
    flat = found.replace(" ", "")
    if not 15 <= len(flat) <= 34 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    rest = spell(f, flat[4:], "iban" + flat[:2])
    return relayout(found, flat[:2] + iban_check(flat[:2], rest) + rest)


def ssn(f: Feistel, found: str) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = f.permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(f: Feistel, found: str) -> str | None:
    digits = re.sub("[^0-9]", "", found)
    if not 8 <= len(digits) <= 15:
        return None
    prefix = re.match(r"\+([0-9]{1,3})(?=[ .(-])", found)
    # Without a mark after it, the country prefix can't be told; the first digit stays.
    keep = len(prefix[1]) if prefix else 1 if found[0] == "+" else 0
    return relayout(found, digits[:keep] + spell(f, digits[keep:], f"phone{digits[:keep]}" if keep and digits[:keep] != "1" else "phone1"))


def ipv4(f: Feistel, found: str) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, f.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ipv4").to_bytes(4, "big")))


def date(f: Feistel, found: str) -> str | None:
    sign = re.search("[^0-9]", found)[0]
    a, b, c = found.split(sign)
    orders = {"-": [(a, b, c)], ".": [(c, b, a)], "/": [(c, b, a), (c, a, b)]}[sign]
    for i, ymd in enumerate(orders):
        try:
            day = datetime.date(*map(int, ymd)).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(f.permute(day, DAYS, "date") + FIRST_DAY)
        y, m, d = str(new.year), *(f"{x:02d}" if len(w) == 2 else str(x) for x, w in zip((new.month, new.day), ymd[1:]))
        return sign.join((y, m, d) if sign == "-" else (m, d, y) if i else (d, m, y))
    return None


def email(f: Feistel, found: str) -> str | None:
    local, _, domain = found.partition("@")
    label, dot, rest = domain.partition(".")
    low = local.lower() + "@" + label.lower()
    out = spell(f, "".join(c for c in low if c.isalnum()), "email" + re.sub("[a-z]", "a", re.sub("[0-9]", "0", low)))
    return relayout(low, out) + dot + rest


MAKERS = {"email": email, "iban": iban, "date": date, "ipv4": ipv4, "ssn": ssn, "phone": phone, "card": card, "account": account}


def trials(kind: str, found: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the parts of a run that may be the value, in the order in which they are tried."""
    whole = (kind, 0, len(found))
    if kind not in ("iban", "number", "phone"):
        return [whole]
    signs = " " if kind == "iban" else " -" if kind == "number" else " .-"
    ends = [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] in signs)]
    if kind == "phone":
        return [(kind, 0, e) for e in ends]
    if kind == "iban":
        size = IBAN_LENGTHS.get(found[:2])
        if not size:
            return [(kind, 0, e) for e in ends]
        return [*((kind, 0, e) for e in ends if e - found.count(" ", 0, e) == size), whole]
    starts = [0, *(i + 1 for i, c in enumerate(found) if c in signs)]
    issued = [("card", s, e) for s in starts for e in ends if s < e and ISSUED.fullmatch(re.sub("[ -]", "", found[s:e]))]
    return [*issued, *(("card", 0, e) for e in ends), ("account", 0, len(found))]


def settle(f: Feistel, kind: str, found: str) -> tuple[str, int, int, str] | None:
    """(kind, start, end, pseudonym) of the first part of a run that validates."""
    for name, start, end in trials(kind, found):
        if new := MAKERS[name](f, found[start:end]):
            return name, start, end, new
    return None


def replace(f: Feistel, text: str, held: dict[tuple[str, str], tuple[str, int, int, str] | None]) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and what was found where."""
    parts, spans, done, at = [], [], 0, 0
    while m := PATTERN.search(text, at):
        kind, found = m.lastgroup, m[0]
        if (kind, found) not in held:
            if len(held) > 100_000:
                held.clear()
            held[kind, found] = settle(f, kind, found)
        if got := held[kind, found]:
            name, start, end, new = got
            parts += [text[done : m.start() + start], new]
            spans.append({"kind": name, "start": m.start() + start, "length": end - start, "pseudonym": new})
            done = at = m.start() + end
        else:
            # Not valid as this kind: look again from the next character that can begin something.
            at = m.start() + 1
    return "".join([*parts, text[done:]]), spans


def annotate(docs: DataFrame, key: str | bytes, out: str = "private") -> DataFrame:
    """docs with a struct: the text with pseudonyms, and spans (kind, start and length in the old text)."""
    out = common.free_name(docs, out)
    at, names = docs.columns.index("text"), [*docs.columns, out]
    secret = key.encode() if isinstance(key, str) else key
    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("pseudonym", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held = Feistel(secret), {}
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                new, spans = replace(f, text, held) if text and HINT.search(text) else (text, [])
                rows.append({"text": new, "spans": spans})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, RESULT)]))


#: Production sets a secret of its own; a query needs one that stays.
QUERY_KEY = "clinframe-query-key"


def op5_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = annotate(common.table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    kinds = F.col("private.spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", "private.text", *counts)
