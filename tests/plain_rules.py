"""The parsers' rules once more, as plain Python over lists: what the operators are compared with."""

import re
import unicodedata
from statistics import median

from clinframe.functions import cells, keys

KNOWN = set(keys.CBC_ORDER) | set(keys.ALIASES)
NUMBER = re.compile(cells.NUMBER)


def normal(t):
    return re.sub(r"\s+", " ", (t or "").replace("|", " ").replace("µ", "u").replace("–", "-").replace("—", "-").replace("−", "-").replace(" ", " ").replace("Â", "").replace("Μ", "M").replace("Ο", "O").replace("Ν", "N")).strip()


def sign_form(t):
    for p in keys.PREFIXES:
        if t.startswith(p) and ("#" in t or "%" in t):
            return p + ("#" if "#" in t else "%")
    return "EO" if t == "EOS" else t


def normal_key(t):
    t = re.sub("[ .]", "", normal(t).upper().replace("_", "-"))
    if re.search("[A-Z]", t):
        t = t.replace("0", "O")
    t = t.replace("RDWSD", "RDW-SD").replace("RDWCV", "RDW-CV").replace("PLCR", "P-LCR")
    return "P-LCR" if t in ("-LCR", "LCR", "P-LCR%") else sign_form(t)


def token_key(t):
    t = re.sub("[ .]", "", normal(t).upper().replace("_", "-"))
    t = re.sub("M0N[0O]|MON0", "MONO", t)
    return {"RDWSD": "RDW-SD", "RDWCV": "RDW-CV", "PLCR": "P-LCR", "P-LCR%": "P-LCR"}.get(t) or sign_form(t)


def detect(t, form=normal_key):
    t = normal(t)
    return next((form(x) for x in [t, *re.split(r"[\s:;|/]+", t)] if form(x) in KNOWN), None)


def nil(t):
    return normal(t).lower() in cells.NIL


def unit(t):
    return next((u for p, u in cells.UNIT_PATTERNS if re.search(p, normal(t), re.I)), None) if normal(t) else None


def bare(t):
    t = normal(t)
    for p, _ in cells.UNIT_PATTERNS:
        t = re.sub(p, " ", t, flags=re.I)
    return re.sub(r"\s+", " ", t.replace(",", ".")).strip()


def ordered(a, b):
    return f"{b} - {a}" if float(b) < float(a) else f"{a} - {b}"


def fused(x, wide=(3, 3, 3)):
    m = re.fullmatch(r"(\d{1,%d}\.\d\d)(\d{1,%d}\.\d\d)" % (wide[0], wide[0]), x) or re.fullmatch(r"(\d{1,3}\.\d)(\d{%s}\.\d)" % ("1,3" if wide[1] == 3 else "2"), x)
    return m.groups() if m else None


def range_of(t):
    b = bare(t)
    if m := re.search(cells.BOUNDS, b):
        low, high = m.groups()
        return ordered(low, high.lstrip("-") if not low.startswith("-") else high)
    for x in [*b.split(), b.replace(" ", "")]:
        if f := fused(x):
            return ordered(*f)
    found = NUMBER.findall(b)
    return ordered(*[n.lstrip("+") for n in found[:2]]) if len(found) >= 2 and unit(t) else None


def text_range(t):
    b = bare(t)
    if m := re.search(cells.BOUNDS, b):
        return ordered(*[x.lstrip("-") for x in m.groups()])
    for x in [*b.split(), b.replace(" ", "")]:
        f = fused(x, (2, 2))
        if f and float(f[1]) > float(f[0]):
            return f"{f[0]} - {f[1]}"
    found = [n.lstrip("-") for n in NUMBER.findall(b)]
    return ordered(*found[:2]) if len(found) >= 2 and not re.search(r"\b(19|20)\d\d\b", b) else None


def result(t):
    found = NUMBER.findall(bare(t))
    return found[0].lstrip("+") if not nil(t) and range_of(t) is None and len(found) == 1 else None


def compatible(e, a):
    return not e or not a or a.lower() in cells.UNIT_GROUPS.get(e.lower(), [e.lower()])


def fits(key, t):
    own, u = keys.CBC_UNITS.get(key), unit(t)
    if key in keys.NO_REFERENCE or range_of(t) is None or not compatible(own, u):
        return False
    return not (key.endswith("%") and u and u != "%") and not (key.endswith("#") and u == "%") and not (own != "%" and u == "%")


def header(t):
    t = normal(t).lower()
    return t == "" or t in cells.HEADERS or any(w in t for w in cells.STOPS)


def flag(value, range_, said):
    if value is None or range_ is None:
        return None
    word = {"high": "High", "h": "High", "crescut": "High", "mare": "High", "low": "Low", "l": "Low", "scazut": "Low", "scăzut": "Low", "mic": "Low", "normal": "Normal", "ok": "Normal"}.get(normal(said).lower())
    low, high = map(float, range_.split(" - "))
    return word or ("Low" if float(value) < low else "High" if float(value) > high else "Normal")


def row(key, res, ref, unit_text, said=""):
    range_ = text_range(range_of(ref)) if ref and fits(key, ref) else None
    u = unit(unit_text) or unit(ref) or unit(res) or {**keys.CBC_UNITS, **keys.MORE_UNITS}.get(key)
    value = result(res or "")
    return (key, value, range_, u, flag(value, range_, said))


def scores(t):
    t = normal(t)
    low, hint = t.lower(), lambda r: 5 * sum(w in t.lower() for w in cells.HINTS[r])
    k, g, u = detect(t) is not None, range_of(t) is not None, unit(t) is not None
    only = not g and u and not NUMBER.findall(bare(t))
    return {
        "test": 12 * k + hint("test") + (any(c.isalpha() for c in t) and not NUMBER.findall(t)), "result": 2 * nil(t) + 7 * (result(t) is not None) + hint("result") - 7 * g - 4 * only - 8 * k,
        "reference": 9 * g + 1.5 * u + hint("reference") - 8 * k, "unit": 7 * u + hint("unit") - 2 * g - 6 * k, "flag": hint("flag") + 5 * (low in cells.FLAG_WORDS),
    }


def roles(rows):
    n = max(map(len, rows), default=0)
    sums = {r: [sum(scores(x[i] if i < len(x) else "")[r] for x in rows) for i in range(n)] for r in cells.ROLES}
    out, used = {}, set()
    for r in cells.ROLES:
        best = [i for i in sorted(range(n), key=lambda i: -sums[r][i]) if sums[r][i] > 0 and (r in ("unit", "flag") or i not in used)]
        if best:
            out[r] = best[0]
            if r not in ("unit", "flag"):
                used.add(best[0])
    return out


def fill(key, texts, at):
    res, ref, un = at.get("result", ""), at.get("reference", ""), at.get("unit", "")
    res = res or next((c for c in texts if (result(c) is not None or nil(c)) and not detect(c) and range_of(c) is None), "")
    if not ref and key not in keys.NO_REFERENCE:
        ref = next((c for c in texts if fits(key, c)), "")
    un = un or next((c for c in texts if unit(c)), "")
    return row(key, res, ref, un, at.get("flag", ""))


def table(rows):
    rows = [[normal(c) for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    where = roles(rows)
    out = []
    for r in rows if "test" in where else []:
        at = {k: r[i] if i < len(r) else "" for k, i in where.items()}
        key = detect(at["test"]) or detect(" ".join(r))
        if key and not header(at["test"]):
            out.append(fill(key, r, at))
    return out


def lines(all_lines):
    ls = [normal(x) for x in all_lines if normal(x)]

    def near(i, step):
        found = []
        for d in range(1, 6):
            j = i + step * d
            if not 0 <= j < len(ls) or detect(ls[j]):
                break
            if not header(ls[j]):
                found.append((d, ls[j]))
        return found

    out = []
    for i, x in enumerate(ls):
        key = detect(x)
        if not key or header(x):
            continue
        best = lambda cond, more: min([(d, 0, t) for d, t in near(i, -1) if cond(t)] + [(d + more, 1, t) for d, t in near(i, 1) if cond(t)], default=(0, 0, None))[2]  # noqa: B023, E731
        res = next((t for _, t in near(i, 1) if result(t) is not None or nil(t)), None)
        out.append(row(key, res, best(lambda t: fits(key, t), 0.25), best(unit, 0.15)))  # noqa: B023
    return out


def tokens(words):
    """words: (page, left, top, width, height, text)"""
    groups = []
    for page in sorted({w[0] for w in words}):
        mine = []
        for w in sorted((w for w in words if w[0] == page), key=lambda w: (w[2], w[1])):
            middle = w[2] + w[4] / 2
            for g in mine:
                if abs(middle - sum(x[2] + x[4] / 2 for x in g) / len(g)) <= max(5.5, w[4] * 0.75):
                    g.append(w)
                    break
            else:
                mine.append([w])
        groups += mine
    xs = {r: [] for r in cells.ROLES}
    for w in (w for g in groups for w in g):
        t, x = normal(w[5]), w[1] + w[3] / 2
        if detect(t):
            xs["test"].append(x)
            continue
        for r, yes in (("result", result(t) is not None), ("reference", range_of(t) is not None), ("unit", unit(t) is not None)):
            xs[r] += [x] * yes
        for r in cells.ROLES:
            xs[r] += [x] * sum(h in t.lower() for h in cells.HINTS[r])
    if not xs["test"]:
        return []
    bands = {r: median(xs[r]) for r in cells.ROLES if xs[r]}
    if "result" not in bands and "reference" in bands:
        bands["result"] = bands["test"] + abs(bands["reference"] - bands["test"]) / 2
    out = []
    for g in groups:
        at = {r: [] for r in cells.ROLES}
        for w in sorted(g, key=lambda w: w[1]):
            at[min(bands, key=lambda r: abs(w[1] + w[3] / 2 - bands[r]))].append(normal(w[5]))  # noqa: B023
        at = {r: " ".join(v) for r, v in at.items()}
        joined = " ".join(v for v in at.values() if v)
        texts = [*at.values(), ""]
        key = detect(at["test"]) or next((detect(v) for v in texts if detect(v)), None) or detect(joined)
        if key and not re.search("hemograma|denumire|rezultat", joined.lower()):
            out.append(fill(key, texts, at))
    return out


def merged(groups):
    """groups: lists of (key, value, range, unit, flag, confidence)"""
    best, order = {}, []

    def weight(r):
        none = r[0] in keys.NO_REFERENCE
        ok = r[2] is None if none else r[2] is None or compatible(keys.CBC_UNITS.get(r[0]), r[3])
        return r[5] + 0.8 * (r[1] is not None) + 0.55 * (r[2] is not None) + 0.2 * (r[3] is not None) + (0.25 if ok else -1)

    for r in (r for g in groups for r in g):
        if r[0] in keys.NO_REFERENCE:
            r = (r[0], r[1], None, r[3] or keys.CBC_UNITS[r[0]], None, r[5])
        k = normal_key(r[0])
        if k not in best:
            order.append(k)
        if k not in best or weight(r) > weight(best[k]) + 1e-9:
            best[k] = r
    place = {k: i for i, k in enumerate(keys.CBC_ORDER)}
    return [best[k] for k in sorted(order, key=lambda k: (place.get(k, 999), order.index(k)))]


def clean_string(t):
    for bad in ("\ufeff", "Â", "â€", "\ufffd"):
        t = t.replace(bad, "")
    t = re.sub(r"\s+", " ", re.sub("[−–—]", "-", t)).strip(" ;:")
    return t or None


def cbc_code(t):
    t = re.sub("[ .]", "", (clean_string(t) or "").upper()).replace("_", "-").replace("＃", "#").replace("％", "%")
    t = {"RDWSD": "RDW-SD", "RDWCV": "RDW-CV", "PLCR": "P-LCR", "P-LCR%": "P-LCR"}.get(t, t)
    return t if t in keys.CBC_UNITS else None


def standard(r):
    """A row (key, value, range, unit, flag, confidence) as it is stored; values, ranges and units are given in plain form."""
    key, value, range_, unit_, flag_, confidence = r
    if flag_ is None and value is not None and range_ is not None:
        low, high = map(float, range_.split(" - "))
        flag_ = "Low" if float(value) < low else "High" if float(value) > high else "Normal"
    if value is None or (range_ is None and flag_ == "Normal"):
        flag_ = None
    return (cbc_code(key) or clean_string(key), value, range_, unit_, flag_, confidence)


def stored(groups):
    best, order = {}, []

    def weight(r):
        return r[5] + 0.4 * (r[1] is not None) + 0.4 * (r[2] is not None) + 0.15 * (r[3] is not None) + 0.08 * (r[4] in ("High", "Low")) + 0.25 * (cbc_code(r[0]) is not None) + 0.05

    for r in (standard(r) for g in groups for r in g):
        k = f"cbc:{cbc_code(r[0])}".lower() if cbc_code(r[0]) else r[0].lower().strip()
        if k not in best:
            order.append(k)
        if k not in best or weight(r) >= weight(best[k]) - 1e-9:
            best[k] = r
    place = {f"cbc:{k}".lower(): i for i, k in enumerate(keys.CBC_ORDER)}
    return [best[k] for k in sorted(order, key=lambda k: (place.get(k, 999), order.index(k)))]


def gated(rows):
    counts, values = sum(cbc_code(r[0]) is not None for r in rows), [r for r in rows if r[1] is not None]
    return not rows or 0 < counts < 24 or len(rows) < 20 or not values or sum(r[2] is not None for r in values) < max(5, int(len(values) * 0.65))


def catalogue_name(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().replace("_", " ").replace(":", " ")
    return re.sub(" +", " ", re.sub(r"[^a-z0-9%+#./ -]", " ", t)).strip()


def as_word(hay, term):
    return re.search(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", hay) is not None


def definition(name, definitions):
    n, best = catalogue_name(name), (0, None, None)
    compact = lambda t: re.sub("[^a-z0-9%#]", "", t)
    for canonical, category, synonyms in definitions if n else []:
        for t in map(catalogue_name, [canonical, *synonyms]):
            score = 100 if n == t else 98 if compact(n) and compact(n) == compact(t) else 90 if len(t) >= 3 and as_word(n, t) else 75 if len(t) >= 4 and t in n else 65 if len(n) >= 4 and n in t else 0
            if score > best[0]:
                best = (score, canonical, category)
    return best[1:]


def category(context, words):
    t, best = catalogue_name(context), (0, None)
    if not t or any(catalogue_name(u) in t for u in cells.URINE):
        return None
    for name, listed in words.items():
        for w in map(catalogue_name, listed):
            score = 90 if as_word(t, w) else 70 if w in t else 0
            if score > best[0]:
                best = (score, name)
    return best[1]


def report(table_rows, words, ls, plain, whole, second, definitions, category_words):
    """(labs as (raw name, canonical, category, value, flag, range, unit), gated) of one report; second: rows with a category, or None."""
    of_text = lambda t, c: [(*r, c) for r in lines((t or "").splitlines())]
    firsts = merged([of_text(plain, 0.7), of_text(whole, 0.7), [(*r, 0.935) for r in lines(ls)], [(*r, 0.965) for r in tokens(words)], [(*r, 0.995) for r in table(table_rows)]])
    urine = lambda name: any(catalogue_name(u) in catalogue_name(name) for u in cells.URINE)
    firsts = [r for r in firsts if not urine(r[0])]
    help_ = gated(firsts)
    more = [r for r in second or [] if help_ and r[0] and not urine(r[0])]
    out, own = [], {(clean_string(r[0]) or "").lower(): r[6] for r in more}
    for key, value, range_, unit_, flag_, _ in stored([firsts, [r[:6] for r in more]]):
        if cbc_code(key):
            out.append((key, keys.CBC_LABELS.get(key, key), "Hematologie", value, flag_, range_, unit_))
            continue
        canonical, known = definition(key, definitions)
        context = " ".join(x for x in (whole, own.get(key.lower()) or "Alte analize") if x)
        out.append((key, canonical or key, known or category(context, category_words) or "Alte analize", value, flag_, range_, unit_))
    return out, help_
