import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from clinframe.llm import neardups


def distribution(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    k = min(5, len(w))
    c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()
    n = sum(c.values())
    return {s: v / n for s, v in c.items()}


def similarity(p, q):
    both = p.keys() & q.keys()
    if sum(min(p[d], q[d]) for d in both) < 0.7:
        return 0.0  # no term is above min(p, q)
    every = p.keys() | q.keys()
    return sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in every) for d in both)


def slow(p, q):
    return sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in p.keys() | q.keys()) for d in p.keys() & q.keys())


def brute(rows):
    """(doc_id, copy_of, class_id) by comparing all pairs."""
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    rep = {t: min(ids) for t, ids in texts.items()}
    parent = {r: r for r in rep.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    dist = {t: distribution(t) for t in rep}
    for x, y in combinations(rep, 2):
        if dist[x].keys() & dist[y].keys() and similarity(dist[x], dist[y]) >= 0.8 - 1e-9:
            a, b = sorted((root(rep[x]), root(rep[y])))
            parent[b] = a
    return sorted((i, rep[t or ""], root(rep[t or ""])) for i, t in rows)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in neardups.find(df).collect())


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_exact_similarity():
    rng = random.Random(1)
    for _ in range(60):
        a, b = words(rng, rng.randint(1, 40), 3), words(rng, rng.randint(1, 40), 3)
        b = a[: rng.randint(0, len(a))] + b
        of, h, c = neardups.shingles([" ".join(a), " ".join(b)])
        parts = [(np.sort(h[of == k]), c[of == k][np.argsort(h[of == k])]) for k in (0, 1)]
        assert neardups.probability_jaccard(*parts) == pytest.approx(slow(distribution(" ".join(a)), distribution(" ".join(b))))


def exact(texts):
    return neardups.probability_jaccard(*[(np.unique(h), c[np.argsort(h)]) for _, h, c in (neardups.shingles([t]) for t in texts)])


def test_registers_estimate():
    rng = random.Random(2)
    errors = []
    for k in range(40):
        a = words(rng, 200, 20)
        b = a[: 50 + 3 * k] + words(rng, 60, 20)
        texts = [" ".join(a), " ".join(b)]
        r = neardups.registers(2, *neardups.shingles(texts))
        errors.append((r[0] == r[1]).mean() - exact(texts))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows, base = [], [words(rng, n) for n in (3, 5, 12, 40, 90)]
    for i in range(120):
        w = list(rng.choice(base)) if i % 3 else words(rng, rng.randint(1, 80))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (5, rows[5][1]), (203, rows[9][1]), (204, "x"), (205, "X")]
    assert found(spark, rows) == brute(rows)


def test_large_group(spark):
    """Near copies of one text, many of them, in one component though the outer ones differ."""
    rng = random.Random(4)
    w = words(rng, 80, 10**6)
    rows = []
    for i in range(100):
        v = list(w)
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    rows += [(1000 + i, " ".join(words(rng, 60, 10**6) + w[:60])) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in neardups.op3_probminhash(spark, sf_dir).collect())
    assert got == brute(rows) and any(c != d for d, _, c in got)


def test_keep_one(spark):
    schema = "doc_id long, text string, class_id string, h int"
    assert neardups.keep_one(spark.createDataFrame([], schema)).collect() == []
    rows = [(2, "a b c d e f", "x", 1), (1, "a b c d e f", None, 2), (1, "a b c d e f", None, 2), (3, "other words", "", 3), (None, "alone", "", 4), (4, None, "", 5), (5, "", "", 6), (6, "z " * 100_000, "", 7)]
    got = neardups.keep_one(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "class_id", "h"]
    assert sorted(r.h for r in got.collect()) == [2, 3, 4, 5, 7]


def test_null_and_repeated_ids_are_judged_by_text(spark):
    rng = random.Random(5)
    a, b, c = (words(rng, 60, 10**6) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "changed"])
    schema = "doc_id long, text string, h int"
    unlike = [(None, " ".join(words(rng, 30, 10**6)), 10 + i) for i in range(5)] + [(7, " ".join(words(rng, 30, 10**6)), 20 + i) for i in range(3)]
    rows = [(None, " ".join(a), 0), (None, " ".join(b), 1), (1, near(a), 2), (2, near(b), 3), (3, " ".join(c), 4), (8, near(c), 5), (8, "quite another text of one id", 6), (None, " ".join(a), 0), *unlike]
    got = sorted(r.h for r in neardups.keep_one(spark.createDataFrame(rows, schema)).collect())
    assert got == [0, 1, 4, 6, *range(10, 15), *range(20, 23)]
    both = Counter(tuple(r) for r in neardups.find(spark.createDataFrame(rows, schema)).collect())
    assert both[8, 8, 3] == both[8, 8, 8] == both[1, 1, None] == both[2, 2, None] == 1 and both[7, 7, 7] == 3


def test_blocks_of_a_torn_bucket(spark, monkeypatch):
    """Two hubs with near copies around them, all in the same buckets: what the pivots leave is compared in blocks."""
    monkeypatch.setattr(neardups, "BLOCK", 7)
    rng = random.Random(6)
    w = words(rng, 100, 10**6)
    rows = []
    for i in range(90):
        v = list(w)
        for _ in range(rng.randint(0, 6)):
            v[rng.randrange(len(v))] = f"n{rng.randrange(30)}"
        rows.append((i, " ".join(v)))
    assert found(spark, rows) == brute(rows)
    few = neardups._close(0.8)(iter([]))
    assert list(few) == []


def test_keep_one_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, "x"), (2, "a b c d e f", 3, 4, "y"), (2, "a b c d e f", 3, 4, "y")], "doc_id long, text string, kept_n int, rep int, KEPT_ID string")
    got = neardups.keep_one(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", 1, 2, "x")]


def test_members_are_shuffled_once(spark):
    """What blocks of one bucket are compared from: each member is in one file, whatever the number of blocks."""
    import pyarrow as pa

    rng = random.Random(7)
    base = rng.randbytes(neardups.LONG_REGISTERS)
    rows = []
    for i in range(40):
        sketch = bytearray(base)
        for _ in range(rng.randint(0, 160)):
            sketch[rng.randrange(len(sketch))] = rng.randrange(256)
        rows.append({"h": 1, "rep": i, "label": i % 30, "band": 0, "short": b"\1" * neardups.REGISTERS, "long_sketch": bytes(sketch)})
    schema = pa.schema([("h", pa.int64()), ("rep", pa.int64()), ("label", pa.int64()), ("band", pa.int32()), ("short", pa.binary()), ("long_sketch", pa.binary())])
    least = neardups.least_agreement(0.8)
    whole = neardups.Members(pa.Table.from_pylist(rows, schema))
    halves = [neardups.Members(pa.Table.from_pylist(rows[a::2], schema)) for a in (0, 1)]
    want = {(a["rep"], b["rep"]) for a in rows for b in rows if a["rep"] < b["rep"] and a["label"] != b["label"] and sum(x == y for x, y in zip(a["long_sketch"], b["long_sketch"])) >= least}
    assert set(map(tuple, whole.close(whole, least).tolist())) == want and 0 < len(want) < 780
    parts = [halves[0].close(halves[0], least), halves[1].close(halves[1], least), halves[0].close(halves[1], least)]
    assert sorted(map(tuple, (p for x in parts for p in x.tolist()))) == sorted(want)
