import hashlib
import math

from clinframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, mix_parts int"


def drawn(doc_id, rate, seed=mixing.SEED):
    """The count that inverts the distribution, term by term."""
    parts = max(1, math.ceil(rate / mixing.PART_RATE))
    n = 0
    for j in range(1, parts + 1):
        name = "null" if doc_id is None else str(doc_id)
        u = (int(hashlib.md5(f"{seed}|{name}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = total = math.exp(-rate / parts)
        k = 0
        while total <= u and k <= mixing.TERMS:
            k += 1
            p *= rate / parts / k
            total += p
            n += 1
    return n


def expected(rows, rates):
    return sorted((str(r[0]), r[1], k) for r in rows for k in range(1, drawn(r[0], rates[r[2]]) + 1))


def got(df):
    return sorted((str(r.doc_id), r.text, r.copy_) for r in df.collect())


def rates_of(rows, weights=None, budget=1.0):
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len((r[1] or "").encode())
    w = weights or dict.fromkeys(size, 1.0)
    live = {s: n for s, n in size.items() if n}
    total, all_w = sum(live.values()), sum(w.get(s, 0.0) for s in live)
    return {s: budget * w.get(s, 0.0) / all_w * total / n if n else 0.0 for s, n in size.items()}


def test_against_inversion(spark):
    rows = [(i, "x" * (i % 7 + 1), "big" if i % 3 else "small", "c", 1) for i in range(300)] + [(500, "é", None, "c", 1), (501, None, "void", "c", 1), (502, "", "void", "c", 1), (None, "yy", "big", "c", 1), (5, "again", "big", "c", 1), (5, "again", "big", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.replicate(df)
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_parts", "copy_", "shuffle_key"]
    assert got(out) == expected(rows, rates_of(rows))
    weights = {"big": 3.0, "small": 1.0, None: 2.0, "other": 5.0}
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    assert got(mixing.replicate(df, table, 2.0)) == expected(rows, rates_of(rows, weights, 2.0))
    assert all(r.source != "void" for r in mixing.replicate(df).collect())


def test_high_rates_are_sums_of_parts(spark):
    rows = [(i, "x" * 2000, "big", "", 0) for i in range(40)] + [(1000 + i, "y" * 50, "small", "", 0) for i in range(20)]
    rates = rates_of(rows)
    assert rates["small"] > 2 * mixing.PART_RATE
    assert got(mixing.replicate(spark.createDataFrame(rows, SCHEMA))) == expected(rows, rates)


def test_order_and_repeatability(spark):
    rows = [(i, "x" * 9, "a" if i % 2 else "b", "", 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    once, again = mixing.replicate(df).collect(), mixing.replicate(df.repartition(7)).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))
    for part in mixing.replicate(df).rdd.glom().collect():
        keys = [r.shuffle_key for r in part]
        assert keys == sorted(keys)
    ids = [r.doc_id for r in sorted(once, key=lambda r: r.shuffle_key)]
    assert ids != sorted(ids)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.replicate(df).collect() == [] and mixing.replicate(df).columns[-1] == "shuffle_key"
    none = spark.createDataFrame([(1, None, "a", "", 0)], SCHEMA)
    assert mixing.replicate(none).collect() == []


def test_names_of_helpers_and_repeated_weights(spark, monkeypatch):
    rows = [(i, "x" * (i % 7 + 1), "big" if i % 3 else "small", i, f"s{i}", 7) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key0 long, _salt string, __salt int")
    want = None
    for most in (32 << 20, 0):
        monkeypatch.setattr(mixing.common, "BROADCAST_BYTES", most)
        out = mixing.replicate(df).collect()
        assert all((r._key0, r._salt, r["__salt"]) == (r.doc_id, f"s{r.doc_id}", 7) for r in out)
        assert sorted(r[:6] for r in out) == (want := want or sorted(r[:6] for r in out))
    once = spark.createDataFrame([("big", 3.0), ("small", 1.0)], "source string, weight double")
    twice = spark.createDataFrame([("big", 1.0), ("big", 2.0), ("small", 1.0)], "source string, weight double")
    assert sorted(mixing.replicate(df, once).collect()) == sorted(mixing.replicate(df, twice).collect())
