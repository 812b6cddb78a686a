import hashlib
import random
import re

import numpy as np
from clinframe.llm import decontam
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for name, t in items:
        v = words(t)
        k = min(window, len(v))
        if not k:
            continue
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(name)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(s):
    assert decontam.suffix_array(np.array(s, np.int64) + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def check(spark, docs, items, **kw):
    rows = decontam.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **kw)
    cols = [e.alias(n) for n, e in decontam.verdict("found").items()]
    got = sorted(tuple(r)[1:] for r in rows.select("doc_id", *cols).collect())
    named = [("null" if i is None else str(i), t) for i, t in items]
    assert got == sorted(brute(t, named, kw.get("window", 13)) for _, t in docs)
    return rows


def test_random(spark):
    rng = random.Random(3)
    vocab = ["ab", "Cd", "é", "x1", "zz", "q"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(12)] + [(None, "ab zz q"), (3, "q q q q")]
    docs = [(i % 50, text(rng.choice([0, 1, 4, 30, 200]))) for i in range(120)] + [(5, None), (None, "ab"), (7, "")]
    docs += [(60, docs[4][1])] * 5
    check(spark, docs, items, window=4)
    check(spark, docs, items, window=4, block_words=10)


def test_longest_matches(spark):
    v = [f"w{i}" for i in range(40)]
    docs = [(1, "start here " + " ".join(v[5:35]) + " end"), (2, " ".join(v[:12])), (3, "nothing")]
    rows = check(spark, docs, [(9, " ".join(v))])
    spans = {r.doc_id: [tuple(s) for s in r.found.spans] for r in rows.collect()}
    assert spans == {1: [("9", 5, 2, 30)], 2: [], 3: []}


def test_empty(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b")], [])
    check(spark, [(1, "a b"), (2, "word " * 200_000)], [(1, "word")])
    clash = spark.createDataFrame([(1, "a", "f")], "doc_id long, text string, found string")
    assert decontam.remove_contaminated(clash, spark.createDataFrame([(1, "b")], "item_id long, text string")).collect() == clash.collect()


def test_query(spark, sf_dir):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = decontam.op9_suffix_decontam(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        assert tuple(r)[1:] == brute(texts[r.doc_id], items)


def naive_spans(doc, items, window):
    """All maximal equal runs of `window` words or more (or of a whole shorter item), by comparing every diagonal."""
    d, out = words(doc), set()
    for name, text in items:
        w = words(text)
        least = min(window, len(w))
        for shift in range(-len(w), len(d)):
            run = 0
            for i in range(len(w) + 1):
                if i < len(w) and 0 <= i + shift < len(d) and w[i] == d[i + shift]:
                    run += 1
                    continue
                if least and run >= least:
                    out.add((name, i - run, i - run + shift, run))
                run = 0
    return out


def test_spans_of_shared_passages(spark):
    """Items that share passages, at different places and of different lengths."""
    rng = random.Random(8)
    passage = [[f"p{k}x{i}" for i in range(9)] for k in range(4)]
    text = lambda: " ".join(w for _ in range(rng.randint(0, 4)) for w in (rng.choice(passage)[rng.randint(0, 3) :] if rng.random() < 0.8 else [f"z{rng.randrange(5)}"]))
    items = [(f"i{k:02d}", text()) for k in range(25)]
    docs = [(i, text()) for i in range(40)]
    found = decontam.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=4).collect()
    for r in found:
        assert {tuple(s) for s in r.found.spans} == naive_spans(r.text, items, 4)
        assert len({tuple(s) for s in r.found.spans}) == len(r.found.spans)


def test_hot_passage_and_one_pass(spark):
    """A passage that many items and many texts share costs rows for texts only; many blocks are one scan of the texts."""
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(i, f"{passage} own{i} tail") for i in range(200)]
    tests = decontam.Tests([str(i) for i, _ in items], [t for _, t in items], 13)
    texts = [f"t{i} {passage} end" for i in range(300)] + ["other words"]
    raw = [t.encode() for t in texts]
    shard = decontam.Shard(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 13)
    hits, chains, matches = shard.search(tests, False)
    assert len(chains[0]) == 300 and len(matches[0]) == 0 and len(hits[0]) == 300 * 8
    docs = list(enumerate(texts)) + [(900, " ".join(f"{passage} own{i}" for i in range(3)))]
    rows = check(spark, docs, items, block_words=100)
    assert decontam.prepared(spark.createDataFrame(items, "item_id long, text string"), 13, 100)[1] > 40
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    lean = decontam.annotate(rows.drop("found"), spark.createDataFrame(items, "item_id long, text string"), spans=False, keep=["doc_id"], block_words=100)
    assert lean.columns == ["doc_id", "found"]
    cols = [e.alias(n) for n, e in decontam.verdict("found").items()]
    assert sorted(lean.select("doc_id", *cols).collect()) == sorted(rows.select("doc_id", *cols).collect())
