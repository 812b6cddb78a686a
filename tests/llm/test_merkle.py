import hashlib
import random
import zlib
from itertools import groupby

import pytest
from clinframe.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash int, rank string, `group` string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    values = [None if v is None else str(v) for v in row[:5]]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def grown(nodes, fanout):
    """All levels of a tree and each leaf's siblings, level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, where in enumerate(at):
            run, k = runs[where // fanout], where % fanout
            steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, at = [H(*r) for r in runs], [x // fanout for x in at]
    return nodes[0], steps


def slow(rows, fanout=3):
    order = lambda s: (s is not None, (s or "").encode())
    ranked = sorted(rows, key=lambda r: (order(r[1]), r[0] is not None, r[0] or 0, leaf_of(r)))
    groups = [(s, list(g)) for s, g in groupby(ranked, key=lambda r: r[1])]
    trees = [grown([leaf_of(r) for r in g], fanout) for _, g in groups]
    if not trees:
        return []
    root, tops = grown([t[0] for t in trees], fanout)
    return [
        (r[0], s, i, leaf_of(r), below + top, subroot, root)
        for (s, g), (subroot, steps), top in zip(groups, trees, tops)
        for i, (r, below) in enumerate(zip(g, steps))
    ]


def got(df):
    return [(r.doc_id, r.source, r.position, r.leaf, [tuple(s) for s in r.steps], r.subroot, r.root) for r in df.collect()]


def same(spark, rows, fanout=3):
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).cache()
    assert sorted(got(made), key=str) == sorted(slow(rows, fanout), key=str)
    assert made.where("folded <> root").count() == 0
    made.unpersist()


def row(doc_id, source, text="t", lang="en", n_chars=1):
    return (doc_id, source, lang, n_chars, text, 1, "r", "g")


@pytest.mark.parametrize("bucket, height", [(4096, 6), (8, 2)])
def test_against_slow_version(spark, monkeypatch, bucket, height):
    monkeypatch.setattr(merkle, "BUCKET", bucket)
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(1)
    ids = [*range(40), *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)), -(1 << 63), (1 << 63) - 1, None, None]
    rows = [row(rng.choice(ids), rng.choice(["big", "big", "big", "a", "ä", "z\n", "", None, "big2"]), rng.choice([None, "", "x", "é\n" * 3, str(rng.random())]), rng.choice(["en", None]), rng.choice([0, -5, None])) for _ in range(700)]
    rows += [row(7, "big", "same")] * 60 + [row(8, "big", f"tie {i}") for i in range(60)] + [row(1, f"source {i:03}", "x") for i in range(30)]
    same(spark, rows)
    same(spark, rows[:200], 2)


def test_edges(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([row(None, None, None)], [row(1, "a"), row(1, "a"), row(1, None, "x" * 3_000_000)]):
        same(spark, rows)
    assert got(merkle.manifest(spark.createDataFrame([row(1, "a")], SCHEMA)))[0][4] == []


def test_what_is_changed_is_seen(spark, sf_dir):
    rows = {r.doc_id: r for r in merkle.op11_merkle_manifest(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for i, r in rows.items():
        assert r.verified == (zlib.crc32(str(i).encode()) % 2 == 1 or "\n" not in (texts[i] or "")) == (r.folded_root == r.root)
    assert {r.verified for r in rows.values()} == {True, False}
