import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from clinframe.llm import sharding
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 6).flatmap(lambda n: st.tuples(st.lists(st.integers(0, 50), min_size=n * n, max_size=n * n), st.lists(st.integers(0, 40), min_size=n, max_size=n))))
def test_quotas(case):
    flat, free = case
    n = len(free)
    wanted = np.array(flat, np.int64).reshape(n, n)
    np.fill_diagonal(wanted, 0)
    moves, fillers = sharding.quotas(wanted, np.array(free))
    assert (moves >= 0).all() and (moves <= wanted).all() and (fillers >= 0).all()
    assert ((moves + fillers).sum(0) == (moves + fillers).sum(1)).all()
    assert (fillers.sum(1) <= free).all()


def lawful(rows, n=16):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_come_together(spark):
    rng = random.Random(1)
    rows = [(i, f"alone {i}") for i in range(900)]
    for g in range(120):
        rows += [(1000 + 10 * g + k, f"group {g}") for k in range(rng.randint(2, 6))]
    rows += [(5000 + k, "hot") for k in range(500)] + [(7000, None), (7001, None), (1000, "group 0"), (None, "group 1"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placement, members = sharding.shard(docs)
    got = placement.collect()
    lawful(got)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t or "") + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    whole = sum(len({r.shard for r in got if r.text_crc32 == zlib.crc32(f"group {g}".encode())}) == 1 for g in range(120))
    assert whole >= 108
    # A piece of the hot group fills half a shard; nearly all of its links are kept too.
    print("cut", sharding.cut_share(placement, members))
    assert sharding.cut_share(placement, members) < 0.25


def test_links(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in range(600)], "doc_id long, text string, shard string")
    links = spark.createDataFrame([(i, f"g{i // 3}") for i in range(150)] + [(9999, "g1"), (0, "g0")], "doc_id long, group string")
    placement, members = sharding.shard(docs, links)
    lawful(placement.collect())
    assert members.count() == 150 and sharding.cut_share(placement, members) < 0.1


def test_small_tables(spark):
    for n in (0, 1, 5, 17):
        docs = spark.createDataFrame([(i, "same") for i in range(n)], "doc_id long, text string")
        lawful(sharding.shard(docs)[0].collect())
    long = spark.createDataFrame([(1, "word " * 200_000), (2, "")], "doc_id long, text string")
    assert sorted(r.size for r in sharding.shard(long)[0].collect()) == [1, 1_000_001]


def test_query(spark, sf_dir):
    rows = sharding.op4_label_shards(spark, sf_dir).collect()
    lawful(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
