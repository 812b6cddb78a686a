import random
import zlib

import numpy as np
import pytest
from clinframe.llm import huffman, textnum, tokenfile
from hypothesis import given, settings
from hypothesis import strategies as st

CASES = ["", " ", "  a", "a  b", "don't 'scorn' they're we'll I'd 's's 'sx ''s", "a\n\n b\t\tc \n", "日本語 ß x²½ ٣٤", "  'll x  \n 've", "x" * 300 + " 'd", "  z 　", "!?'re .'s", "a 's b\n's", "<|endoftext|> é", "'", "a'", "it'll'veok"]


def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.vocabulary())
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\nsdtmrevl.!1aé "), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=40), max_size=6))
def test_same_as_library(texts):
    pool, t = textnum.byte_bpe(tokenfile.vocabulary()), hf_cached()
    for mine, text in zip(tokenfile.encode_texts(pool, texts, 0), texts):
        assert mine.tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


_held = []


def hf_cached():
    if not _held:
        _held.append(hf())
    return _held[0]


def test_cases():
    pool, t = textnum.byte_bpe(tokenfile.vocabulary()), hf_cached()
    for mine, text in zip(tokenfile.encode_texts(pool, CASES, 0), CASES):
        assert mine.tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], text


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (40, 6), (64, 6), (3000, 16), (50000, 16)])
def test_codes(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.4, n) * 3).astype(np.int64).clip(1, 10**14)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and lengths.min() >= 1
    kraft = (2.0 ** -lengths.astype(float)).sum()
    assert kraft <= 1 and (n < 2 or kraft == 1)
    if n <= 64:
        assert (counts * lengths).sum() == best_cost(sorted(counts.tolist()), limit)


def best_cost(weights, limit):
    """Package-merge in its set form, with the items written out."""
    n = len(weights)
    if n == 1:
        return weights[0]
    level = sorted((w, [i]) for i, w in enumerate(weights))
    packages = level
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(packages[::2], packages[1::2])]
        packages = sorted(level + pairs, key=lambda x: x[0])
    return sum(w for w, _ in packages[: 2 * n - 2])


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(0.5, n) * 10).astype(np.int64).clip(0, 50000)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1))
    bits, marks = huffman.encode(ids, lengths, huffman.canonical_codes(lengths), 512)
    assert (huffman.decode(bits, n, marks, 512, huffman.decode_table(lengths)) == ids).all()


def test_more_ids_than_sixteen_bits_hold():
    for used in (65_536, 65_537, 200_000):
        rng = np.random.default_rng(used)
        ids = np.concatenate([np.arange(used), (rng.pareto(0.6, 50_000) * 10).astype(np.int64).clip(0, used - 1)])
        limit = huffman.bits_for(used)
        lengths = huffman.code_lengths(np.bincount(ids))
        assert lengths.max() <= limit == (16 if used == 65_536 else 18 if used == 65_537 else 19)
        bits, marks = huffman.encode(ids, lengths, huffman.canonical_codes(lengths), 512)
        assert (huffman.decode(bits, len(ids), marks, 512, huffman.decode_table(lengths, limit)) == ids).all()


def test_one_id_for_many_texts(spark, tmp_path):
    """Rows under one id, or none, are dealt by their texts too, in the stated order."""
    rows = [(None if i % 2 else 5, f"text {i:03}") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "t" / "blocks")).select("part").distinct().count() > 2
    got = tokenfile.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [hf_cached().decode(r.ids[:-1]) for r in got] == [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[1]))]


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in tokenfile.op2_huffman_tokens(spark, sf_dir).collect()}
    t, start = hf_cached(), 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_small_tables(spark, tmp_path):
    schema = "doc_id long, text string, ids string, bits int"
    assert tokenfile.round_trip(spark.createDataFrame([], schema)).collect() == []
    rows = [(3, None, "x", 1), (1, "", "x", 1), (1, "a b", None, None), (None, "z", "x", 1), (1, "a b", None, None), (7, "word " * random.Random(1).randint(50000, 60000), "", 0)]
    got = sorted((r.doc_id or -1, r.start, r.n_tokens) for r in tokenfile.round_trip(spark.createDataFrame(rows, schema)).collect())
    assert [g[:2] for g in got] == [(-1, 0), (1, 2), (1, 3), (1, 6), (3, 9), (7, 10)]
    tokenfile.write(spark.createDataFrame(rows, schema), str(tmp_path / "t"))
    whole = {r.start: r.ids for r in tokenfile.read(spark, str(tmp_path / "t")).collect()}
    assert whole[9] == [0] and hf_cached().decode(whole[3][:-1]) == "a b"
