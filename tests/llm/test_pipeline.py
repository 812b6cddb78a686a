import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from clinframe.llm import mixing, quality, tokenfile
from tokenizers import Tokenizer

from test_decontam import brute as contaminated
from test_neardups import brute as near
from test_quality import base


def unit(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    verdicts = quality.measure([r.text for r in rows.values()], [r.lang for r in rows.values()], quality.Rules())["kept"]
    want = {i for i, kept in zip(rows, verdicts) if kept}
    assert want and not any(base(rows[i].text)[-1] for i in want)
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, frame, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            want = {i for i, _, c in near([(i, rows[i].text) for i in sorted(want)]) if i == c}
        elif k == 2:
            want = {i for i in want if not contaminated(rows[i].text, items)[-1]}
        got = [r.doc_id for r in frame.collect()]
        assert len(got) == len(set(got)) and set(got) == want, k
    sizes = defaultdict(int)
    for i in want:
        sizes[rows[i].source] += len(rows[i].text.encode())
    total = sum(sizes.values())
    copies = Counter({i: poisson(total / len(sizes) / sizes[rows[i].source], unit(mixing.SEED, i, 1)) for i in want})
    mixed = corpus_pipeline.STAGES[3][1](spark, frame, sf_dir)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    mixed.write.parquet(str(tmp_path / "3"))
    t = Tokenizer.from_file(tokenfile.vocabulary())
    t.encode_special_tokens = True
    expected, start = [], 0
    # The file's order is that of the mixture's files, in which copies don't stand side by side.
    order = [r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert Counter(order) == +copies and order != sorted(order)
    for i in order:
        ids = [*t.encode(rows[i].text, add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    last = corpus_pipeline.STAGES[4][1](spark, spark.read.parquet(str(tmp_path / "3")), sf_dir)
    assert [tuple(r) for r in last.orderBy("start").collect()] == expected
    run = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in run) == sorted((i, n, c) for i, _, n, c in expected)
    assert [r.start for r in run] == [sum(r.n_tokens for r in run[:k]) for k in range(len(run))]
