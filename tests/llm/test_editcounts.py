import random

import numpy as np
from clinframe.llm import editcounts, textnum
from clinframe.llm.tokenfile import vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

hf = Tokenizer.from_file(vocabulary())
hf.encode_special_tokens = True
count = lambda t: len(hf.encode(t or "", add_special_tokens=False).ids)


def tree_of(text):
    chunk = textnum.Chunk([text])
    starts, ends = textnum.pretokens(chunk)
    pool = textnum.byte_bpe(vocabulary())
    return editcounts.Document(editcounts.new_tree(text, ends - starts, pool.count(chunk, starts, ends)), pool)


def plain(text, at, remove, insert):
    at = min(max(at or 0, 0), len(text))
    return text[:at] + (insert or "") + text[at + max(remove or 0, 0) :]


texts = st.text(alphabet=" '\nsdtmrevl.!1aé", max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(-1, 70), st.integers(0, 20), texts), max_size=5))
def test_edits_equal_fresh_counts(text, edits):
    doc = tree_of(text)
    for e in edits:
        doc.edit(*e)
        text = plain(text, *e)
        assert (doc.state()["text"], doc.toks[1], doc.chars[1]) == (text, count(text), len(text))


def test_long_document():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcde'\n .", k=rng.randint(1, 9))) for _ in range(3000))
    doc = tree_of(text)
    for k in range(60):
        e = (rng.randint(0, len(text)), rng.choice([0, 1, 30, 5000]), rng.choice(["", "x", " and 'll ", "word " * 3000]))
        before = doc.n_reencoded
        doc.edit(*e)
        text = plain(text, *e)
        assert doc.toks[1] == count(text) and sum(sum(x[2]) for x in doc.leaves) == doc.toks[1]
        assert doc.n_reencoded - before <= len(e[2]) + 12, k
    assert np.frombuffer(doc.state()["lengths"], "<u4").sum() == len(text)


def test_query(spark, sf_dir):
    docs = editcounts.sample_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    got = {r.doc_id: r for r in editcounts.op7_edit_counts(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        text = d.text or ""
        for e in d.edits:
            text = plain(text, e["at"], e["remove"], e["insert"])
        r = got[d.doc_id]
        assert (r.n_tokens_before, r.n_tokens, r.n_chars_after, r.n_edits) == (count(d.text), count(text), len(text), 3)
        assert r.n_reencoded <= 60


def test_edit_tables(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (2, None, None), (3, "left", ""), (None, "n", "")], "doc_id long, text string, tree string")
    edits = spark.createDataFrame([(1, 1, 0, 3, "1"), (1, 2, 2, 0, None), (2, None, None, None, "new"), (9, 1, 0, 0, "z"), (None, 1, 0, 0, "z")], "doc_id long, seq long, at long, remove long, insert string")
    got = editcounts.apply(editcounts.attach_edits(editcounts.build(docs), edits), tree="tree_").collect()
    assert sorted((r.doc_id or 0, r.tree_.text, r.tree_.token_sums[1]) for r in got) == [(0, "n", 1), (1, "1 two", count("1 two")), (1, "1 two", count("1 two")), (2, "new", 1), (3, "left", 1)]
    none = spark.createDataFrame([], docs.schema)
    assert editcounts.apply(editcounts.attach_edits(editcounts.build(none), edits), tree="tree_").count() == 0
