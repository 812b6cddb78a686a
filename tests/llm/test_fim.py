import hashlib
import random
import re

import pytest
from clinframe.llm import fim
from pyspark.sql import functions as F

UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
SCHEMA = "doc_id long, text string, form string, fim_text int, fim_units string"


def slow(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    letters = " \t\n\r\x0b\x0c ab<é😀  P>SM"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    return made + [None, "", " ", "\n\n", "one", " one ", "a <P> b", "<S", "x<M>", "<<P", "word " * 300_000, " " * 500_000, "x" * 500_000]


def test_against_slow_version(spark, texts):
    rows = [(i, t, "f", 7, "u") for i, t in enumerate(texts)] + [(None, "no id here", "f", 7, "u"), (3, texts[3], "f", 7, "u")]
    for seed, rate, spm in ((42, 50, 80), (7, 100, 50), (1, 0, 0)):
        out = fim.rearrange(spark.createDataFrame(rows, SCHEMA), seed, rate, spm)
        assert out.columns == ["doc_id", "form", "fim_text", "fim_units", "n_units", "form_", "prefix_chars", "middle_chars", "fim_text_"]
        back = out.withColumn("back", fim.restore(F.col("fim_text_"), F.col("form_"))).collect()
        assert len(back) == len(rows) and all((r.form, r.fim_text, r.fim_units) == ("f", 7, "u") for r in back)
        got = sorted(((str(r.doc_id), r.n_units, r.form_, r.prefix_chars, r.middle_chars, r.fim_text_) for r in back), key=str)
        assert got == sorted(((str(d), *slow(d, t, seed, rate, spm)) for d, t, *_ in rows), key=str)
        assert sorted((str(r.doc_id), r.back) for r in back) == sorted((str(d), t or "") for d, t, *_ in rows)
        if rate == 100:
            assert {r.form_ for r in back} == {"plain", "psm", "spm"}


def test_empty(spark):
    assert fim.rearrange(spark.createDataFrame([], SCHEMA)).collect() == []


def test_native_map(spark, sf_dir):
    plan = fim.op13_fim_units(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "[doc_id#" in plan
