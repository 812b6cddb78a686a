import base64
import math
import random
import re
import string
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from clinframe.llm import quality, textnum
from hypothesis import given, settings
from hypothesis import strategies as st


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def measured(text):
    got = quality.measure([text or ""], [None], quality.Rules())
    return tuple(got[n][0] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t|é \x1c\x85", max_size=80))
def test_base_counts(text):
    assert measured(text) == base(text)


def test_measures_are_the_vocabulary_s():
    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = "Das ist ein Satz über Größe, 日本 zzz ist ein"
    ids = [i for w in text.split() for i in s.encode(w)]
    got = quality.measure([text], [None], quality.Rules())
    n, c = len(ids), Counter(ids)
    assert got["chars_per_piece"][0] == pytest.approx(sum(map(len, text.split())) / n)
    assert got["byte_share"][0] == pytest.approx(sum(s.is_byte(i) for i in ids) / n)
    assert got["piece_entropy"][0] == pytest.approx(-sum(v / n * math.log2(v / n) for v in c.values()))


@pytest.mark.parametrize("text,kept", [
    ("The committee met on a rainy Tuesday and agreed to publish its findings before the end of the month.", True),
    ("Le conseil municipal a décidé hier soir de rénover la vieille bibliothèque avant la fin de cette année.", True),
    ("Правительство вчера объявило о новых правилах для школ и больниц во всех крупных городах страны.", True),
    ("".join(chr(0xE000 + i) + " " * (i % 3 == 0) for i in range(60)), None),
    ("\x01\x02\x03\x04\x05 " * 3 + "".join(chr(1 + i % 8) + " " for i in range(40)), False),
    ("a b", False),
])
def test_verdicts(text, kept):
    got = quality.measure([text], [None], quality.Rules())
    assert kept is None or bool(got["kept"][0]) == kept


def test_scripts():
    texts = ["plain", "Ελληνικά λόγια", "текст", "日本語", "हिन्दी", "עברית", ""]
    chunk = textnum.Chunk(texts)
    assert [quality.SCRIPTS[i] for i in quality.scripts(chunk, len(texts))] == ["Latin", "Greek", "Cyrillic", "East Asian", "Indic", "Semitic", "Latin"]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = quality.op1_fertility(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_small_tables(spark):
    schema = "doc_id long, text string, quality string"
    assert quality.annotate(spark.createDataFrame([], schema)).columns == ["doc_id", "text", "quality", "quality_"]
    assert quality.annotate(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "word " * 100_000, "y")]
    got = quality.annotate(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.quality_.n_words for r in got) == [0, 0, 0, 100_000]
    assert quality.keep_good(spark.createDataFrame(rows, schema)).count() == 0


def junk():
    rng = random.Random(7)
    pick = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(200))
    blob = base64.b64encode(rng.randbytes(3000)).decode()
    return {"base64": "\n".join(blob[i : i + 76] for i in range(0, len(blob), 76)), "lower": pick(string.ascii_lowercase), "alphanumeric": pick(string.ascii_letters + string.digits)}


@pytest.mark.parametrize("kind,lang", [(k, lang) for k in ("base64", "lower", "alphanumeric") for lang in ("en", "de", "fr", "es", "pl", None)])
def test_junk_is_rejected(kind, lang):
    got = quality.measure([junk()[kind]], [lang], quality.Rules())
    assert not got["base_failed"][0] and not got["kept"][0]


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_bands_tell_clean_prose_from_its_garbled_copies(spark, lang):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.where(f"lang = '{lang}' AND n_chars BETWEEN 300 AND 20000").join(labels.where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(40).collect()
    texts = [r.text for r in rows]
    verdicts = lambda t: (lambda got: got["kept"][~got["base_failed"]])(quality.measure(t, [lang] * len(t), quality.Rules()))
    assert len(verdicts(texts)) > 5 and verdicts(texts).all()
    for symbols in ("***", "$$$", "%%%", "###", "&&&"):
        assert not verdicts([re.sub(r"(\S)(?=\s)", rf"\1{symbols}", t) for t in texts]).any()
    if lang == "fr":
        assert not verdicts([t.encode().decode("latin-1") for t in texts]).any()


@pytest.mark.parametrize("lang,text", [
    ("en", "The committee met on a rainy Tuesday and agreed to publish its findings before the end of the month."),
    ("fr", "Le conseil municipal a décidé hier soir de rénover la vieille bibliothèque avant la fin de cette année."),
    ("de", "Die Stadtverwaltung hat gestern beschlossen, die alte Bücherei noch vor dem Ende des Jahres gründlich zu renovieren."),
    ("es", "El ayuntamiento decidió ayer por la noche renovar la antigua biblioteca antes de que termine este año."),
    ("vi", "Hội đồng thành phố tối qua đã quyết định sửa chữa thư viện cũ trước khi kết thúc năm nay."),
    ("lv", "Pilsētas dome vakar vakarā nolēma atjaunot veco bibliotēku vēl pirms šī gada beigām un atvērt to no jauna."),
])
def test_clean_prose_is_kept(lang, text):
    assert quality.measure([text], [lang], quality.Rules())["kept"][0]
