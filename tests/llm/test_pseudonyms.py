import datetime
import random
import re

import pytest
from clinframe.llm import pseudonyms as p
from hypothesis import given, settings
from hypothesis import strategies as st

F = p.Feistel(b"k")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 1000, 4097])
def test_permutation(n):
    out = [F.permute(i, n, "t") for i in range(n)]
    assert sorted(out) == list(range(n))
    assert n < 100 or out != [p.Feistel(b"other").permute(i, n, "t") for i in range(n)] != [F.permute(i, n, "u") for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 10**30), st.data())
def test_inside(n, data):
    assert 0 <= F.permute(data.draw(st.integers(0, n - 1)), n, "t") < n


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))


def run(text):
    return p.replace(F, text, {})


VALID = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "3782-822463-10005"], "account": ["5927243074273352", "123456789012"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "ssn": ["078-05-1120", "899-99-9999", "667-01-0001"],
    "phone": ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+49 30 901820", "+33612345678"], "ipv4": ["11.192.32.55", "255.255.255.255"],
    "date": ["2023-03-02", "02.03.2023", "2/3/2023", "12/31/1999", "31/12/1999"], "email": ["bosbt.42@mail8.example.com", "A.b+c@x.org"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALID.items() for v in vs])
def test_kinds(kind, value):
    text, spans = run(f"xé {value}, and {value}. {value}")
    assert [s["kind"] for s in spans] == [kind] * 3 and value not in text
    (new,) = {s["pseudonym"] for s in spans}
    assert text == f"xé {new}, and {new}. {new}"
    assert [(s["start"], s["length"]) for s in spans] == [(3, len(value)), (3 + len(value) + 6, len(value)), (3 + 2 * len(value) + 8, len(value))]
    if kind in ("card", "account", "ssn", "phone"):
        assert shape(new) == shape(value)
    # A pseudonym is valid in its format, and so found again as the same kind.
    if kind != "account":
        assert [s["kind"] for s in run(f"a {new} b")[1]] == [kind]


def test_links():
    both = lambda a, b: [re.sub("[^0-9]", "", run(x)[1][0]["pseudonym"]) for x in (a, b)]
    a, b = both("4111 1111 1111 1111", "4111111111111111")
    assert a == b and p.luhn_sum(a) % 10 == 0
    a, b = both("+1 (988) 555-2485", "988-555-2485")
    assert a[1:] == b and a[0] == "1"
    day = [datetime.datetime.strptime(run(x)[0], f).date() for x, f in (("2023-03-02", "%Y-%m-%d"), ("02.03.2023", "%d.%m.%Y"), ("02/03/2023", "%d/%m/%Y"))]
    assert len(set(day)) == 1
    assert run("X@mail.org")[0] == run("x@MAIL.org")[0].lower()


@pytest.mark.parametrize("text", ["", "no numbers", "version 1.2.3", "999.1.1.1", "2023-13-45", "000-12-3456 1", "30.02.2020", "1234", "a@b", "GB00WEST12345698765432x"])
def test_left_alone(text):
    assert run(text) == (text, [])


def test_linear_on_long_runs():
    rng = random.Random(1)
    for alphabet in ("1", "1-", "1.", "a@", "1 ", "A1 ", "+1 ("):
        run("".join(rng.choices(alphabet, k=200_000)))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = p.op5_feistel_pii(spark, sf_dir).collect()
    key = p.Feistel(p.QUERY_KEY.encode())
    assert len(rows) == len(texts) and sum(r.n_email + r.n_phone for r in rows) > 0
    plain = {}
    for r in rows:
        new, spans = p.replace(key, texts[r.doc_id], {})
        assert r.text == new and sum(tuple(r)[2:]) == len(spans)
        for s in spans:
            old = texts[r.doc_id][s["start"] : s["start"] + s["length"]]
            assert plain.setdefault((s["kind"], old), s["pseudonym"]) == s["pseudonym"]
    assert len({(k[0], v) for k, v in plain.items()}) == len({(k[0], k[1].lower() if k[0] == "email" else k[1]) for k in plain})


def test_small_tables(spark):
    schema = "doc_id long, text string, private string"
    assert p.annotate(spark.createDataFrame([], schema), "k").count() == 0
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "call 988-555-2485 " * 20_000, "y")]
    got = p.annotate(spark.createDataFrame(rows, schema), "k").collect()
    assert sorted(len(r.private_.spans) for r in got) == [0, 0, 0, 20_000]
    assert [r.private_.text for r in got[:3]] == [None, "", ""] and [r.private for r in got] == ["x", None, None, "y"]


@pytest.mark.parametrize("value", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"])
@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " EUR 250", " 2024-01-01", " 250", " Bank", ". Next", " BIC COBADEFFXXX EUR 1000 PAID"])
def test_iban_before_words_and_numbers(value, after):
    text, spans = run(f"IBAN {value}{after}")
    assert (spans[0]["kind"], spans[0]["start"], spans[0]["length"]) == ("iban", 5, len(value))
    assert spans[0]["pseudonym"] == run(value)[1][0]["pseudonym"] and value not in text


@pytest.mark.parametrize("value", ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "5555 5555 5555 4444"])
@pytest.mark.parametrize("before,after", [("", " 12/25"), ("", " 123"), ("", " 12 25"), ("", "-123"), ("", " 7"), ("12 ", ""), ("7 ", " 12/25"), ("", " 012")])
def test_card_beside_other_digits(value, before, after):
    text, spans = run(f"no {before}{value}{after}")
    assert [(s["kind"], s["start"], s["length"]) for s in spans] == [("card", 3 + len(before), len(value))]
    assert spans[0]["pseudonym"] == run(value)[1][0]["pseudonym"] and text == f"no {before}{spans[0]['pseudonym']}{after}"


def test_other_runs_stay_whole():
    assert [(s["kind"], s["length"]) for s in run("5927243074273352 12")[1]] == [("account", 19)]
    assert [(s["kind"], s["length"]) for s in run("+49 30 90182012 12345 12345 x")[1]] == [("phone", 15)]
