import hashlib
import random

import pytest
from clinframe.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def html(n, seed=0):
    return "".join(random.Random(seed).choices("<p>é \r\n0a;", k=n))


def want(rows):
    out = []
    for page, _, h, _ in rows:
        b = (h or "").encode()
        twins = [p for p, _, x, _ in rows if (x or "") == (h or "") and p is not None]
        revisit = len(b) >= 1000 and page != max(twins, default=page)
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(twins) if revisit else None, "ok"))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big = html(300_000, 1)
    rows = [(1, "http://a/ b", "", ""), (2, None, None, ""), (3, "u", html(999), ""), (4, "u", html(999), ""), (5, "u", "a" * 1000, ""), (6, "u", "a" * 1000, None), (7, "u", big, ""), (8, "u", big, ""), (8, "u", big, ""), (9, "u", html(40_000, 2), ""), (None, "u", html(70_000, 3), "")]
    rows += [(100 + i, "u", "z" * 1200, "") for i in range(50)]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), segment=3000, archive=20_000)
    assert manifest.count() > 6
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")) for r in warc.read_archives(manifest).collect()]
    assert sorted(got, key=str) == want(rows)


def test_empty(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.read_archives(manifest).collect() == []


def archive(tmp_path, spark, records):
    import zlib

    path = tmp_path / "x.warc.gz"
    packed = []
    for r in records:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed.append(c.compress(r) + c.flush())
    path.write_bytes(b"".join(packed))
    return spark.createDataFrame([(str(path), len(records), 0)], warc.MANIFEST)


def test_order_and_loss(spark, tmp_path):
    page = lambda n: list(warc.page_records(f"<urn:page:{n}:t>", n, "u", html(9000, n).encode(), hashlib.sha1(html(9000, n).encode()).digest(), None, 2000))
    records = page(1)[::-1] + page(2)[:-1] + page(3)[:2] + page(3)[3:] + page(4) + page(4)[1:2] + page(5)
    random.Random(0).shuffle(records)
    got = {r.page_id: r.status for r in warc.read_archives(archive(tmp_path, spark, records)).collect()}
    assert got == {1: "ok", 2: "incomplete", 3: "incomplete", 4: "incomplete", 5: "ok"}
    wrong = list(warc.page_records("<urn:page:7:t>", 7, "u", b"abc", hashlib.sha1(b"abd").digest(), None))
    assert [r.status for r in warc.read_archives(archive(tmp_path, spark, wrong)).collect()] == ["digest"]


def test_revisits_name_a_record_that_exists(spark, tmp_path):
    import re

    pages = spark.createDataFrame([(1, "http://a", "x" * 1500, ""), (2, "http://b", "x" * 1500, ""), (3, "http://c", "y", "")], SCHEMA)
    manifest = warc.write_archives(pages, str(tmp_path / "w"))
    heads = [h for m in manifest.collect() for h, _ in warc.parse_records(open(m.path, "rb").read())]
    ids = {h["warc-record-id"] for h in heads}
    assert len(ids) == 3 and [h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit"] == [True]
    assert all(re.fullmatch(r"<urn:page:\d+:[0-9a-f]{32}>", i) for i in ids)


def test_a_revisit_is_as_good_as_its_response(spark, tmp_path):
    body = b"z" * 1200
    sha = hashlib.sha1(body).digest()
    stored, other = warc.record_id(5, "u", sha.hex()), warc.record_id(6, "u", sha.hex())
    whole = lambda payload, id_=stored: list(warc.page_records(id_, 5, "u", payload, sha, None))
    back = lambda named: list(warc.page_records(warc.record_id(1, "u", sha.hex()), 1, "u", body, sha, named))
    status = lambda records: sorted((r.page_id, r.status) for r in warc.read_archives(archive(tmp_path, spark, records)).collect())
    assert status(whole(body) + back(stored)) == [(1, "ok"), (5, "ok")]
    assert status(whole(body) + back(other)) == [(1, "lost"), (5, "ok")]
    assert status(whole(b"y" * 1200) + back(stored)) == [(1, "lost"), (5, "digest")]


@pytest.mark.parametrize("body,payload", [
    (b"3\r\nabc\r\n0\r\n\r\n", b"abc"), (b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nT: 1\r\n\r\n", b"abc0123456789"), (b"0\r\n\r\n", b""),
    (b"3\r\nabcd\r\n0\r\n\r\n", None), (b"zz\r\n", None), (b"5\r\nab", None), (b"", None), (b"-1\r\n\r\n", None),
])
def test_chunks(body, payload):
    assert warc.unframe_chunks(body) == payload
    if payload is not None:
        assert warc.unframe_chunks(warc.frame_chunks(payload, 4)) == payload
