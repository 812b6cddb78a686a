"""WARC archives of pages: writing with segmentation, and reassembly.

write_archives() makes a record of every page: an HTTP response whose body is sent in chunks, its block cut into
segments of at most SEGMENT bytes. The first segment is the response record; continuation records follow with
the origin's record id and their number, the last one with the total length. Each record is a gzip member; a task
rolls on to a next archive beyond ARCHIVE bytes, so segments of one record may lie in several archives. Of pages
with equal payloads of at least REVISIT bytes, the one with the largest page_id is stored and the others are
revisit records that name its record id. A record's id is made of its page id, payload and address, so that a revisit can
name a record that another task writes.

read_archives() parses archives in parallel, puts segments together by origin id and number, verifies that none is
missing or doubled and that the lengths add up to the total, removes the chunk framing, and compares the digest. A revisit is held against the response that it names.

Archives are named by task attempt, and the manifest holds those of the attempts that ended well, so a lost executor
leaves no archive that is read. They are written and read through pyarrow.fs, which must know the scheme of the
folder. A task holds one archive at a time. Spark moves page texts at most once (not at all where the payloads that
occur twice are few enough to broadcast).

Defined cases: a null html is an empty payload; null page ids are kept as null; repeated rows get records of
their own, and those with the largest id of their payload are all responses; rows that are equal in all columns have equal record ids,
and are told apart by how often each of their segments occurs; empty tables give an empty manifest;
columns other than page_id, url and html aren't read. status says what is wrong with a record: ok, incomplete (a
segment is missing or the total differs), malformed (framing), digest (payload differs, for a revisit from that of its response)
or lost (the response that a revisit names is missing or not ok).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import common

SEGMENT = 32 << 10
CHUNK = 8 << 10
ARCHIVE = 16 << 20
REVISIT = 1000
MANIFEST = "path string, records long, bytes long"
PART = "origin string, segment int, total long, warc_type string, page_id long, uri string, refers string, payload_bytes long, payload_digest string, status string, block binary"
RECORD = "origin string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string, uri string, status string"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def frame_chunks(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unframe_chunks(body: bytes) -> bytes | None:
    """The body without its chunk framing (extensions and trailers are skipped); None if it is malformed."""
    out, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        if line_end < 0:
            return None
        digits = body[at:line_end].split(b";")[0].strip()
        try:
            size = int(digits, 16)
        except ValueError:
            return None
        at = line_end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def record_id(page_id: int | None, uri: str, digest: str) -> str:
    return f"<urn:page:{page_id}:{digest[:24]}{zlib.crc32(uri.encode()):08x}>"


def address(page_id: int | None, url: str | None) -> str:
    return "".join((url or "").split()) or f"urn:page:{page_id}"


def page_records(record_id: str, page_id: int | None, uri: str, payload: bytes, sha1: bytes, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The WARC records of one page."""
    common_ = [("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()), ("WARC-Payload-Length", len(payload))]
    typed = [("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common_, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to), *typed], HTTP_REVISIT)
        return
    block = HTTP + frame_chunks(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    number = [("WARC-Segment-Number", 1)] if len(pieces) > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common_, *number, *typed], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        total = len(block) if i == len(pieces) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}:{i}>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], piece)


def _write(folder: str, segment: int, archive: int):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = common.filesystem(folder)
        task = TaskContext.get()
        name, held, size, n, done = f"{task.partitionId():06d}-{task.taskAttemptId()}", [], 0, 0, []

        def close():
            nonlocal held, size, n
            file = f"pages-{name}-{len(done):05d}.warc.gz"
            with filesystem.open_output_stream(f"{base}/{file}", compression=None) as out:
                for x in held:
                    out.write(x)
            done.append((f"{folder}/{file}", n, size))
            held, size, n = [], 0, 0

        for batch in batches:
            for page_id, url, payload, digest, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                uri = address(page_id, url)
                stored = None if refers is None else record_id(refers, address(refers, refers_url), digest)
                for r in page_records(record_id(page_id, uri, digest), page_id, uri, payload, bytes.fromhex(digest), stored, segment):
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    held.append(packer.compress(r) + packer.flush())
                    size, n = size + len(held[-1]), n + 1
                    if size >= archive:
                        close()
        if held:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema)

    return run


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to and refers_url: the page that stores an equal payload, null for stored ones."""
    html = common.text_or_empty(pages, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    twice = rows.where(F.col("size") >= REVISIT).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = common.materialise(twice, "warc-twice")
    found = common.bounded_join(rows, twice, ["digest", "size"], F.xxhash64("page_id"), twice.count(), 80)
    other = F.col("stored").isNotNull() & ~F.col("stored.page_id").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "payload", "digest", F.when(other, F.col("stored.page_id")).alias("refers_to"), F.when(other, F.col("stored.url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """Write the archives of pages (page_id, url, html); their manifest, kept as a table in the folder."""
    filesystem, base = common.filesystem(folder)
    filesystem.create_dir(base, recursive=True)
    with_revisits(pages).mapInArrow(_write(folder, segment, archive), MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(data: bytes) -> Iterator[bytes]:
    """Gzip members one by one, without copying the rest of the archive for each."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, out, step = zlib.decompressobj(31), [], 4096
        while not unpacker.eof and at < len(view):
            piece = view[at : at + step]
            out.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        yield b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip archive."""
    for raw in members(data):
        at = 0
        while raw[at : at + 5] == b"WARC/":
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(headers.get("content-length", 0))
            yield headers, raw[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def payload_of(block: bytes, digest: str | None) -> tuple[int | None, str | None, str]:
    """Length and SHA-1 of the payload in an HTTP block, and the status; digest is what the record promised."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None, None, "malformed"
    if b"transfer-encoding: chunked" in head.lower():
        body = unframe_chunks(body)
        if body is None:
            return None, None, "malformed"
    found = hashlib.sha1(body).hexdigest()
    return len(body), found, "ok" if digest in (None, found) else "digest"


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").split(":")
    return int(name[2]) if name[:2] == ["urn", "page"] and name[2:3] != ["None"] else None


def _promised(headers: dict[str, str]) -> str | None:
    kind, _, value = headers.get("warc-payload-digest", "").partition(":")
    return base64.b32decode(value).hex() if kind == "sha1" else None


PART_ARROW = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("warc_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()), ("block", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            filesystem, file = common.filesystem(path)
            with filesystem.open_input_stream(file, compression=None) as f:
                data = f.read()
            rows = []
            for h, block in parse_records(data):
                kind, number = h.get("warc-type"), h.get("warc-segment-number")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                row = dict.fromkeys(PART_ARROW.names) | {"origin": h.get("warc-segment-origin-id") or h.get("warc-record-id"), "warc_type": kind, "uri": h.get("warc-target-uri"), "payload_digest": _promised(h)}
                row["page_id"] = _page(row["origin"])
                if number:
                    total = h.get("warc-segment-total-length")
                    row |= {"segment": int(number), "total": total and int(total), "block": block}
                elif kind == "revisit":
                    size = h.get("warc-payload-length")
                    row |= {"refers": h.get("warc-refers-to"), "payload_bytes": size and int(size), "status": "ok"}
                else:
                    row["payload_bytes"], row["payload_digest"], row["status"] = payload_of(block, row["payload_digest"])
                rows.append(row)
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, PART_ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, PART_ARROW)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["origin", "page_id", "payload_bytes", "payload_digest", "record_type", "refers", "uri", "status"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()])))
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            # Equal rows have equal ids: then each of their segments is there as often, with one content.
            copies: dict[int, list[dict]] = {}
            for p in r["parts"]:
                copies.setdefault(p["segment"], []).append(p)
            n = len(copies[min(copies)])
            same = all(len(c) == n and all(p["block"] == c[0]["block"] for p in c) for c in copies.values())
            parts = [copies[k][0] for k in sorted(copies)]
            totals = {p["total"] for p in r["parts"] if p["total"] is not None}
            block = b"".join(p["block"] for p in parts)
            promised = next((p["payload_digest"] for p in parts if p["payload_digest"]), None)
            got: tuple = (None, None, "incomplete")
            if same and sorted(copies) == list(range(1, len(parts) + 1)) and totals == {len(block)}:
                got = payload_of(block, promised)
            out += [{"origin": r["origin"], "page_id": r["page_id"], "payload_bytes": got[0], "payload_digest": got[1], "record_type": "response", "refers": None, "uri": r["uri"], "status": got[2]}] * (n if got[2] != "incomplete" else 1)
        yield pa.RecordBatch.from_pylist(out, schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in a manifest (path, ...), segments put together."""
    n = max(1, manifest.count())
    parts = common.materialise(manifest.select("path").repartition(n).mapInArrow(_parse, PART), "warc-parts")
    columns = ["origin", "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers", "uri", "status"]
    piece = F.struct("segment", "total", "payload_digest", "block")
    grouped = parts.where("segment IS NOT NULL").groupBy("origin", "page_id", "uri").agg(F.collect_list(piece).alias("parts"))
    records = parts.where("segment IS NULL").select(*columns).unionByName(grouped.select("origin", "page_id", "uri", "parts").mapInArrow(_assemble, RECORD))
    records = common.materialise(records, "warc-records")
    common.discard(parts)
    # A revisit is as good as the response that it names.
    named = records.where("record_type = 'revisit'").select(F.col("refers").alias("named")).distinct()
    stored = records.where("record_type = 'response' AND status = 'ok'").join(named, F.col("origin") == F.col("named"), "left_semi")
    stored = common.materialise(stored.groupBy(F.col("origin").alias("stored")).agg(F.min("payload_digest").alias("stored_digest")), "warc-stored")
    held = common.bounded_join(records, stored.withColumnRenamed("stored", "refers"), ["refers"], F.xxhash64("page_id"), stored.count(), 160)
    revisit = F.col("record_type") == "revisit"
    status = F.when(revisit & F.col("stored_digest").isNull(), "lost").when(revisit & (F.col("stored_digest") != F.col("payload_digest")), "digest").otherwise(F.col("status"))
    page = F.regexp_extract("refers", "^<urn:page:([0-9-]+):", 1).try_cast("long")
    return held.select("page_id", "payload_bytes", "payload_digest", "record_type", page.alias("refers_to"), "uri", status.alias("status"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_archives(pages, common.scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


SQL_OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT} AND stored <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT} AND stored <> page_id THEN stored END AS refers_to, 'ok' AS status FROM m
"""
