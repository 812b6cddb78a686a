"""Token ids on disk under a canonical length-limited Huffman code.

A token file is a folder of two tables, both written and read by Spark:

  header  one row: code lengths by id (one byte each), limit, checkpoint distance, id counts
  blocks  one row per block: part, block, start (ids before it), doc_ids, doc_tokens, n_ids, bits,
          checkpoints (bit offset of every CHECKPOINT-th id), crc32 of the block's ids

Blocks hold whole documents in ascending order of doc_id, or of another column such as a shuffle key (ties: by id, then text,
nulls first), are coded with the one code
from the global counts, and are decoded independently of each other; inside a block the checkpoints let all
CHECKPOINT-long lanes be decoded side by side.

Documents are dealt by ranges of doc_id, tokenised, and kept as raw ids in a scratch table while the global
counts are made; each task counts its own ids first, so at most one row per id and task is shuffled and one
row per id reaches the driver. Codes have 16 bits at most, and for over 65,536 used ids a bit more than those need. A null text is empty: it holds the end id alone. Repeated rows are documents of their own. An
empty table gives a file without blocks. Other columns of the input aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import common, huffman, textnum

BLOCK_IDS = 1 << 16
CHECKPOINT = 512
#: Characters of a text that ranges of rows may be cut by, behind id or order.
RANGE_CHARS = 64
RAW = "part int, block int, start long, doc_ids array<long>, doc_tokens array<int>, ids binary"
CODED = "part int, block int, start long, doc_ids array<long>, doc_tokens array<int>, n_ids int, bits binary, checkpoints array<int>, crc32 long"
PER_DOC = "doc_id long, start long, n_tokens long, ids_crc32 long"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lists(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def _raw_blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, part = textnum.byte_bpe(path), TaskContext.get().partitionId()
        block, start, docs, held, size = 0, 0, [], [], 0

        def flush():
            nonlocal block, start, docs, held, size
            ids = np.concatenate(held).astype("<u4")
            out = pa.RecordBatch.from_pydict(
                {"part": [part], "block": [block], "start": [start], "doc_ids": [docs], "doc_tokens": [[len(x) for x in held]], "ids": [ids.tobytes()]},
                schema=schema,
            )
            block, start, docs, held, size = block + 1, start + size, [], [], 0
            return out

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("ids", pa.binary())])
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in textnum.pieces(batch.column(1)):
                for name, ids in zip(names[a:b], encode_texts(pool, texts, end_id)):
                    docs.append(name)
                    held.append(ids)
                    size += len(ids)
                    if size >= BLOCK_IDS:
                        yield flush()
        if docs:
            yield flush()

    return run


def encode_texts(pool: textnum.Pool, texts: list[str], end_id: int) -> list[np.ndarray]:
    """The ids of each text with end_id after them."""
    chunk = textnum.Chunk(texts)
    starts, ends = textnum.pretokens(chunk)
    which = pool.find(chunk, starts, ends)
    ids = pool.gather(which)
    per_text = np.zeros(len(texts) + 1, np.int64)
    np.add.at(per_text, chunk.text_of(starts) + 1, pool.lengths[which])
    bounds = np.cumsum(per_text)
    ids = np.insert(ids, bounds[1:], end_id)
    return _lists(ids, np.diff(bounds) + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            found = np.bincount(np.frombuffer(raw.as_buffer(), "<u4"))
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])


def _code(lengths: bytes, before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.frombuffer(lengths, np.uint8)
        codes = huffman.canonical_codes(sizes)
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            coded, checks, n_ids, crcs = [], [], [], []
            for raw in cols["ids"]:
                ids = np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
                bits, offsets = huffman.encode(ids, sizes, codes, CHECKPOINT)
                coded.append(bits)
                checks.append(offsets.astype(np.int32))
                n_ids.append(len(ids))
                crcs.append(zlib.crc32(raw.as_buffer()))
            start = [s + before[p] for s, p in zip(cols["start"].to_pylist(), cols["part"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [cols["part"], cols["block"], pa.array(start, pa.int64()), cols["doc_ids"], cols["doc_tokens"], pa.array(n_ids, pa.int32()), pa.array(coded, pa.binary()), pa.array(checks, pa.list_(pa.int32())), pa.array(crcs, pa.int64())],
                ["part", "block", "start", "doc_ids", "doc_tokens", "n_ids", "bits", "checkpoints", "crc32"],
            )

    return run


def write(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = 0, order: str = "doc_id") -> None:
    """Tokenise documents (doc_id, text) and write the token file at path, in ascending order of a column (then id, then text)."""
    spark = docs.sparkSession
    by = ["order", "doc_id"] if order != "doc_id" else ["doc_id"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"), *[F.col(order).alias("order")] * (order != "doc_id"))
    # Different texts under one id, or under none, needn't go to one task.
    ordered = ordered.repartitionByRange(*by, F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(*by, "text").select("doc_id", "text")
    raw = common.materialise(ordered.mapInArrow(_raw_blocks(vocabulary_path or vocabulary(), end_id), RAW), "token-ids", compression="zstd")
    counted = raw.select("ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    limit = huffman.bits_for(len(counted))
    lengths = huffman.code_lengths(counts, limit).tobytes()
    parts = raw.select("part", F.size("doc_ids").alias("d"), F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).orderBy("part").collect()
    before, total = {}, 0
    for r in parts:
        before[r.part] = total
        total += r.n
    raw.mapInArrow(_code(lengths, before), CODED).write.parquet(f"{path}/blocks")
    head = [(1, limit, CHECKPOINT, total, sum(r.d for r in parts), bytearray(lengths))]
    spark.createDataFrame(head, "version int, max_bits int, checkpoint int, n_ids long, n_docs long, lengths binary").coalesce(1).write.parquet(f"{path}/header")
    common.discard(raw)


def _decode(lengths: bytes, limit: int, every: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.decode_table(np.frombuffer(lengths, np.uint8), limit)
        for batch in batches:
            for row in batch.to_pylist():
                ids = huffman.decode(row["bits"], row["n_ids"], np.array(row["checkpoints"], np.int64), every, decoder).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']} is damaged")
                sizes = np.array(row["doc_tokens"], np.int64)
                starts = row["start"] + np.cumsum(sizes) - sizes
                each = _lists(ids, sizes)
                last = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digest else pa.array(each, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens and ids, or with digest their crc32."""
    head = spark.read.parquet(f"{path}/header").first()
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_decode(bytes(head.lengths), head.max_bits, head.checkpoint, digest), PER_DOC if digest else "doc_id long, start long, n_tokens long, ids array<int>")


def round_trip(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    spark = docs.sparkSession
    path = common.scratch_path(spark, "token-file")
    write(docs, path, order=order)
    return read(spark, path, digest=True)


def op2_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
