"""Edit-aware token counts: a segment tree of pre-tokens for each document.

build() encodes a text once. Its pre-tokens (see textnum.pretokens) lie in leaves of LEAF; the leaves' code points
and tokens are summed up a binary tree. apply() finds an edit's place by going down the tree, and asks the
vocabulary only about the pre-tokens between the last old boundary at or before (edit start - BEFORE) and the
first one at or after (edit end + AFTER): whether a boundary stands at i depends on the characters i - 4 .. i + 1
alone, so boundaries outside can't change. Then it updates the sums from the touched leaves to the root. The count
after any edits equals that of encoding the new text afresh.

An edit is (seq, at, remove, insert): in the text as the earlier edits of its document left it, `remove` code
points from `at` on give way to `insert`. Edits apply in order of (seq, at, remove, insert). at and remove are
clamped to the text; null at or remove is 0, a null insert is empty.

Edits come as an array column beside the text, where no shuffle is needed, or as a table that attach_edits() joins
by doc_id; a document's edits are a sequence and stay together. Both steps are map-only. Defined cases: a null text
counts 0 tokens and is edited as an empty one; documents without edits are returned as they are; repeated rows each
get the edits of their id; edits of unknown or null ids are dropped; empty tables give empty tables; all columns
pass through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinframe.llm import common, textnum
from clinframe.llm.tokenfile import vocabulary

LEAF = 32
#: Trees opened at a time.
STEP = 500
BEFORE, AFTER = 2, 4
EDIT = "array<struct<seq:long,at:long,remove:long,insert:string>>"
#: lengths and tokens: of each pre-token, little-endian unsigned 32 bit. leaves: pre-tokens in each.
#: char_sums, token_sums: the tree from the root on, node i above 2i and 2i + 1; node 0 isn't used.
TREE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("lengths", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
    T.StructField("leaves", T.ArrayType(T.IntegerType())), T.StructField("char_sums", T.ArrayType(T.LongType())), T.StructField("token_sums", T.ArrayType(T.LongType())),
    T.StructField("n_reencoded", T.LongType()), T.StructField("n_edits", T.LongType()),
])
ARROW_TREE = pa.struct([("text", pa.string()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("leaves", pa.list_(pa.int32())), ("char_sums", pa.list_(pa.int64())), ("token_sums", pa.list_(pa.int64())), ("n_reencoded", pa.int64()), ("n_edits", pa.int64())])


def tree_sums(leaf_sums: list[int]) -> list[int]:
    size = 1 << max(0, len(leaf_sums) - 1).bit_length()
    sums = [0] * size + leaf_sums + [0] * (size - len(leaf_sums))
    for i in range(size - 1, 0, -1):
        sums[i] = sums[2 * i] + sums[2 * i + 1]
    return sums


def new_tree(text: str, lengths: np.ndarray, tokens: np.ndarray) -> dict:
    n = len(lengths)
    leaves = [min(LEAF, n - i) for i in range(0, n, LEAF)] or [0]
    cut = np.arange(0, n, LEAF)
    chars, toks = ((np.add.reduceat(x, cut).tolist() if n else [0]) for x in (lengths, tokens))
    return {"text": text, "lengths": lengths.astype("<u4").tobytes(), "tokens": tokens.astype("<u4").tobytes(), "leaves": leaves, "char_sums": tree_sums(chars), "token_sums": tree_sums(toks), "n_reencoded": 0, "n_edits": 0}


class Document:
    """A tree opened for edits: each leaf's text, and its pre-tokens' lengths and tokens."""

    def __init__(self, state: dict, pool: textnum.Pool):
        self.pool, self.leaves, self.open = pool, [], ()
        n = len(state["lengths"]) // 4
        lengths, tokens = (struct.unpack(f"<{n}I", state[k]) for k in ("lengths", "tokens"))
        self.chars, self.toks = list(state["char_sums"]), list(state["token_sums"])
        self.size, at, char = len(self.chars) // 2, 0, 0
        for i, m in enumerate(state["leaves"]):
            end = char + self.chars[self.size + i]
            self.leaves.append([state["text"][char:end], list(lengths[at : at + m]), list(tokens[at : at + m])])
            at, char = at + m, end
        self.n_reencoded, self.n_edits = state["n_reencoded"], state["n_edits"]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the code point at position (the last one with text, beyond the end), and where it begins."""
        node, begin = 1, 0
        position = min(position, self.chars[1] - 1)
        while node < self.size:
            node *= 2
            if position >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return min(max(0, node - self.size), len(self.leaves) - 1), begin

    def cut(self, at: int | None, remove: int | None, insert: str | None) -> tuple[str, int]:
        """Begin an edit: the region that has to be encoded anew with what follows it, and the region's own length.

        put() ends it with the region's pre-tokens.
        """
        whole = self.chars[1]
        at = min(max(at or 0, 0), whole)
        remove, insert = min(max(remove or 0, 0), whole - at), insert or ""
        (first, begin), (last, _) = self.leaf_at(max(0, at - BEFORE)), self.leaf_at(at + remove + AFTER)
        touched = self.leaves[first : last + 1]
        text, lengths, tokens = "".join(x[0] for x in touched), [n for x in touched for n in x[1]], [n for x in touched for n in x[2]]
        a = at - begin
        # Old boundaries outside of what the edit can change; i and j number pre-tokens.
        i, left = 0, 0
        while i < len(lengths) and left + lengths[i] <= a - BEFORE:
            left += lengths[i]
            i += 1
        j, right = i, left
        while j < len(lengths) and right < a + remove + AFTER:
            right += lengths[j]
            j += 1
        changed = text[:a] + insert + text[a + remove :]
        right_now = right + len(insert) - remove
        follows = changed[right_now : right_now + AFTER]
        for x in self.leaves[last + 1 :]:
            if len(follows) >= AFTER:
                break
            follows += x[0][:AFTER]
        self.open = (first, last, changed, lengths, tokens, i, j)
        return changed[left:right_now] + follows, right_now - left

    def edit(self, at: int | None, remove: int | None, insert: str | None) -> None:
        wave([(self, (at, remove, insert))], self.pool)

    def put(self, new_lengths: list[int], new_tokens: list[int]) -> None:
        first, last, changed, lengths, tokens, i, j = self.open
        lengths[i:j], tokens[i:j] = new_lengths, new_tokens
        self.n_reencoded += len(new_lengths)
        self.n_edits += 1
        self._put_back(first, last, changed, lengths, tokens)

    def _put_back(self, first: int, last: int, text: str, lengths: list[int], tokens: list[int]) -> None:
        """Deal the pre-tokens evenly to the touched leaves; the whole tree anew if these have become too long."""
        n, m = len(lengths), last - first + 1
        if n > 4 * LEAF * m:
            t = [x[0] for x in self.leaves]
            flat = [[v for x in (*self.leaves[:first], [text, lengths, tokens], *self.leaves[last + 1 :]) for v in x[k]] for k in (1, 2)]
            whole = "".join([*t[:first], text, *t[last + 1 :]])
            fresh = Document(new_tree(whole, np.array(flat[0], np.int64), np.array(flat[1], np.int64)), self.pool)
            self.leaves, self.chars, self.toks, self.size = fresh.leaves, fresh.chars, fresh.toks, fresh.size
            return
        char = 0
        for k in range(m):
            part = slice(n * k // m, n * (k + 1) // m)
            size = sum(lengths[part])
            self.leaves[first + k] = [text[char : char + size], lengths[part], tokens[part]]
            char += size
            self._set(self.chars, first + k, size)
            self._set(self.toks, first + k, sum(tokens[part]))

    def _set(self, sums: list[int], leaf: int, value: int) -> None:
        node = self.size + leaf
        change = value - sums[node]
        while node and change:
            sums[node] += change
            node >>= 1

    def state(self) -> dict:
        flat = [np.array([v for x in self.leaves for v in x[k]], "<u4").tobytes() for k in (1, 2)]
        return {"text": "".join(x[0] for x in self.leaves), "lengths": flat[0], "tokens": flat[1], "leaves": [len(x[1]) for x in self.leaves], "char_sums": self.chars, "token_sums": self.toks, "n_reencoded": self.n_reencoded, "n_edits": self.n_edits}


def in_order(edits: list[dict]) -> list[dict]:
    def order(e: dict) -> tuple:
        return tuple((v is not None, v if v is not None else 0) for v in (e["seq"], e["at"], e["remove"])) + (e["insert"] or "",)

    return sorted(edits, key=order)


def wave(edits: list[tuple[Document, tuple]], pool: textnum.Pool) -> None:
    """One edit (at, remove, insert) of each of many documents: their regions are encoded as one chunk."""
    regions = [d.cut(*e) for d, e in edits]
    for a, b in textnum.chunks([text for text, _ in regions]):
        chunk = textnum.Chunk([text for text, _ in regions[a:b]])
        starts, ends = textnum.pretokens(chunk)
        of = chunk.text_of(starts)
        stop = (chunk.bounds[:-1] + np.array([n for _, n in regions[a:b]], np.int64))[of]
        inside = starts < stop
        starts, ends, of = starts[inside], np.minimum(ends, stop)[inside], of[inside]
        lengths, tokens = (ends - starts).tolist(), pool.count(chunk, starts, ends).tolist()
        cut = np.searchsorted(of, np.arange(b - a + 1)).tolist()
        for (d, _), i, j in zip(edits[a:b], cut, cut[1:]):
            d.put(lengths[i:j], tokens[i:j])


def edited(states: list[dict], edits: list[list[dict]], pool: textnum.Pool) -> list[dict]:
    """The trees of many documents after their edits; the k-th edits of all of them are a wave."""
    documents, todo = [Document(s, pool) for s in states], [in_order(e) for e in edits]
    for k in range(max(map(len, todo), default=0)):
        wave([(d, (e[k]["at"], e[k]["remove"], e[k]["insert"])) for d, e in zip(documents, todo) if k < len(e)], pool)
    return [d.state() for d in documents]


def build(docs: DataFrame, vocabulary_path: str | None = None, out: str = "tree") -> DataFrame:
    """docs with their trees in one struct column."""
    path, out = vocabulary_path or vocabulary(), common.free_name(docs, out)
    at, names = docs.columns.index("text"), [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = textnum.byte_bpe(path)
        for batch in batches:
            for a, b, texts in textnum.pieces(batch.column(at)):
                chunk = textnum.Chunk(texts)
                starts, ends = textnum.pretokens(chunk)
                tokens = pool.count(chunk, starts, ends)
                cut = np.searchsorted(starts, chunk.bounds)
                trees = [new_tree(t, (ends - starts)[i:j], tokens[i:j]) for t, i, j in zip(texts, cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(trees, ARROW_TREE)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, TREE)]))


def attach_edits(state: DataFrame, edits: DataFrame, out: str = "edits") -> DataFrame:
    """state with each document's edits (doc_id, seq, at, remove, insert) as an array."""
    of_doc = common.free_name(state, "edits_of")
    of = edits.groupBy(F.col("doc_id").alias(of_doc)).agg(F.collect_list(F.struct("seq", "at", "remove", "insert")).cast(EDIT).alias(common.free_name(state, out)))
    return state.join(of, F.col("doc_id") == F.col(of_doc), "left").drop(of_doc)


def apply(state: DataFrame, edits: str = "edits", tree: str = "tree", vocabulary_path: str | None = None) -> DataFrame:
    """state with its trees after the edits in the array column."""
    path, names = vocabulary_path or vocabulary(), state.columns
    edits_at, tree_at = names.index(edits), names.index(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = textnum.byte_bpe(path)
        for batch in batches:
            for first in range(0, len(batch), STEP):
                part = batch.slice(first, STEP)
                trees = part.column(tree_at).to_pylist()
                edits_of = part.column(edits_at).to_pylist()
                touched = [i for i, todo in enumerate(edits_of) if todo]
                for i, tree_now in zip(touched, edited([trees[i] for i in touched], [edits_of[i] for i in touched], pool)):
                    trees[i] = tree_now
                columns = list(part.columns)
                columns[tree_at] = pa.array(trees, ARROW_TREE)
                yield pa.RecordBatch.from_arrays(columns, names)

    return state.mapInArrow(run, state.schema)


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each, placed by a hash of the id: a replacement, an insertion and a deletion."""
    n = F.char_length(common.text_or_empty(docs))
    place = lambda seq: F.pmod(F.xxhash64("doc_id", F.lit(seq)), n + 1)
    edit = lambda seq, remove, insert: F.struct(F.lit(seq).cast("long").alias("seq"), place(seq).cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return docs.withColumn("edits", F.array(edit(0, 12, "[edited]"), edit(1, 0, " re-checked, isn't it?\n"), edit(2, 40, "")))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sample_edits(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    built = build(docs).drop("text").withColumn("n_tokens_before", F.element_at("tree.token_sums", 2))
    after = apply(built)
    pretokens = F.aggregate("tree.leaves", F.lit(0).cast("long"), lambda a, x: a + x)
    return after.select("doc_id", "n_tokens_before", F.element_at("tree.token_sums", 2).alias("n_tokens"), F.element_at("tree.char_sums", 2).alias("n_chars_after"), pretokens.alias("n_pretokens"), "tree.n_edits", "tree.n_reencoded", F.crc32("tree.text").alias("text_crc32"))
