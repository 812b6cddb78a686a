"""Benchmark decontamination by suffix arrays over the training texts.

The training texts are cut into shards of about SHARD_BYTES (whole texts; a longer one is a shard alone). A task
makes the suffix array of a shard's words and looks up every distinct test window in it by binary search: the window's
range in the array holds all its occurrences. Nothing is shuffled; a hot passage only lengthens its ranges.

Windows that the same items hold one behind the other are a chain, so that a match in a text names its chain and not
each of the items; the items of a text are the union of its chains' lists, put together once for each set of chains.
Only with spans=True are matches given out item by item, as the longest verbatim ones and their places.

Tests are dealt into blocks of about BLOCK_WORDS words (an item is whole in one), which tasks of their own prepare:
words, distinct windows, chains. They lie in the shared folder, and one pass over the texts opens them one after
the other for each shard, whose suffix array is made once. A task holds one shard and one block, or all blocks where
these are few.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the UTF-8 text. A window is WINDOW consecutive
words of an item; an item with fewer, but not none, is one window.

Defined cases: null and empty texts have no words and aren't hit; an item without words is ignored; items with
equal ids count once, a null id is listed as "null"; repeated rows are judged each; empty tables give empty
results, an empty benchmark hits nothing; columns of docs pass through, the result is one struct column.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinframe.llm import common, textnum

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 200_000

#: Prepared blocks that a worker keeps; shards are longer, up to so many times, where there are more blocks.
KEPT_BLOCKS, LONGER = 4, 4

SPAN = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_at", T.LongType()), T.StructField("doc_at", T.LongType()), T.StructField("n_words", T.LongType())])
HIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT)), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())]
SPANS = T.StructField("spans", T.ArrayType(SPAN))

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
_lower[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and words per text, of texts that lie end to end in data."""
    symbols = _lower[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = symbols != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    counts = np.diff(np.searchsorted(starts, bounds))
    return textnum.run_hashes(symbols, starts, ends), counts


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s in the order of their suffixes, by prefix doubling over what isn't told apart yet."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    key = s.astype(np.int64) * (int(s.max()) + 2)
    key[:-1] += s[1:] + 1
    sa = np.argsort(key)
    held = key[sa]
    new = np.ones(n + 1, bool)
    new[1:-1] = held[1:] != held[:-1]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new[:-1], slots, 0))
    slots = np.flatnonzero(~(new[:-1] & new[1:]))
    k = 2
    while len(slots):
        suffix = sa[slots]
        after = suffix + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + second
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[slots] = suffix
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(new[:-1], slots, 0))
        slots = slots[~(new[:-1] & new[1:])]
        k *= 2
    return sa


def ranges(s: np.ndarray, sa: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of windows, the slots lo .. hi of sa whose suffixes begin with it. s ends in padding."""
    width = np.arange(windows.shape[1])
    found = []
    for after_equal in (False, True):
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(sa), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            here, want = s[sa[mid][:, None] + width], windows[open_]
            differ = here != want
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            below = np.where(differ[rows, first], here[rows, first] < want[rows, first], after_equal)
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        found.append(lo)
    return found[0], found[1]


class Tests:
    """A block of items as a task asks for them: words, and the windows of each width."""

    def __init__(self, names: list[str], texts: list[str], window: int):
        raw = [t.encode() for t in texts]
        hashes, counts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.names = np.array(names, object)
        self.words, self.spelled = np.unique(hashes, return_inverse=True)
        firsts, self.groups = np.cumsum(counts) - counts, []
        for width in sorted({min(window, int(c)) for c in counts if c}):
            mine = np.flatnonzero(np.minimum(counts, window) == width)
            per = counts[mine] - width + 1
            at = textnum.ragged(firsts[mine], per)
            self.groups.append(Windows(width, np.repeat(mine, per), textnum.ragged(np.zeros(len(mine), np.int64), per), at, self.spelled[at[:, None] + np.arange(width)]))

    def items(self, group: int, chain: int) -> frozenset[str]:
        g = self.groups[group]
        first = g.firsts[g.heads[chain]]
        return frozenset(self.names[g.item[first : first + g.sizes[g.heads[chain]]]])


class Shard:
    """Texts end to end: their words, and the suffix array once a window may occur."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int):
        hashes, self.counts = word_hashes(data, bounds)
        self.n_docs, self.n = len(self.counts), len(hashes)
        self.distinct, back = np.unique(hashes, return_inverse=True)
        doc = np.repeat(np.arange(self.n_docs), self.counts)
        # One separator after each text, no two alike, so that no suffix is compared beyond its text.
        self.s = np.empty(self.n + self.n_docs + width, np.int64)
        self.s[np.arange(self.n) + doc] = back + 1
        self.s[np.cumsum(self.counts) + np.arange(self.n_docs)] = len(self.distinct) + 1 + np.arange(self.n_docs)
        self.s[self.n + self.n_docs :] = 0

    @cached_property
    def sa(self) -> np.ndarray:
        return suffix_array(self.s[: self.n + self.n_docs])

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts + 1)

    def search(self, tests: Tests, spans: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Of each found window text, word and width; of each run in a chain text, group and chain; if asked for,
        of each match text, item, word in the item, word in the text and words.

        A distinct window is searched once, and only if all its words are in the shard.
        """
        place = np.searchsorted(self.distinct, tests.words)
        place[place == len(self.distinct)] = 0
        code = np.where(self.distinct[place] == tests.words, place + 1, 0)[tests.spelled] if self.n else np.zeros(len(tests.spelled), np.int64)
        there = np.cumsum(np.append(0, code > 0))
        hits, chains, matches = [np.zeros((3, 0), np.int64)], [np.zeros((3, 0), np.int64)], [np.zeros((5, 0), np.int64)]
        for number, g in enumerate(tests.groups):
            here = np.flatnonzero(there[g.at + g.width] - there[g.at] == g.width)
            if not len(here):
                continue
            first = np.cumsum(self.counts + 1) - (self.counts + 1)
            lo, hi = ranges(self.s, self.sa, code[g.at[here][:, None] + np.arange(g.width)])
            where = self.sa[textnum.ragged(lo, hi - lo)]
            window = np.repeat(here, hi - lo)
            of, word = self.owner[where], where - first[self.owner[where]]
            width = np.full(len(where), g.width)
            hits.append(np.stack([of, word, width]))
            (of, chain, shift), start, stop = joined_runs([of, g.chain[window], word - g.step[window]], word, width)
            chains.append(np.stack([of, np.full(len(of), number), chain]))
            if spans:
                # The run's first window is as many steps into its chain as the run begins behind the chain's first word.
                begins = g.at_step(chain, start - shift)
                size = g.sizes[begins]
                entry = textnum.ragged(g.firsts[begins], size)
                again = np.repeat(np.arange(len(begins)), size)
                matches.append(np.stack([of[again], g.item[entry], g.item_at[entry], start[again], (stop - start)[again]]))
        return list(np.concatenate(hits, 1)), list(np.unique(np.concatenate(chains, 1), axis=1)), list(np.concatenate(matches, 1))


class Windows:
    """The windows of one width: the distinct ones, and where each of them stands in which items.

    Distinct windows are numbered by their first place. A chain is a row of them, each of which stands one word behind the
    one before it in all items that hold it, and in no others.
    """

    def __init__(self, width: int, item: np.ndarray, item_at: np.ndarray, at: np.ndarray, words: np.ndarray):
        self.width = width
        _, first, number = np.unique(words, axis=0, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        number = rank[number.reshape(-1)]
        place = np.argsort(number, kind="stable")
        #: Where each distinct window stands first among the block's words.
        self.at = at[np.sort(first)]
        self.item, self.item_at = item[place], item_at[place]
        self.sizes = np.bincount(number, minlength=len(first))
        self.firsts = np.cumsum(self.sizes) - self.sizes
        n = len(self.sizes)
        linked = np.zeros(n, bool)
        if n > 1:
            linked[1:] = self.sizes[1:] == self.sizes[:-1]
            of = np.flatnonzero(linked)
            size = self.sizes[of]
            here, before = textnum.ragged(self.firsts[of], size), textnum.ragged(self.firsts[of - 1], size)
            follows = (self.item[here] == self.item[before]) & (self.item_at[here] == self.item_at[before] + 1)
            if len(of):
                linked[of] = np.logical_and.reduceat(follows, np.cumsum(size) - size)
        self.chain = np.cumsum(~linked) - 1
        self.heads = np.flatnonzero(~linked)
        self.step = np.arange(n) - self.heads[self.chain] if n else np.zeros(0, np.int64)

    def at_step(self, chain: np.ndarray, step: np.ndarray) -> np.ndarray:
        return self.heads[chain] + step


def joined_runs(keys: list[np.ndarray], start: np.ndarray, width: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Intervals [start, start + width) with equal keys that overlap or touch, joined."""
    order = np.lexsort((start, *reversed(keys)))
    keys, start, end = [k[order] for k in keys], start[order], (start + width)[order]
    if not len(start):
        return keys, start, end
    new = np.ones(len(start), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
    # The furthest end so far within a key: keys are numbered so that a later key's ends lie beyond.
    number = np.cumsum(new)
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * step) - number * step
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], start[at], np.maximum.reduceat(end, at)


def _lists(n: int, doc: np.ndarray, fields: list, type_: T.StructType) -> pa.ListArray:
    bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in type_]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(fields, kinds)], type_.names))


_blocks: dict[str, list[Tests]] = {}


def _opened(files: list[str], n_blocks: int) -> Iterator[tuple[int, Tests]]:
    """The prepared blocks, numbered; kept in the worker where they are few."""
    for k, file in enumerate(files):
        held = _blocks.get(file)
        if held is None:
            filesystem, path = common.filesystem(file)
            held = [pickle.loads(x) for x in pq.read_table(path, columns=["block"], filesystem=filesystem).column(0).to_pylist()]
            if n_blocks <= KEPT_BLOCKS:
                while len(_blocks) >= KEPT_BLOCKS:
                    _blocks.pop(next(iter(_blocks)))
                _blocks[file] = held
        yield from ((k << 32 | i, tests) for i, tests in enumerate(held))


class _Named:
    """Number and digest of the items of a set of chains, each set put together once."""

    def __init__(self) -> None:
        self.lists: dict[tuple, frozenset[str]] = {}
        self.sets: dict[frozenset, tuple[int, str]] = {}
        self.held = 0

    def learn(self, block: int, tests: Tests, groups: np.ndarray, chains: np.ndarray) -> None:
        for g, c in {(int(g), int(c)) for g, c in zip(groups, chains)}:
            if (block, g, c) not in self.lists:
                self.lists[block, g, c] = tests.items(g, c)
                self.held += len(self.lists[block, g, c])

    def of(self, chains: frozenset) -> tuple[int, str]:
        if chains not in self.sets:
            names = sorted(frozenset().union(*(self.lists[c] for c in chains)))
            self.sets[chains] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
        return self.sets[chains]


def _pass(files: list[str], n_blocks: int, width: int, at: int, keep: list[int], names: list[str], spans: bool):
    shard_bytes = SHARD_BYTES * min(n_blocks, LONGER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = _Named()
        for batch in batches:
            text = pc.fill_null(batch.column(at), "").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(text):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + shard_bytes, "right")) - 1)
                shard = Shard(whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                found, chained, listed = [np.zeros((3, 0), np.int64)], {}, []
                if named.held > 1_000_000:
                    named = _Named()
                for block, tests in _opened(files, n_blocks):
                    hits, (of, group, chain), matches = shard.search(tests, spans)
                    found.append(np.stack(hits))
                    named.learn(block, tests, group, chain)
                    for d, g, c in zip(of.tolist(), group.tolist(), chain.tolist()):
                        chained.setdefault(d, set()).add((block, g, c))
                    if spans and len(matches[0]):
                        (doc, item, diagonal), word, stop = joined_runs([matches[0], matches[1], matches[3] - matches[2]], matches[3], matches[4])
                        listed.append((doc, tests.names[item], word - diagonal, word, stop - word))
                (doc,), start, end = joined_runs([(every := np.concatenate(found, 1))[0]], every[1], every[2])
                of_items = [named.of(frozenset(chained.get(d, ()))) for d in range(b - a)]
                columns = [pa.array(shard.counts, pa.int64()), _lists(b - a, doc, [start, end], HIT), pa.array([x[0] for x in of_items], pa.int64()), pa.array([x[1] for x in of_items], pa.string())]
                if spans:
                    none = (np.zeros(0, np.int64), np.zeros(0, object), *[np.zeros(0, np.int64)] * 3)
                    doc, *fields = map(np.concatenate, zip(none, *listed))
                    order = np.argsort(doc, kind="stable")
                    columns.append(_lists(b - a, doc[order], [x[order] for x in fields], SPAN))
                part = batch.slice(a, b - a)
                result = pa.StructArray.from_arrays(columns, [f.name for f in [*RESULT, SPANS][: len(columns)]])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), result], names)
                a = b

    return run


def _prepare(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's items stand together."""
        at, names, texts = None, [], []
        for batch in batches:
            for block, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at and names:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tests(names, texts, window))], pa.binary())], ["block"])
                    names, texts = [], []
                at = block
                names.append(name)
                texts.append(text)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tests(names, texts, window))], pa.binary())], ["block"])

    return run


def prepared(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[list[str], int]:
    """Files with the blocks of a benchmark, and their number."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), common.text_or_empty(benchmark).alias("text"))
    # A word has a byte or more and a byte between it and the next.
    words = items.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2))).first()[0] or 0
    n = max(1, -(-words // block_words))
    dealt = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("at"), "item_id", "text").repartition(n, "at").sortWithinPartitions("at", "item_id", "text")
    blocks = common.materialise(dealt.mapInArrow(_prepare(window), "block binary"), "decontam-blocks")
    return sorted(blocks.inputFiles()), n


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, out: str = "found", block_words: int = BLOCK_WORDS, spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those to keep) with a struct: n_words, hits (joined word ranges), n_items, items_sha256 and,
    if asked for, spans (longest matches of each item and their places)."""
    out, keep = common.free_name(docs, out), docs.columns if keep is None else keep
    files, n = prepared(benchmark, window, block_words)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.StructType([*RESULT, *[SPANS] * spans]))])
    at = [docs.columns.index(c) for c in ("text", *keep)]
    return docs.mapInArrow(_pass(files, n, window, at[0], at[1:], schema.names, spans), schema)


def verdict(found: str) -> dict:
    """Expressions over the struct column: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate(f"{found}.hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    n_words = F.col(f"{found}.n_words")
    return {
        "n_words": n_words, "n_hit": n_hit, "n_items": F.col(f"{found}.n_items"),
        "items_sha256": F.col(f"{found}.items_sha256"), "contaminated": (n_hit > 0) & (F.lit(20) * n_hit >= n_words),
    }


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    found = common.free_name(docs, "found")
    return annotate(docs, benchmark, spans=False).where(~verdict(found)["contaminated"]).drop(found)


def op9_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, common.table(spark, sf_dir, "benchmark"), spans=False, keep=["doc_id"])
    return found.select("doc_id", *[e.alias(n) for n, e in verdict("found").items()])
