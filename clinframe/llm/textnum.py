"""Text as numbers: words and pre-tokens of many texts at once, by NumPy inside a task.

Texts are taken in chunks of about CHUNK code points. Runs (words, pre-tokens) become start positions and
64-bit hashes, so that a vocabulary is asked once for each distinct run of a chunk at most; answers are kept
in a pool of bounded size. Runs longer than LONG are kept by their own text, not by their hash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 300_000
LONG = 64
POOL, POOL_CHARS = 500_000, 8_000_000
#: Times as much for the pool that token ids come from, which is the only one in its worker.
ROOMY = 2
#: New hashes that are searched apart before they are merged.
MERGE_AT = 4096
#: Runs encoded end to end at a time.
JOINED = 256
SPACE, LETTER, NUMBER, OTHER = range(4)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Of each code point: white space, letter (L*), number (N*) or other. Made once in a worker."""
    if "classes" not in _tables:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.full(0x110000, OTHER, np.uint8)
        # Planes 4 to 13 are unassigned, those from 14 on hold no letters or numbers.
        t[:0x40000] = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x40000)), np.uint8, 0x40000)
        t[WHITE] = SPACE
        _tables["classes"] = t
    return _tables["classes"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n; grown by doubling."""
    held = _tables.get("powers")
    if held is None or held.shape[1] < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            held = np.ones((2, size), np.uint64)
            for row, base in zip(held, (BASE, BASE_INVERSE)):
                row[1:] = base
                np.multiply.accumulate(row, out=row)
        _tables["powers"] = held
    return held[0], held[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of symbols[start:end] for each run."""
    up, down = powers(len(symbols) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list[str], limit: int = CHUNK, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Index ranges of at most `most` texts with about `limit` code points; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > limit or i - first >= most):
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def pieces(column: pa.Array, limit: int = CHUNK, most: int = 1 << 16) -> Iterator[tuple[int, int, list[str]]]:
    """Index ranges of a column of texts as in chunks(), by bytes, and each range's texts, null as empty.

    Only one range's texts are Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    first, size = 0, 0
    for i, n in enumerate([*sizes, limit + 1]):
        if i > first and (size + n > limit or i - first >= most):
            yield first, i, [t or "" for t in column.slice(first, i - first).to_pylist()]
            first, size = i, 0
        size += n


class Chunk:
    """Texts joined: code points, and where each text begins and ends."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.bounds[1:])

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        """The index of the text that each position lies in."""
        return np.searchsorted(self.bounds, starts, "right") - 1

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the texts' first and last positions."""
        n = len(self.points)
        first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        first[self.bounds[:-1]] = True
        last[self.bounds[1:] - 1] = True
        return first[:n], last[:n]


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs [^\\x20\\x09-\\x0D]+ inside each text."""
    p = chunk.points
    inside = np.zeros(len(p) + 2, bool)
    inside[1:-1] = ~((p == 0x20) | ((p >= 0x09) & (p <= 0x0D)))
    first, _ = chunk.edges()
    cut = np.zeros(len(p) + 1, bool)
    cut[:-1] = first
    starts = inside[1:] & (~inside[:-1] | cut)
    ends = inside[:-1] & (~inside[1:] | cut)
    return np.flatnonzero(starts[: len(p)]), np.flatnonzero(ends)


def pretokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    finds in each text. A run of one class is a pre-token; a space before a run that isn't white space
    belongs to it; the last character of a white-space run stands apart if text follows.
    """
    p, n = chunk.points, len(chunk.points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = classes()[p]
    first, last = chunk.edges()
    white = c == SPACE
    start = np.ones(n, bool)
    start[1:] = c[1:] != c[:-1]
    start |= first
    tail = np.zeros(n, bool)
    tail[:-1] = white[:-1] & ~white[1:]
    start |= tail & ~last
    joined = np.zeros(n, bool)
    joined[1:] = (p[:-1] == 0x20) & ~white[1:]
    start &= ~(joined & ~first)
    quotes = np.flatnonzero((p == 0x27) & start & ~last)
    for q in quotes.tolist():
        a = chr(p[q + 1])
        if a in "stmd":
            end = q + 2
        elif q + 2 < n and not last[q + 1] and a + chr(p[q + 2]) in ("re", "ve", "ll"):
            end = q + 3
        else:
            continue
        start[q + 1 : end] = False
        if end < n:
            start[end] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start .. start + length of each piece, one piece after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _look_up(keys: np.ndarray, slots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The slot of each wanted key in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, slots[place], -1)


def _merged(keys: np.ndarray, slots: np.ndarray, more: np.ndarray, more_slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(keys, more)
    return np.insert(keys, place, more), np.insert(slots, place, more_slots)


class Pool:
    """Token ids of runs, by hash: encode() is asked for what isn't there. Emptied when it holds POOL runs or POOL_CHARS, or so many times that.

    New hashes go to a small sorted array of their own, which is merged into the large one now and then.

    encode: from runs to their ids, one after the other, and the number of ids of each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], times: int = 1):
        self.encode, self.most, self.most_chars = encode, times * POOL, times * POOL_CHARS
        self.clear()

    def clear(self) -> None:
        #: Hashes in order, and the number under which each run's ids are kept.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new_keys, self.new_slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.long: dict[str, int] = {}
        self.long_chars = 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.held = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _add(self, runs: list[str]) -> np.ndarray:
        """Encode runs; the numbers under which they are kept."""
        ids, lengths = self.encode(runs)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.held + len(runs) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        at = np.arange(self.held, self.held + len(runs))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at] = lengths
        self.used, self.held = self.used + len(ids), self.held + len(runs)
        return at

    def find(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number under which each run of the chunk is kept."""
        if self.held > self.most or self.used > self.most_chars or self.long_chars > self.most_chars:
            self.clear()
        out = np.empty(len(starts), np.int64)
        short = ends - starts <= LONG
        if not short.all():
            far = np.flatnonzero(~short)
            runs = [chunk.joined[i:j] for i, j in zip(starts[far].tolist(), ends[far].tolist())]
            if new := [r for r in dict.fromkeys(runs) if r not in self.long]:
                self.long |= zip(new, self._add(new).tolist())
                self.long_chars += sum(map(len, new))
            out[far] = [self.long[r] for r in runs]
            starts, ends = starts[short], ends[short]
        distinct, at, back = np.unique(run_hashes(chunk.points, starts, ends), return_index=True, return_inverse=True)
        found = _look_up(self.keys, self.slots, distinct)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            found[rest] = _look_up(self.new_keys, self.new_slots, distinct[rest])
            new = rest[found[rest] < 0]
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist())
            found[new] = self._add([chunk.joined[i:j] for i, j in spans]) if len(new) else 0
            self._remember(distinct[new], found[new])
        out[short] = found[back]
        return out

    def _remember(self, keys: np.ndarray, slots: np.ndarray) -> None:
        self.new_keys, self.new_slots = _merged(self.new_keys, self.new_slots, keys, slots)
        if len(self.new_keys) > MERGE_AT + len(self.keys) // 8:
            self.keys, self.slots = _merged(self.keys, self.slots, self.new_keys, self.new_slots)
            self.new_keys, self.new_slots = self.new_keys[:0].copy(), self.new_slots[:0].copy()

    def count(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of ids of each run of the chunk."""
        which = self.find(chunk, starts, ends)
        return self.lengths[which]

    def gather(self, which: np.ndarray) -> np.ndarray:
        """The ids of the runs, one after the other."""
        return self.ids[ragged(self.starts[which], self.lengths[which])]


def _flat(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter((i for ids in each for i in ids), np.int32, int(lengths.sum())), lengths


def byte_bpe(path: str) -> Pool:
    """A pool over a byte-level BPE file of the tokenizers library; one per worker and file.

    The library's pre-tokeniser cuts by the pattern of pretokens() and merges never cross a cut, so that
    encoding a text is encoding its pre-tokens one by one. Runs that begin with a space and go on with
    something else are cut from whatever stands before and after them, so they are encoded end to end.
    """
    key = f"byte:{path}"
    if key not in _pools:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True

        def encode(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
            first, second = (np.fromiter((ord(r[i : i + 1] or "\0") for r in runs), np.uint32, len(runs)) for i in (0, 1))
            apart = (first == 0x20) & (second > 0) & (classes()[second] != SPACE)
            together, single = np.flatnonzero(apart), np.flatnonzero(~apart)
            found, lengths = [], np.zeros(len(runs), np.int64)
            for i in range(0, len(together), JOINED):
                part = together[i : i + JOINED]
                e = t.encode("".join([runs[k] for k in part.tolist()]), add_special_tokens=False)
                lengths[part] = np.bincount(np.array(e.word_ids), minlength=len(part))
                found.append(np.array(e.ids, np.int32))
            rest = t.encode_batch_fast([runs[k] for k in single.tolist()], add_special_tokens=False)
            lengths[single] = [len(e) for e in rest]
            flat = np.concatenate([np.zeros(0, np.int32), *found, *(np.array(e.ids, np.int32) for e in rest)])
            # From the order of together, then single, to that of the runs.
            order = np.concatenate([together, single])
            starts = np.zeros(len(runs), np.int64)
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
            return flat[ragged(starts, lengths)], lengths

        _pools[key] = Pool(encode, ROOMY)
    release(_pools[key])
    return _pools[key]


def rank_bpe(path: str, prefix: str = "") -> Pool:
    """A pool over a rank file for tiktoken; each run is encoded with `prefix` before it."""
    key = f"rank:{prefix}:{path}"
    if key not in _pools:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(key, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _pools[key] = Pool(lambda runs: _flat([e.encode_ordinary(prefix + r) for r in runs]))
    return _pools[key]


def piece_bpe(path: str) -> Pool:
    """A pool over a sentencepiece model; each run is encoded as a word of its own."""
    key = f"piece:{path}"
    if key not in _pools:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        _pools[key] = Pool(lambda runs: _flat(s.encode(runs, num_threads=1)))
    return _pools[key]


_pools: dict[str, Pool] = {}


def release(but: Pool | None = None) -> None:
    """Empty the worker's other pools: a worker goes on from one stage to the next."""
    for pool in _pools.values():
        if pool is not but:
            pool.clear()
