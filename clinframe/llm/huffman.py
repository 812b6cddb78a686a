"""Canonical length-limited Huffman codes: lengths, codes, block coding and table-driven decoding.

Numbers only, no Spark: what a task does to its block of ids.
"""

from __future__ import annotations

import numpy as np

#: Bits of the longest code up to 2^16 used ids; beyond them one bit more than ids need, 25 at most.
LIMIT, MOST = 16, 25


def bits_for(used: int) -> int:
    """The longest code for so many used ids."""
    return LIMIT if used <= 1 << LIMIT else min(MOST, (used - 1).bit_length() + 1)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal lengths of at most `limit` bits (bits_for() the ids) by package-merge; 0 for ids that never occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    limit = limit or bits_for(len(used))
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    n = len(leaves)
    # Level by level: a level's items are the leaves merged with the pairs of the level above. Kept for each
    # level is whether its sorted items are leaves; from the bottom the cheapest 2n - 2 are taken and their
    # pairs opened again.
    kinds, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        kinds.append(rank < n)
        merged = weights[rank]
        half = len(merged) // 2
        packages = merged[: 2 * half].reshape(half, 2).sum(1)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(kinds):
        taken = int(np.count_nonzero(is_leaf[:take]))
        depth[:taken] += 1
        take = 2 * (take - taken)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order) == 0:
        return codes
    sizes = lengths[order].astype(np.int64)
    # The codes as fractions of 2^top are running sums of 2^(top - length).
    top = int(sizes.max())
    room = np.int64(1) << (top - sizes)
    codes[order] = ((np.cumsum(room) - room) >> (top - sizes)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `limit` bits: the id whose code begins it, and the code's length."""
    codes = canonical_codes(lengths)
    ids, sizes = np.zeros(1 << limit, np.int32), np.zeros(1 << limit, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used].astype(np.int64) << (limit - lengths[used].astype(np.int64)))]
    room = np.int64(1) << (limit - lengths[order].astype(np.int64))
    n = int(room.sum())
    ids[:n] = np.repeat(order, room)
    sizes[:n] = np.repeat(lengths[order], room)
    return ids, sizes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
    """The bits of ids, first bit first, and the bit offset of every `every`-th id."""
    if len(ids) == 0:
        return b"", np.zeros(0, np.uint32)
    sizes = lengths[ids].astype(np.int64)
    if not sizes.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = starts >> 5
    placed = codes[ids].astype(np.uint64) << (64 - (starts & 31) - sizes).astype(np.uint64)
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums = np.bitwise_or.reduceat(placed, at)
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint32)
    out[word[at]] |= (sums >> np.uint64(32)).astype(np.uint32)
    out[word[at] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) >> 3], starts[::every].astype(np.uint32)


def decode(bits: bytes, n: int, offsets: np.ndarray, every: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids: one lane for each checkpoint, all lanes a step at a time."""
    if n == 0:
        return np.zeros(0, np.int32)
    ids, sizes = table
    limit = len(ids).bit_length() - 1
    width, mask = (24, 0xFFFF) if limit == 16 else (32, (1 << limit) - 1)
    raw = np.frombuffer(bits + b"\0" * 5, np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    if width == 32:
        window = (window[:-1] << 8) | raw[3:]
    at, lanes = offsets.astype(np.int64), len(offsets)
    out = np.zeros((every, lanes), np.int32)
    full = n - (lanes - 1) * every
    for step in range(every):
        if step == full:
            lanes -= 1
            at = at[:lanes]
            if not lanes:
                break
        w = (window[at >> 3] >> (width - limit - (at & 7)).astype(np.uint32)) & mask
        out[step, :lanes] = ids[w]
        at = at + sizes[w]
    return out.T.reshape(-1)[:n]
