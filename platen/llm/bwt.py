"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement.

A collection's strings are read in blocks of BLOCK bytes, at every offset: the
suffix at byte i is the sequence of blocks at i, i + BLOCK, ... up to the end
of its string. Refining by one block sorts BLOCK bytes deeper.
"""

from __future__ import annotations

import numpy as np

BLOCK = 5


def block_values(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The block that starts at each byte, filled with a sign below all bytes past its string's end."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))
    padded = np.concatenate([raw, np.zeros(BLOCK, np.uint8)]).astype(np.int64) + 1
    value = np.zeros(len(raw), np.int64)
    for k in range(BLOCK):
        value *= 257
        value += np.where(left > k, padded[k : k + len(raw)], 0)
    return value


def stable_order(x: np.ndarray) -> np.ndarray:
    """A stable argsort of non-negative 32-bit numbers by at most two counting passes."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


class Shard:
    """The transform of one collection: symbols before each sorted suffix (0: none) and the suffixes' positions.

    Positions at or above the number of bytes are the empty suffixes, one for each string and offset.
    """

    def __init__(self, names: np.ndarray, at: np.ndarray):
        size, lengths = len(names), np.diff(at)
        ends = np.minimum(lengths, BLOCK)  # one empty suffix for each offset at which a string has a block
        self.empty = int(ends.sum())
        # position BLOCK further on: the next block, or that offset's empty suffix
        where = np.arange(size)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        onward = where + BLOCK
        past = onward >= at[1:][owner]
        base = np.cumsum(ends) - ends
        offset = (where - at[:-1][owner]) % BLOCK
        onward[past] = size + (base[owner] + offset)[past]
        rank = np.concatenate([names.astype(np.int64), np.zeros(self.empty, np.int64)])
        rank[size:] = np.arange(self.empty) - self.empty  # below all names, by string and offset
        jump = np.concatenate([onward, np.arange(size, size + self.empty)])
        while True:
            low = rank - rank.min()
            order = np.argsort(low * (low.max() + 1) + low[jump], kind="stable")
            a, b = low[order], low[jump][order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            jump = jump[jump]
        self.positions = order
        before = np.zeros(size + self.empty, np.int32)
        before[onward] = names
        self.symbols = before[order]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms, refining the interleave depth times; suffixes are never compared or sorted anew.

    Returns per merged row the shard, its row there, and the common prefix with
    the row before in blocks, as far as depth.
    """
    count = np.array([len(s.symbols) for s in shards])
    empty = np.array([s.empty for s in shards])
    symbols = np.concatenate([s.symbols for s in shards])
    small = np.uint8 if len(shards) < 256 else np.uint16
    z = np.repeat(np.arange(len(shards)), count).astype(small)
    heads = np.repeat(np.arange(len(shards)), empty).astype(small)
    interval = np.zeros(len(z), np.int32)
    prefix = np.full(len(z), depth, np.int16)
    for k in range(depth):
        here = np.empty(len(z), np.int32)
        here[np.argsort(z, kind="stable")] = symbols
        order = stable_order(here)
        here, inner = here[order], interval[order]
        z = z[order]
        z[: len(heads)] = heads  # empty suffixes: by shard, then string
        inner[: len(heads)] = 0
        new = np.zeros(len(z), bool)
        new[1:] = (here[1:] != here[:-1]) | (inner[1:] != inner[:-1])
        prefix[new & (prefix == depth)] = k
        interval = np.cumsum(new, dtype=np.int32)
    rows = np.empty(len(z), np.int64)
    rows[np.argsort(z, kind="stable")] = np.concatenate([np.arange(c) for c in count])
    prefix[:1] = 0
    return z.astype(np.int64), rows, prefix


def intervals(raw: np.ndarray, at: np.ndarray, length: int, shard_bytes: int) -> np.ndarray:
    """For each byte, the repeated interval that its next length bytes fall in: merged rows between two common prefixes of less than that; -1 where fewer bytes are left."""
    if length % BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK}")
    if not len(raw):
        return np.zeros(0, np.int64)
    names = (np.unique(block_values(raw, at), return_inverse=True)[1].reshape(-1) + 1).astype(np.int32)
    cuts = np.unique(np.concatenate([np.searchsorted(at, np.arange(0, len(raw), shard_bytes)), [len(at) - 1]]))
    if cuts[0] != 0:
        cuts = np.concatenate([[0], cuts])
    shards = [Shard(names[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    z, rows, prefix = merge(shards, length // BLOCK)
    interval = np.cumsum(prefix < length // BLOCK)
    base, size = at[cuts[:-1]], np.array([at[b] - at[a] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    first = np.concatenate([[0], np.cumsum([len(s.symbols) for s in shards])[:-1]])
    position = np.concatenate([s.positions for s in shards])[first[z] + rows]
    real = position < size[z]
    out = np.full(len(raw), -1, np.int64)
    out[(base[z] + position)[real]] = interval[real]
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))
    out[left < length] = -1
    return out
