"""Merging the Burrows-Wheeler transforms of shards of strings, in numpy, in blocks of eight bytes.

A transform lists, for the suffixes of a shard in order, the block that stands before each. Suffixes of all shards are
merged without being sorted again: an interleave vector says from which shard the next suffix comes. A round puts the
blocks in stable order, which refines the interleave by one more block of common prefix; borders between
suffixes that a round tells apart end intervals. After as many rounds as a prefix has blocks, the
intervals are the groups of suffixes that have it in common."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 8


@dataclass
class Shard:
    """place: for the suffixes in order, where they start in the shard's bytes. before: the block before each,
    or -1 at the front of a string. The first `terminals` suffixes are too short to have a block."""
    place: np.ndarray
    before: np.ndarray
    terminals: int


def block_names(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte the rank of the block that starts there, in byte order; -1 where a string ends before the block does.
    ends: for each byte, the end of its string, whose last byte is its terminal."""
    n = len(flat)
    padded = np.concatenate((flat, np.zeros(BLOCK, np.uint8)))
    value = np.zeros(n, np.uint64)
    for i in range(BLOCK):
        value = value << np.uint64(8) | padded[i: i + n]
    whole = np.arange(n) + BLOCK < ends
    order = np.argsort(value)
    new = np.concatenate(([False], value[order][1:] != value[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return np.where(whole, rank, -1)


def _stable(values: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers below 2**31."""
    packed = np.sort(values << 32 | np.arange(len(values)))
    return packed & 0xFFFFFFFF


def transform(names: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> Shard:
    """The transform of one shard. names: block_names() of its bytes; starts, ends: of each byte's string. Suffixes are put in order by prefix
    doubling, to a common prefix of depth bytes at least."""
    n = len(names)
    terminal = names < 0
    count = int(terminal.sum())
    rank = np.where(terminal, 0, names + count)
    rank[terminal] = np.arange(count)
    order = _stable(rank)
    length = BLOCK
    while length < depth:
        ahead = np.minimum(np.arange(n) + length, ends - 1)
        # a suffix that ends is told from others by its terminal, which is its own
        second = rank[ahead]
        order = _stable(second)
        order = order[_stable(rank[order])]
        new = np.concatenate(([False], (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        length *= 2
    order = _stable(rank)
    front = order - BLOCK
    before = np.where(front >= starts[order], names[np.maximum(front, 0)], -1)
    return Shard(order, before, count)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix of all shards in merged order, numbered shard after shard; interval of each) by `depth` bytes of common
    prefix, a multiple of BLOCK."""
    # numbers of 32 bits and few shards: half of the memory to go through, and a radix sort for the order of shards
    before = np.concatenate([s.before for s in shards]).astype(np.int32)
    sizes = [len(s.place) for s in shards]
    total = sum(sizes)
    few = np.uint8 if len(shards) <= 256 else np.uint16 if len(shards) <= 1 << 16 else np.int32
    source = np.repeat(np.arange(len(shards), dtype=few), sizes)
    terminals = np.repeat(np.arange(len(shards), dtype=few), [s.terminals for s in shards])
    n_terminals = len(terminals)
    interval = np.zeros(total, np.int32)
    count = np.arange(total, dtype=np.int32)
    index = count  # shard after shard
    for _ in range(depth // BLOCK):
        block = before[index]
        front = np.flatnonzero(block >= 0)
        ordered = np.sort(block[front].astype(np.int64) << 32 | front)
        turn, b = ordered & 0xFFFFFFFF, ordered >> 32
        new_source = np.concatenate((terminals, source[turn]))
        i = interval[turn]
        border = np.ones(total, bool)
        border[n_terminals + 1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1])
        new_interval = np.cumsum(border, dtype=np.int32)
        new_interval -= 1
        if new_interval[-1] == interval[-1] and np.array_equal(new_source, source) and np.array_equal(new_interval, interval):
            break
        source, interval = new_source, new_interval
        index = np.empty(total, np.int32)
        index[np.argsort(source, kind="stable")] = count
    return index, interval


#: Bytes of a shard, about.
SHARD = 1 << 19


def repeated(strings: list[bytes], weight: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each string, which of its places start `depth` bytes that occur more than once in all strings; a string of weight two counts twice.

    Places with fewer bytes ahead are left out."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    flat = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    end = np.cumsum(lengths)
    starts, ends = np.repeat(end - lengths, lengths), np.repeat(end, lengths)
    names = block_names(flat, ends)
    # two shards at least, cut between strings
    cuts = [0]
    for e in end.tolist():
        if e - cuts[-1] >= min(SHARD, max(1, len(flat) // 2)):
            cuts.append(e)
    if cuts[-1] != len(flat):
        cuts.append(len(flat))
    shards = [transform(names[a:b], starts[a:b] - a, ends[a:b] - a, depth) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    index, interval = merge(shards, depth)
    place = np.concatenate([s.place + a for s, a in zip(shards, cuts[:-1], strict=True)])[index]
    full = place + depth < ends[place]
    of_string = np.repeat(np.asarray(weight, np.int64), lengths)
    times = np.bincount(interval[full], of_string[place[full]], int(interval[-1]) + 1)
    again = np.zeros(len(flat), bool)
    again[place[full]] = times[interval[full]] > 1
    return [again[e - n: max(e - n, e - depth)] for e, n in zip(end.tolist(), lengths.tolist(), strict=True)]
