"""Burrows-Wheeler transform and common prefixes of a string collection, built column by column.

Round j inserts the suffix of j symbols of every string that has so many: one symbol a string and round. Its place
follows from symbol counts: all smaller symbols of the transform, and the equal ones before the place of the string's
suffix of j - 1 symbols. Its common prefix with the neighbour on either side is one more than the least common prefix
between that place and the nearest equal symbol on that side. The transform, the common prefixes and the suffixes' owners
are three sequential files. A round reads them twice from front to back in blocks, once to count and once to copy them
with the new suffixes put in; in memory are one block, the place of each string, and the count of each symbol.

Symbols are blocks of bytes, 40 if that divides `length`. A string takes part once for each way to cut it into blocks, so
two places whose next `length` bytes agree have suffixes with length / 40 equal symbols, in whichever way they are cut.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from engram.llm import common

#: Bytes of a symbol, the first that divides the length asked for.
BLOCKS = (40, 24, 16, 8)
#: Entries of the files that are in memory at a time, and bytes of a file that are kept in memory before it goes to disk.
ENTRIES = 1 << 17
SPOOL = 1 << 21


class _File:
    """A sequential file of one data type. It is the task's own spill, beside those of Spark's sorts, and ends with it."""

    def __init__(self, dtype: np.dtype):
        where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file = tempfile.SpooledTemporaryFile(SPOOL, prefix="bwt-", dir=where if os.path.isdir(where) else None)
        self.dtype, self.n = np.dtype(dtype), 0

    def append(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, dtype=self.dtype).data)
        self.n += len(values)

    def blocks(self) -> list[tuple[int, int]]:
        return [(a, min(a + ENTRIES, self.n)) for a in range(0, self.n, ENTRIES)]

    def read(self, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read(count * self.dtype.itemsize), dtype=self.dtype)

    def rewind(self) -> None:
        self.file.seek(0)

    def close(self) -> None:
        self.file.close()


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minimum of values[start:stop] for each pair, start < stop."""
    out = np.empty(len(start), dtype=values.dtype)
    if not len(start):
        return out
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[start[at]], table[stop[at] - size])
        table = np.minimum(table[: len(table) - size], table[size:]) if len(table) > size else table
        size *= 2
    return out


class _Round:
    """One pass over the files: how many equal symbols stand before each asked place, and the least common prefixes
    between it and the nearest equal symbols before and after it (-1 without one)."""

    def __init__(self, place: np.ndarray, symbol: np.ndarray, symbols: int, cap: int):
        self.place, self.symbol = place, symbol
        self.wanted = np.zeros(symbols, dtype=bool)
        self.wanted[symbol] = True
        self.seen = np.zeros(symbols, dtype=np.int64)  # of each symbol, so far
        self.since = np.full(symbols, cap, dtype=np.uint8)  # least common prefix since its last occurrence
        self.waiting = np.full(symbols, -1, dtype=np.int64)  # the asked place that is its last occurrence, if any
        self.before = np.zeros(len(place), dtype=np.int64)
        self.left, self.right = np.full(len(place), -1, dtype=np.int16), np.full(len(place), -1, dtype=np.int16)

    def block(self, base: int, last: np.ndarray, common: np.ndarray) -> None:
        at = np.flatnonzero(self.wanted[last])
        if not len(at):
            np.minimum(self.since, common.min(initial=255), out=self.since)
            return
        # low[t]: least common prefix from behind hit t - 1 up to hit t, from the block's begin for the first.
        bounds = np.concatenate(([0], at + 1))
        ended = at[-1] + 1 == len(common)
        low = np.minimum.reduceat(common, bounds[:-1] if ended else bounds)
        tail = low[-1] if not ended else np.uint8(255)
        low = low[: len(at)]
        symbol = last[at]
        order = np.argsort(symbol, kind="stable")
        ranked = symbol[order]
        new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        many = np.diff(np.concatenate((new, [len(order)])))
        ids = ranked[new]
        asked = np.full(len(at), -1, dtype=np.int64)
        a, b = np.searchsorted(self.place, (base, base + len(last)))
        asked[np.searchsorted(at, self.place[a:b] - base)] = np.arange(a, b)
        who = asked[order]
        # Neighbours of one symbol within the block.
        inner = np.ones(len(order), dtype=bool)
        inner[new] = False
        to = np.flatnonzero(inner)
        between = np.full(len(order), -1, dtype=np.int16)
        need = to[(who[to] >= 0) | (who[to - 1] >= 0)]
        between[need] = _least(low, order[need - 1] + 1, order[need] + 1)
        # The first of each symbol, against its last occurrence in the blocks before.
        upto = np.minimum.accumulate(low)[order[new]]
        between[new] = np.where(self.seen[ids] > 0, np.minimum(self.since[ids], upto).astype(np.int16), np.int16(-1))
        mine = np.flatnonzero(who >= 0)
        self.left[who[mine]] = between[mine]
        follows = mine[mine + 1 < len(order)]
        follows = follows[inner[follows + 1]]
        self.right[who[follows]] = between[follows + 1]
        waits = self.waiting[ids]
        self.right[waits[waits >= 0]] = between[new][waits >= 0]
        count = np.arange(len(order)) - np.repeat(new, many) + np.repeat(self.seen[ids], many)
        self.before[who[mine]] = count[mine]
        # What the next block needs.
        ends = new + many - 1
        after = np.minimum.accumulate(np.concatenate((low[1:], [tail]))[::-1])[::-1]
        np.minimum(self.since, common.min(), out=self.since)
        self.since[ids] = after[order[ends]]
        self.seen[ids] += many
        self.waiting[ids] = who[ends]


def _symbols(joined: bytes, block: int) -> np.ndarray:
    """A number for the `block` bytes at each place, equal for equal bytes only: sorted by hash, then compared."""
    n = len(joined) - block + 1
    word = [np.ndarray((n,), dtype="<u8", buffer=joined, offset=k, strides=(1,)) for k in range(0, block, 8)]
    h = np.zeros(n, dtype=np.uint64)
    for k, w in enumerate(word):
        h += w * common.MULTIPLIERS[k]
    h = common.mix(h)
    order = np.argsort(h)
    new = np.ones(n, dtype=bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    at = np.cumsum(new, dtype=np.int32)
    same = np.flatnonzero(~new)
    if any((w[order[same]] != w[order[same - 1]]).any() for w in word):  # two blocks of one hash
        order = np.lexsort(word)
        new[1:] = np.logical_or.reduce([w[order[1:]] != w[order[:-1]] for w in word])
        at = np.cumsum(new, dtype=np.int32)
    out = np.empty(n, dtype=np.int32)
    out[order] = at
    return out


def repeated(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, whether the `length` bytes from each place (with so many left) also begin elsewhere.

    Elsewhere is any other place of any string of the list, the same one included. `length` is a multiple of eight.
    """
    block = next((b for b in BLOCKS if length % b == 0 and length > b), 8)
    need = length // block
    if length % block or need > 254:
        raise ValueError(f"length must be a multiple of {block}, and less than {255 * block}")
    size = np.array([len(x) for x in strings], dtype=np.int64)
    windows = np.maximum(size - length + 1, 0)
    base = np.cumsum(size) - size
    ways = np.minimum(windows, block)
    d = int(ways.sum())
    if not d:
        return [np.zeros(n, dtype=bool) for n in windows.tolist()]
    ids = _symbols(b"".join(strings), block)  # 0 is left for the end of a string
    way = np.arange(d) - np.repeat(np.cumsum(ways) - ways, ways)
    count = (np.repeat(size, ways) - way) // block
    final = np.repeat(base, ways) + way + block * (count - 1)  # where the last symbol of each string begins
    symbols = int(ids.max()) + 1
    sort = np.arange(d)  # strings by the place of their latest suffix
    place, symbol = sort.copy(), ids[final]
    files = [_File(np.int32), _File(np.uint8), _File(np.int64)]
    for file, values in zip(files, (symbol, np.zeros(d, dtype=np.uint8), np.full(d, -1)), strict=True):
        file.append(values)
        file.rewind()
    number = np.bincount(symbol, minlength=symbols)
    flags = np.zeros(int(size.sum()), dtype=bool)
    try:
        for j in range(1, int(count.max()) + 1):
            asked = _Round(place, symbol, symbols, need)
            for a, b in files[0].blocks():
                asked.block(a, files[0].read(b - a), files[1].read(b - a))
            smaller = np.cumsum(number) - number
            to = d + smaller[symbol] + asked.before
            order = np.argsort(symbol, kind="stable")  # places are ascending, so equal symbols stay in order
            to, sort = to[order], sort[order]
            left, right = (np.minimum(x[order] + 1, need).astype(np.uint8) for x in (asked.left, asked.right))
            here = final[sort] - block * (j - 1)
            more = count[sort] > j
            symbol = np.where(more, ids[here - block * more], 0)
            number += np.bincount(symbol, minlength=symbols)
            number[0] = 0
            files = _insert(files, to, (symbol, left, here), right)
            place, symbol, sort = to[more], symbol[more], sort[more]
        carried = np.zeros(0, dtype=np.int64)
        for a, b in files[1].blocks():
            common_, who = files[1].read(b - a), files[2].read(b - a)
            hit = common_ >= need
            flags[who[hit]] = True
            flags[who[:-1][hit[1:]]] = True
            if hit[0]:
                flags[carried] = True
            carried = who[-1:]
    finally:
        for file in files:
            file.close()
    return [flags[a : a + n] for a, n in zip(base.tolist(), windows.tolist(), strict=True)]


def _insert(files: list[_File], to: np.ndarray, values: tuple[np.ndarray, ...], right: np.ndarray) -> list[_File]:
    """The files, copied with values put at the ascending places `to`, and the common prefix after each set to right."""
    out = [_File(f.dtype) for f in files]
    for f in files:
        f.rewind()
    n = files[0].n + len(to)
    follow = to + 1
    for a in range(0, n, ENTRIES):
        b = min(a + ENTRIES, n)
        lo, hi = np.searchsorted(to, (a, b))
        here = to[lo:hi] - a
        # Old entries keep their order; a new one repeats an old one until it is overwritten.
        before = np.arange(len(here) + 1, dtype=np.int32)
        take = np.arange(b - a, dtype=np.int32) - np.repeat(before, np.diff(np.concatenate(([0], here, [b - a]))))
        np.clip(take, 0, max(b - a - (hi - lo) - 1, 0), out=take)
        x, y = np.searchsorted(follow, (a, b))
        for k, (old, new, value) in enumerate(zip(files, out, values, strict=True)):
            got = old.read(b - a - (hi - lo))
            block = got[take] if len(got) else np.empty(b - a, dtype=old.dtype)
            if k == 1:
                block[follow[x:y] - a] = right[x:y]
            block[here] = value[lo:hi]
            new.append(block)
    for f in files:
        f.close()
    for f in out:
        f.rewind()
    return out
