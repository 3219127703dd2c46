"""Encoding whole columns of texts through a table of distinct chunks.

Where no token crosses from one chunk of a text into the next, a text's ids are its chunks' ids in order. Chunks of a whole column are
found by array operations on its bytes and looked up in a table of those met before; new ones are encoded by the library, many in
one call, each once. A chunk of up to 16 bytes is its own key, so equal keys are equal chunks; longer ones are looked up by their
bytes. The table is emptied when full, which bounds its memory. Texts that cannot be cut so go whole to the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from girder.llm.text import buffer_of

#: Bytes that are cut at once, about.
WINDOW = 2 << 20
KEY = 16
#: Bytes of a chunk's key that count, by its length in a word.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def windows(buffer: np.ndarray, bounds: np.ndarray, safe, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of the buffer that can be cut each by itself: they end with a text, or in a long text where ``safe`` (of the bytes before and
    at a place) says that a chunk begins whatever stands around it."""
    at, n = 0, int(bounds[-1])
    while at < n:
        end = n
        if n - at > size:
            k = int(np.searchsorted(bounds, at + size, "right")) - 1
            end = int(bounds[k])
            if end <= at:
                end, low = int(bounds[k + 1]), at + size
                while low < int(bounds[k + 1]):
                    part = buffer[low - 1 : min(low + size, int(bounds[k + 1]))]
                    found = np.flatnonzero(safe(part[:-1], part[1:]))
                    if len(found):
                        end = low + int(found[0])
                        break
                    low += size
        yield at, end
        at = end


class Table:
    """Ids of chunks of up to ``KEY`` bytes, in open addressing by their two words; ``ids`` holds all ids end to end."""

    def __init__(self, slots: int, kind: np.dtype):
        self.slots, self.kind = slots, kind
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.at, self.n = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.ids, self.used, self.entries = np.zeros(1 << 16, self.kind), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    @property
    def full(self) -> bool:
        return self.used > 8 * self.slots or len(self.long) > self.slots // 8

    def keep(self, ids: np.ndarray) -> int:
        """Append ids; where they begin."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (scrambled(low ^ scrambled(high + np.uint64(1))) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not known."""
        slot = self.home(low, high)
        left = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        while len(left):
            empty = self.low[slot[left]] == 0
            slot[left[empty]] = -1
            left = left[~empty]
            slot[left] = (slot[left] + 1) % self.slots
            s = slot[left]
            left = left[(self.low[s] != low[left]) | (self.high[s] != high[left])]
        return slot

    def add(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Put distinct new keys into free slots."""
        slot, left = self.home(low, high), np.arange(len(low))
        while len(left):
            free = np.flatnonzero(self.low[slot[left]] == 0)
            _, pick = np.unique(slot[left[free]], return_index=True)
            k = left[free[pick]]
            s = slot[k]
            self.low[s], self.high[s], self.at[s], self.n[s] = low[k], high[k], at[k], n[k]
            rest = np.ones(len(left), bool)
            rest[free[pick]] = False
            left = left[rest]
            taken = self.low[slot[left]] != 0
            slot[left[taken]] = (slot[left[taken]] + 1) % self.slots
        self.entries += len(low)


class ColumnEncoder:
    """What encoders of columns share. A kind of encoder says how texts are cut, and what the library makes of chunks and of texts.

    ``cuts(w, n, heads)``: where the chunks of the first n bytes of w begin, heads being where texts begin; ``safe``: as of ``windows``;
    ``ids_of(chunks)``; ``library(texts)``; ``whole(buffer, bounds)``: which texts cannot be cut.
    """

    def __init__(self, slots: int, kind: np.dtype):
        self.kind, self.table = kind, Table(slots, kind)

    def learn(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Take up new chunks of up to KEY bytes; equal ones may be named many times."""
        order = np.lexsort((high, low))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        one = order[fresh]
        ids = self.ids_of([raw[a : a + n] for a, n in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)])
        n = np.array(list(map(len, ids)), np.int64)
        self.table.add(low[one], high[one], self.table.keep(np.concatenate(ids)) + np.cumsum(n) - n, n)

    def encode_window(self, buffer: np.ndarray, begin: int, end: int, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where chunks begin, how many ids each has, and all ids of a range of the buffer."""
        table = self.table
        starts = self.cuts(buffer[begin : end + 2], end - begin, heads - begin)
        sizes = np.diff(starts, append=end - begin)
        words = np.ndarray(len(buffer) - 7, "<u8", buffer, 0, (1,))
        low = words[begin + starts] & MASK[np.minimum(sizes, 8)]
        high = words[begin + starts + 8] & MASK[np.clip(sizes - 8, 0, 8)]
        short, raw = sizes <= KEY, None
        places = np.flatnonzero(short)
        slot = table.find(low[places], high[places])
        miss = places[slot < 0]
        if len(miss):
            raw = buffer[begin:end].tobytes()
            if table.entries + len(miss) > table.slots // 2 and table.entries:
                table.clear()
                miss = places
            self.learn(raw, starts[miss], sizes[miss], low[miss], high[miss])
            slot = table.find(low[places], high[places])
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[places], n[places] = table.at[slot], table.n[slot]
        long = np.flatnonzero(~short)
        if len(long):
            raw = raw or buffer[begin:end].tobytes()
            parts = [raw[a : a + k] for a, k in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
            new = [p for p in dict.fromkeys(parts) if p not in table.long]
            for p, ids in zip(new, self.ids_of(new), strict=True):
                table.long[p] = table.keep(ids), len(ids)
            at[long], n[long] = np.array([table.long[p] for p in parts]).T
        total = np.cumsum(n)
        ids = table.ids[np.repeat(at - total + n, n) + np.arange(total[-1])]
        if table.full:
            table.clear()
        return begin + starts, n, ids

    def encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        buffer, bounds = buffer_of(texts)
        heads, starts, counts, ids = np.unique(bounds[:-1]), [], [], []
        for begin, end in windows(buffer, bounds, self.safe):
            inner = heads[np.searchsorted(heads, begin) : np.searchsorted(heads, end)]
            s, n, found = self.encode_window(buffer, begin, end, np.union1d(inner, [begin]))
            starts.append(s)
            counts.append(n)
            ids.append(found)
        if not ids:
            return [np.zeros(0, self.kind)] * len(texts)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        edges, every = total[np.searchsorted(np.concatenate(starts), bounds)].tolist(), np.concatenate(ids)
        return [every[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a string column."""
        buffer, bounds = buffer_of(texts)
        whole = self.whole(buffer, bounds)
        if not whole.any():
            return self.encode_plain(texts)
        out: list = [None] * len(texts)
        odd, plain = np.flatnonzero(whole), np.flatnonzero(~whole)
        for i, ids in zip(odd.tolist(), self.library([buffer[bounds[i] : bounds[i + 1]].tobytes().decode() for i in odd]), strict=True):
            out[i] = ids
        if len(plain):
            for i, ids in zip(plain.tolist(), self.encode_plain(texts.take(pa.array(plain))), strict=True):
                out[i] = ids
        return out


def holding(buffer: np.ndarray, bounds: np.ndarray, places: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which texts have a byte at one of the places, or one of the marks beginning in them."""
    out = np.zeros(len(bounds) - 1, bool)
    raw = buffer[: bounds[-1]].tobytes() if marks else b""
    found = []
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            found.append(at)
            at = raw.find(mark, at + 1)
    out[np.searchsorted(bounds, np.concatenate([places, np.array(found, np.int64)]), "right") - 1] = True
    return out
