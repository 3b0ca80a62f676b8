"""Word and hash arithmetic on the bytes of many texts at once, for use inside tasks.

An Arrow string column is one byte buffer with offsets. These helpers work on runs of texts of a
few megabytes, so a task's memory follows the run and the longest single text, not the batch.
Words are maximal runs of bytes other than blank and tab to carriage return.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def give_back():
    """Returns freed memory to the system; a worker that is used again would else keep its largest run's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def text_runs(column, run_bytes=RUN_BYTES, trim_every=1):
    """(first row, end row, bytes, offsets) for consecutive rows; nulls count as empty texts.

    Freed memory goes back to the system after ``trim_every`` runs and at the end; asking for it again takes time.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = runs = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + run_bytes, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first, runs = end, runs + 1
        if runs % trim_every == 0 or first == n:
            give_back()


def lower_ascii(data):
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def words(data, offsets):
    """Starts and ends of the words, and per text the number of its first word (one entry more than texts)."""
    inside = np.ones(256, bool)
    inside[[32, *range(9, 14)]] = False
    inside = inside[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class Hasher:
    """64-bit hashes of any byte ranges of a buffer, by prefix sums of weighted byte values."""

    def __init__(self, seed=1):
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * _M3 + np.uint64(seed))
        self.base = 0x2545F4914F6CDD1D
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n):
        while len(self.up) <= n:  # the second half is the first times the power in between
            size = min(2 * len(self.up), max(n + 1, len(self.up) + 1))
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                old = getattr(self, name)
                step = np.uint64(pow(base, len(old), 1 << 64))
                setattr(self, name, np.concatenate([old, old[: size - len(old)] * step]))

    def ranges(self, data, starts, ends):
        self._powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _M3)


def shingles(word_hashes, word_at, size):
    """Hashes of each run of ``size`` words of a text, and per text the number of its first run.

    A text with fewer words has its whole sequence as its one run; one without words has none.
    """
    counts = np.diff(word_at)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    run_at = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(counts)), runs)
    first = word_at[:-1][text] + np.arange(run_at[-1]) - run_at[:-1][text]
    length = np.minimum(counts[text], size)
    out = length.astype(np.uint64) * _M3
    last = max(len(word_hashes) - 1, 0)
    for k in range(size):
        step = word_hashes[np.minimum(first + k, last)] if len(word_hashes) else out
        out = np.where(k < length, mix(out * _M2 + step), out)
    return out, run_at


def segment_sums(values, at):
    """Sums of consecutive ranges ``at[i]:at[i+1]``; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def ragged(starts, lengths):
    """Positions ``starts[i] .. starts[i] + lengths[i]`` one after the other, and where each range begins."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    return np.repeat(starts - at[:-1], lengths) + np.arange(at[-1]), at


class Known:
    """Rows already worked out, by hash; a new hash gets the next row number.

    ``limit`` bounds the rows of a task: beyond it the memory starts anew, which costs time only.
    """

    def __init__(self, limit=1 << 20):
        self.limit = limit
        self.forget()

    def forget(self):
        self.hashes, self.rows, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def rows_of(self, hashes):
        """The row of each hash, and the positions of the first of each new hash in order of their rows."""
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = self.hashes[place] != unique if len(self.hashes) else np.ones(len(unique), bool)
        rows = np.zeros(len(unique), np.int64)
        if len(self.hashes):
            rows[~new] = self.rows[place[~new]]
        rows[new] = self.size + np.arange(new.sum())
        if new.any():
            self.size += int(new.sum())
            both, numbers = np.concatenate([self.hashes, unique[new]]), np.concatenate([self.rows, rows[new]])
            order = np.argsort(both, kind="stable")
            self.hashes, self.rows = both[order], numbers[order]
        return rows[which], first[new]


class Lists:
    """Integer lists by row, kept end to end."""

    def __init__(self):
        self.values, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, values, lengths):
        self.values = np.concatenate([self.values, values])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])

    def take(self, rows):
        """The lists of ``rows`` joined, and where each begins."""
        places, at = ragged(self.at[rows], self.at[rows + 1] - self.at[rows])
        return self.values[places], at


class KeyRows:
    """Row numbers of 64-bit keys in order of first sight, by open addressing: no sorting of what is known."""

    def __init__(self, keys=()):
        self.size = 0
        self._make(16)
        if len(keys):
            self._insert(np.asarray(keys, np.int64))

    def _make(self, bits):
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        old = self.keys[: self.size] if self.size else np.zeros(0, np.int64)
        self.keys = np.zeros(1 << (bits - 1), np.int64)
        self.keys[: len(old)] = old
        if len(old):
            self._place(np.arange(len(old), dtype=np.int32))

    def _slot(self, keys):
        return ((keys.view(np.uint64) * _M3) >> self.shift).view(np.int64)

    def _place(self, rows):
        slot = self._slot(self.keys[rows])
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]  # of several for one place the last one stays
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _insert(self, new):
        bits = len(self.slots).bit_length() - 1
        while (self.size + len(new)) * 2 > 1 << bits:
            bits += 1
        if 1 << bits > len(self.slots):
            self._make(bits)
        rows = np.arange(self.size, self.size + len(new), dtype=np.int32)
        self.keys[rows] = new
        self.size += len(new)
        self._place(rows)

    def find(self, keys):
        """The row of each key, -1 for one that was not seen."""
        slot = self._slot(keys)
        rows = self.slots[slot]
        other = np.flatnonzero((rows >= 0) & (self.keys[rows] != keys))
        slot = slot[other]
        while len(other):
            slot = (slot + 1) & (len(self.slots) - 1)
            found = self.slots[slot]
            rows[other] = found
            going = (found >= 0) & (self.keys[found] != keys[other])
            other, slot = other[going], slot[going]
        return rows

    def rows_of(self, keys):
        """The row of each key; new keys are taken in, their rows follow those before."""
        out = np.empty(len(keys), np.int32)
        for at in range(0, len(keys), 1 << 16):  # soon enough to know most of what comes twice
            part, rows = keys[at : at + (1 << 16)], out[at : at + (1 << 16)]
            rows[:] = self.find(part)
            missed = np.flatnonzero(rows < 0)
            if len(missed):
                new, which = np.unique(part[missed], return_inverse=True)
                rows[missed] = self.size + which
                self._insert(new)
        return out
