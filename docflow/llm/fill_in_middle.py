"""Fill-in-the-middle: texts rearranged so that a model learns to write what stands between two ends.

A text is cut after a number of its units (a word with the blanks before it, or the blanks that end the
text). To find the cuts, a rolling hash divides each text into chunks where its content says so; equal
chunks of any texts fall together and are counted once. A chunk's summary holds its words, code points and
whether it begins and ends inside a word, which is all that is needed to add chunks up: the number of units
of a text follows from its summaries, and a cut lies in one chunk, which alone is looked into.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_bytes import RUN_BYTES, Hasher, Known, mix, ragged, segment_sums, text_runs

#: A chunk ends where the hash of its last 32 bytes has this many leading zero bits, or at the most bytes.
CHUNK_BITS, MOST_BYTES = 9, 8192
#: Bytes of chunks that a task remembers; beyond them its memory starts anew, which costs time only.
CACHE_BYTES = 16 << 20
MARKS = ("<P>", "<S>", "<M>")

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False


def chunk_limits(data, offsets):
    """Where chunks begin, and the end of the last; every text begins a chunk, and none reaches into two texts.

    A cut depends on the 32 bytes before it only, all of the same text, so a passage is cut alike wherever it stands.
    """
    found = [offsets]
    for at in range(0, len(data), RUN_BYTES):
        first = max(at - 31, 0)
        h = _GEAR[data[first : at + RUN_BYTES]]
        for step in (1, 2, 4, 8, 16):
            h[step:] += h[:-step] << np.uint32(step)
        ends = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + first
        found.append(ends[ends >= at] + 1)
    texts, ends = found[0], np.concatenate(found[1:]) if len(found) > 1 else np.zeros(0, np.int64)
    begin = texts[np.searchsorted(texts, ends - 1, "right") - 1] if len(ends) else ends
    limits = np.unique(np.concatenate([texts, ends[ends - begin >= 32]]))
    long = np.flatnonzero(np.diff(limits) > MOST_BYTES)
    more = [np.arange(limits[k] + MOST_BYTES, limits[k + 1], MOST_BYTES) for k in long]
    return np.unique(np.concatenate([limits, *more]))


def summaries(data, at):
    """Per range ``at[i]:at[i+1]`` of bytes, none empty: words, code points, begins in a word, ends in a word."""
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[at[:-1]] = inside[at[:-1]]
    return np.stack([segment_sums(first, at), segment_sums((data & 0xC0) != 0x80, at), inside[at[:-1]], inside[at[1:] - 1]], axis=1)


class ChunkMemory:
    """Summaries of chunks by content: a hash finds the chunk, its stored bytes confirm it."""

    def __init__(self, hasher=None, limit=CACHE_BYTES):
        self.hasher, self.limit, self.reused = hasher or Hasher(7), limit, 0
        self.known = Known()
        self._forget()

    def _forget(self):
        self.known.forget()
        self.bytes, self.at, self.table = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros((0, 4), np.int64)

    def __call__(self, data, limits):
        """The summary of every chunk ``limits[i]:limits[i+1]``."""
        out = np.zeros((len(limits) - 1, 4), np.int64)
        first = 0
        while first < len(out):  # a few megabytes at once, so that memory follows them and not the longest text
            end = max(first + 1, int(np.searchsorted(limits, limits[first] + RUN_BYTES, "right")) - 1)
            out[first:end] = self._some(data[limits[first] : limits[end]], limits[first : end + 1] - limits[first])
            first = end
        return out

    def _some(self, data, at):
        if len(self.bytes) > self.limit:
            self._forget()
        size = np.diff(at)
        rows, new = self.known.rows_of(self.hasher.ranges(data, at[:-1], at[1:]))
        if len(new):
            places, new_at = ragged(at[new], size[new])
            content = data[places]
            self.bytes = np.concatenate([self.bytes, content])
            self.at = np.concatenate([self.at, self.at[-1] + new_at[1:]])
            self.table = np.concatenate([self.table, summaries(content, new_at)])
        same = self.at[rows + 1] - self.at[rows] == size
        check = np.flatnonzero(same)
        check = check[~np.isin(check, new)]
        mine, check_at = ragged(at[check], size[check])
        stored, _ = ragged(self.at[rows[check]], size[check])
        same[check] = segment_sums(data[mine] != self.bytes[stored], check_at) == 0
        self.reused += int(same.sum()) - len(new)
        out = self.table[rows]
        other = np.flatnonzero(~same)  # another chunk with an equal hash
        if len(other):
            places, other_at = ragged(at[other], size[other])
            out[other] = summaries(data[places], other_at)
        return out


class UnitIndex:
    """The units of each text of a run and where they end, from the summaries of its chunks."""

    def __init__(self, data, offsets, memory: ChunkMemory):
        self.data, self.limits = data, chunk_limits(data, offsets)
        self.chunk_at = np.searchsorted(self.limits, offsets)
        words, points, begins, ends = memory(data, self.limits).T if len(data) else np.zeros((4, 0), np.int64)
        on = np.zeros(len(words), bool)  # a word goes on in the next chunk
        on[:-1] = (ends[:-1] & begins[1:]).astype(bool)
        filled = self.chunk_at[1:] > self.chunk_at[:-1]
        last = self.chunk_at[1:][filled] - 1
        on[last] = False
        self.ended = np.concatenate([[0], np.cumsum(words - on)])
        self.points = np.concatenate([[0], np.cumsum(points)])
        self.units = self.ended[self.chunk_at[1:]] - self.ended[self.chunk_at[:-1]]
        self.units[filled] += 1 - ends[last]
        self.chars = self.points[self.chunk_at[1:]] - self.points[self.chunk_at[:-1]]

    def chars_before(self, text, unit):
        """Code points in the first ``unit`` units of text number ``text`` (arrays of equal length)."""
        out = np.where(unit >= self.units[text], self.chars[text], 0)
        ask = np.flatnonzero((unit > 0) & (unit < self.units[text]))
        if not len(ask):
            return out
        text, wanted = text[ask], self.ended[self.chunk_at[text[ask]]] + unit[ask]
        chunk = np.searchsorted(self.ended, wanted, "left") - 1
        places, at = ragged(self.limits[chunk], self.limits[chunk + 1] - self.limits[chunk])
        inside = _INSIDE[self.data[places]]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        end[at[1:] - 1] = inside[at[1:] - 1]
        place = np.flatnonzero(end)
        hit = place[np.searchsorted(place, at[:-1]) + wanted - self.ended[chunk] - 1]
        points = np.concatenate([[0], np.cumsum((self.data[places] & 0xC0) != 0x80)])
        out[ask] = self.points[chunk] - self.points[self.chunk_at[text]] + points[hit + 1] - points[at[:-1]]
        return out


def _draws(id_col, seed: int) -> list[Column]:
    """Four numbers of 32 bits that follow from the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def cut_points(docs: DataFrame, low="low", high="high", text="text", keep=()) -> DataFrame:
    """Per row the ``keep`` columns, ``n`` units, and the code points before and between its two cuts.

    The cuts lie after ``low % (n + 1)`` and ``high % (n + 1)`` units, the smaller first. Rows are handled one by one.
    """
    source = docs.select(*keep, F.col(low).cast("bigint"), F.col(high).cast("bigint"), F.col(text))
    names = ("n", "prefix_chars", "middle_chars")
    schema = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = ChunkMemory()
        for batch in batches:
            draws = [batch.column(len(keep) + k).to_numpy(zero_copy_only=False) for k in range(2)]
            for first, end, data, offsets in text_runs(batch.column(len(keep) + 2)):
                index, texts = UnitIndex(data, offsets, memory), np.arange(end - first)
                cuts = [d[first:end] % (index.units + 1) for d in draws]
                before = index.chars_before(texts, np.minimum(*cuts))
                between = index.chars_before(texts, np.maximum(*cuts)) - before
                part = batch.slice(first, end - first)
                columns = [*(part.column(k) for k in range(len(keep))), *(pa.array(x.astype(np.int64)) for x in (index.units, before, between))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col="doc_id", text="text", seed=42, percent=50, suffix_first=80, marks=MARKS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every text, rearranged or as it is.

    ``n`` counts units: a run of other characters with the blanks (blank, tab to carriage return) before it,
    or the blanks at the end. Four draws from the seed and the id give the two cuts and the form. ``percent``
    of the texts become ``spm`` (suffix, prefix, middle; ``suffix_first`` percent of them) or ``psm``; the
    rest is ``plain``, as are empty texts and those that hold one of the marks, with null for their character counts.

    A null text counts as empty, and a null id draws as an empty one. Every row is handled by itself: repeated rows
    give repeated rows, and rows with equal ids and other texts have the same draws. Further columns are left out.
    """
    h = _draws("id", seed)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    holds_mark = F.contains("text", F.lit(marks[0])) | F.contains("text", F.lit(marks[1])) | F.contains("text", F.lit(marks[2]))
    plain = (F.col("text") == "") | holds_mark | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    drawn = rows.select("id", "text", form.alias("form"), h[0].alias("low"), h[1].alias("high"))
    cut = cut_points(drawn, keep=("id", "text", "form"))
    before, between = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), before), F.substring("text", before + 1, between)
    suffix = F.substring("text", before + between + 1, F.length("text"))
    p, s, m = map(F.lit, marks)
    output = (F.when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
              .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.col("text")))
    moved = F.col("form") != "plain"
    return cut.select(F.col("id").alias(id_col), "n", "form", *[F.when(moved, F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")], output.alias("output"))


def restore(output="output", form="form", marks=MARKS) -> Column:
    """The text that an output was made from: a rearranged one holds each mark once."""
    parts = F.split(F.col(output), "|".join(re.sub(r"(\W)", r"\\\1", x) for x in marks), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (F.when(F.col(form) == "spm", F.concat(part(2), part(3), part(1)))
            .when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.col(output)))
