"""Benchmark decontamination: training text that repeats a passage of a test set is found and removed.

The word windows of the test items become a hash set that is sent to every task. Texts are scanned
window by window; a window whose hash is in the set is compared word by word before it counts.

The set's size is checked before it is sent. A larger one is dealt into several sets, each scanned on
its own over the texts, and the hits are put together; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import staged
from .text_bytes import Hasher, lower_ascii, mix, ragged, segment_sums, text_runs

WINDOW = 10
#: Bytes of normalised item text in one set; as arrays a set takes up to thirty times that in a task.
SET_BYTES = 4 << 20
#: Windows of one slice of a long item, and word pairs that are compared at once.
SLICE_WINDOWS, COMPARED_AT_ONCE = 4096, 1 << 18

_BASE = 0x2545F4914F6CDD1D
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normal_words(data, offsets):
    """Lower-cased bytes, starts and ends of the words (digits, letters and all beyond ASCII), first word of each text."""
    low = lower_ascii(data)
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _INSIDE[low]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    first[cuts], last[cuts - 1] = inside[cuts + 1], inside[cuts]
    starts = np.flatnonzero(first)
    return low, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class WindowHasher:
    """Hashes of all windows of some words, from prefix sums over the hashes of words."""

    def __init__(self):
        self.words, self.up, self.down = Hasher(11), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n):
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            have = getattr(self, name)
            while len(have) <= n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
            setattr(self, name, have)

    def sums(self, data, starts, ends):
        n = len(starts)
        self._powers(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words.ranges(data, starts, ends) * self.up[:n], dtype=np.uint64, out=out[1:])
        return out

    def windows(self, sums, first, size):
        """The hash of the ``size`` words from each word ``first`` on."""
        return mix((sums[first + size] - sums[first]) * self.down[first] + np.uint64(size))


class WindowSet:
    """The windows of a number of items: by size their sorted hashes, first words and items."""

    def __init__(self, texts, items, size=WINDOW):
        self.hasher, self.by_size = WindowHasher(), []
        if not texts:
            return
        (_, _, data, offsets), = text_runs(pa.array(texts, pa.large_string()), 1 << 62)
        self.data, self.starts, self.ends, word_at = normal_words(data, offsets)
        sums, counts = self.hasher.sums(self.data, self.starts, self.ends), np.diff(word_at)
        items = np.asarray(items, np.int64)
        for length in sorted(set(np.minimum(counts, size).tolist()) - {0}):
            which = np.flatnonzero(np.minimum(counts, size) == length)
            first, at = ragged(word_at[which], counts[which] - length + 1)
            item = np.repeat(items[which], np.diff(at))
            hashes = self.hasher.windows(sums, first, length)
            # A window repeated in an item counts once; equal hashes of other words stay apart by what follows.
            order = np.lexsort((first, item, hashes))
            hashes, first, item = hashes[order], first[order], item[order]
            new = np.ones(len(hashes), bool)
            near = np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1]))
            new[near + 1] = ~self._equal(self, first[near + 1], first[near], length)
            hashes = hashes[new]
            # Most windows of a text are in no item; a table over some bits of the hashes tells most of them apart.
            bits = min(int(len(hashes) * 64).bit_length(), 24)
            seen = np.zeros(1 << bits, bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.by_size.append((length, hashes, first[new], item[new], seen, np.uint64(64 - bits)))

    def _equal(self, other, mine, theirs, size):
        """Whether the ``size`` words from ``mine`` on are those from ``theirs`` on in ``other`` (arrays)."""
        out = np.zeros(len(mine), bool)
        step = max(COMPARED_AT_ONCE // size, 1)
        for at in range(0, len(mine), step):
            k = np.arange(size)
            a, b = (mine[at : at + step, None] + k).ravel(), (theirs[at : at + step, None] + k).ravel()
            long_a, long_b = self.ends[a] - self.starts[a], other.ends[b] - other.starts[b]
            same = long_a == long_b
            pair = np.flatnonzero(same)
            places, ends = ragged(self.starts[a[pair]], long_a[pair])
            theirs_at, _ = ragged(other.starts[b[pair]], long_b[pair])
            same[pair] = segment_sums(self.data[places] != other.data[theirs_at], ends) == 0
            out[at : at + step] = same.reshape(-1, size).all(axis=1)
        return out

    def scan(self, words: NormalText):
        """(first word, words, item) of every occurrence of a window in the texts."""
        found = []
        sums = self.hasher.sums(words.data, words.starts, words.ends)
        counts = np.diff(words.word_at)
        for size, hashes, firsts, items, seen, shift in self.by_size:
            runs = np.maximum(counts - size + 1, 0)
            first, _ = ragged(words.word_at[:-1], runs)
            mine = self.hasher.windows(sums, first, size)
            maybe = np.flatnonzero(seen[mine >> shift])
            mine, first = mine[maybe], first[maybe]
            lo = np.searchsorted(hashes, mine, "left")
            many = np.searchsorted(hashes, mine, "right") - lo
            hit = many > 0
            lo, many, first = lo[hit], many[hit], first[hit]
            # An occurrence may belong to many items; they are expanded a part at a time.
            part = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), COMPARED_AT_ONCE), "right")
            for a, b in zip(part, [*part[1:], len(many)]):
                places, at = ragged(lo[a:b], many[a:b])
                word = np.repeat(first[a:b], np.diff(at))
                good = self._equal(words, firsts[places], word, size)
                found.append((word[good], np.full(good.sum(), size), items[places[good]]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found))


class NormalText:
    def __init__(self, data, offsets):
        self.data, self.starts, self.ends, self.word_at = normal_words(data, offsets)


def _slices(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, words, n_bytes): the normalised words of each item; a long item as slices that share ``window - 1`` words.

    A slice of an item with ``window`` words or more has as many too, so the slices' windows are the items'.
    """
    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(1)):
                found = NormalText(data, offsets)
                raw = found.data.tobytes()
                for i in range(end - first):
                    lo, hi = int(found.word_at[i]), int(found.word_at[i + 1])
                    name = batch.column(0)[first + i].as_py()
                    for at in range(lo, max(hi - window + 1, lo + 1), SLICE_WINDOWS):
                        part = range(at, min(hi, at + SLICE_WINDOWS + window - 1))
                        body = b" ".join(raw[found.starts[w] : found.ends[w]] for w in part).decode("utf-8", "replace")
                        if body:
                            yield pa.RecordBatch.from_pydict({"item": [name], "words": [body], "n_bytes": [len(body) + len(name) + 64]})

    return source.mapInArrow(cut, "item string, words string, n_bytes bigint").distinct()


def window_sets(benchmark: DataFrame, item="item_id", text="text", window=WINDOW, set_bytes=SET_BYTES) -> Iterator[tuple[list, list]]:
    """(texts, item names) of each set, one at a time on the driver, each below ``set_bytes``.

    Slices are dealt by hash into about twice as many sets as would do, more where one is too large. Only slices
    near that size themselves, 4,096 windows of very long words, can make a larger set.
    """
    slices = staged(_slices(benchmark, item, text, window), "items")
    total = slices.agg(F.sum("n_bytes")).first()[0] or 0
    number, dealt = 1, slices.withColumn("part", F.lit(0))
    if total > set_bytes:
        number = most = 2 * int(total // set_bytes) + 1
        while True:
            dealt = slices.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(number)).cast("int"))
            sizes = dealt.groupBy("part").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
            if number >= 16 * most or (sizes.where("n > 1").agg(F.max("b")).first()[0] or 0) <= set_bytes:
                break
            number *= 2
    for k in range(number):
        rows = dealt.where(F.col("part") == k).select("item", "words").collect()
        if rows:
            yield [r["words"] for r in rows], [r["item"] for r in rows]


_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def merge_spans(first, end):
    """Sorted spans without overlap that cover the same numbers; touching spans become one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    return first[at], end[np.append(at[1:], len(first)) - 1] if len(at) else end


def _scan(rows: DataFrame, texts: list, names: list, window: int) -> DataFrame:
    """``rows`` (row, text, n_words, spans, items) with the hits of one set added."""
    unique = sorted(set(names))
    number = {name: k for k, name in enumerate(unique)}
    shared = rows.sparkSession.sparkContext.broadcast((texts, [number[n] for n in names], unique))
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, items, unique = shared.value
        windows = WindowSet(texts, items, window)
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(1)):
                text = NormalText(data, offsets)
                part = batch.slice(first, end - first)
                spans, items = part.column(3).to_pylist(), part.column(4).to_pylist()
                word, size, item = windows.scan(text)
                doc = np.searchsorted(text.word_at, word, "right") - 1
                order = np.argsort(doc, kind="stable")
                docs, at = np.unique(doc[order], return_index=True)
                for i, mine in zip(docs.tolist(), np.split(order, at[1:])):
                    own = word[mine] - text.word_at[i]
                    old = np.array([(s["first"], s["end"]) for s in spans[i]], np.int64).reshape(-1, 2)
                    a, b = merge_spans(np.concatenate([own, old[:, 0]]), np.concatenate([own + size[mine], old[:, 1]]))
                    spans[i] = [{"first": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]
                    items[i] = sorted({*items[i], *(unique[k] for k in np.unique(item[mine]).tolist())})
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(text.word_at).astype(np.int64)),
                     pa.array(spans, part.schema.field(3).type), pa.array(items, part.schema.field(4).type)], names=schema.names)

    return rows.mapInArrow(run, schema)


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, text="text", item="item_id", item_text="text",
                        window=WINDOW, set_bytes=SET_BYTES) -> DataFrame:
    """(row, text, n_words, spans, items) of every document: ``row`` holds all its columns.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer; an item without
    words has none. ``spans`` are the runs of words (first, end; from 0) that lie in an occurrence of a window,
    ``items`` the names of the items that such windows belong to, in text order. Words are runs of digits,
    letters and characters beyond ASCII, A-Z lower-cased.

    A null text has no words. Repeated rows are handled alike and each returned. Items with equal ids are one
    item, an item with a null id has the empty name. Without items nothing is found.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    empty = F.array().cast("array<struct<first:bigint,end:bigint>>")
    rows = docs.select(row.alias("row"), F.col(text).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                       empty.alias("spans"), F.array().cast("array<string>").alias("items"))
    sets = iter(window_sets(benchmark, item, item_text, window, set_bytes))
    now, following = next(sets, ([], [])), next(sets, None)
    rows = _scan(rows, *now, window)
    while following is not None:
        rows = _scan(staged(rows, "scanned"), *following, window)
        following = next(sets, None)
    return rows


def report(found: DataFrame, id_col="doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of what :func:`find_benchmark_text` returns."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(F.col(f"row.`{id_col}`").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        "items", (F.size("spans") > 0).alias("contaminated"))


def remove_documents(found: DataFrame, share=0.0) -> DataFrame:
    """The documents of :func:`find_benchmark_text` with at most this share of their words in benchmark passages."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.where(hit <= share * F.col("n_words")).select("row.*")


def remove_spans(found: DataFrame, text="text") -> DataFrame:
    """All documents of :func:`find_benchmark_text`, ``text`` without its benchmark passages.

    A passage goes from its first word's first character to its last word's last; what stands between words of
    the rest stays. A text without hits, a null one too, stays as it is.
    """
    kind = found.schema["row"].dataType
    cut = found.select("row", F.col("text").alias("_text"), "spans")
    schema = T.StructType([T.StructField("row", kind), T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(1)):
                part = batch.slice(first, end - first)
                new = part.column(1).to_pylist()
                words = NormalText(data, offsets)
                for i, spans in enumerate(part.column(2).to_pylist()):
                    if spans:
                        raw, at = data[offsets[i] : offsets[i + 1]].tobytes(), words.word_at[i]
                        cuts = [(int(words.starts[at + s["first"]] - offsets[i]), int(words.ends[at + s["end"] - 1] - offsets[i])) for s in spans]
                        keep = zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(raw)])
                        new[i] = b"".join(raw[a:b] for a, b in keep).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, batch.schema.field(1).type)], names=schema.names)

    names = [f.name for f in kind.fields]
    return cut.mapInArrow(run, schema).select(*[F.col("_text").alias(c) if c == text else F.col(f"row.`{c}`") for c in names])
