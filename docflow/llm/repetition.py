"""Quality rules on repetition: how much of a text lies inside duplicated word runs and lines.

Runs of several lengths and lines are compared by 64-bit rolling hashes in numpy, batch by batch,
so the operator shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_bytes import Hasher, mix, segment_sums, shingles, text_runs, words

LENGTHS = (2, 3, 5, 8)
#: Largest fraction of word characters inside duplicated runs of that many words, and inside repeated lines. Each
#: is the 99.5th percentile, rounded up, of the texts labelled good outside the held-out fifth that pass
#: the base's rules (0.187, 0.178, 0.168, 0.168 and 0.084 at sf0.1).
RUN_LIMITS = {2: 0.19, 3: 0.18, 5: 0.17, 8: 0.17}
LINE_LIMIT = 0.085
#: Most symbols for a word.
SYMBOL_LIMIT = 0.30
MIN_WORDS = 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_punct", "n_letters", "n_dup_lines", "n_lines",
           "n_distinct_words", "top_word", "dup_line_chars")


def count_names(lengths=LENGTHS) -> list[str]:
    return [*_COUNTS, *(["n_repeat_words"] if 3 in lengths else []), *(f"dup_chars_{n}" for n in lengths)]


def _again(hashes, at):
    """Which hashes occur twice or more in their text, which are not the one counted first of several,
    and the longest group of equals of each text."""
    texts = len(at) - 1
    text = np.repeat(np.arange(texts), np.diff(at))
    mine = mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal in one text only
    order = np.argsort(mine)
    h = mine[order]
    same = np.zeros(len(h) + 1, bool)
    if len(h):
        same[1:-1] = h[1:] == h[:-1]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    groups = np.flatnonzero(~same[:-1]) if len(h) else np.zeros(0, np.int64)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text[order[groups]], np.diff(np.concatenate([groups, [len(h)]])))
    return twice, later, longest


def _covered(twice, run_at, word_at, size):
    """The words of a text that lie in a marked run of ``size`` words."""
    marks = np.zeros(word_at[-1] + 1, np.int64)
    counts = np.diff(word_at)
    text = np.repeat(np.arange(len(counts)), np.diff(run_at))
    first = word_at[:-1][text] + np.arange(run_at[-1]) - run_at[:-1][text]
    first = first[twice & (counts[text] >= size)]
    np.add.at(marks, first, 1)
    np.add.at(marks, first + size, -1)
    return np.cumsum(marks)[:-1] > 0


def text_counts(data, offsets, hasher, lengths=LENGTHS) -> dict:
    """The counts of every text of a run, by name."""
    kinds = {"n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_digits": b"0123456789",
             "n_punct": b"!\"'()+,-./:;=?@[\\]^_`{}~"}
    codes = np.zeros(256, np.uint8)
    for k, chars in enumerate(kinds.values(), 1):
        codes[list(chars)] = k
    codes = codes[data]
    out = {name: segment_sums(codes == k, offsets) for k, name in enumerate(kinds, 1)}
    points = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(points)])
    starts, ends, word_at = words(data, offsets)
    chars = before[ends] - before[starts]
    out["n_words"], out["word_chars"] = np.diff(word_at), segment_sums(chars, word_at)
    out["n_letters"] = out["word_chars"] - out["n_symbols"] - out["n_digits"] - out["n_punct"]
    hashes = hasher.ranges(data, starts, ends)
    _, later, out["top_word"] = _again(hashes, word_at)
    out["n_distinct_words"] = out["n_words"] - segment_sums(later, word_at)
    for size in lengths:
        runs, run_at = shingles(hashes, word_at, size)
        twice, _, _ = _again(runs, run_at)
        covered = _covered(twice, run_at, word_at, size)
        out[f"dup_chars_{size}"] = segment_sums(np.where(covered, chars, 0), word_at)
        if size == 3:
            out["n_repeat_words"] = segment_sums(covered, word_at)
    # Lines end at a line feed or with their text.
    feeds = np.flatnonzero(data == 10)
    limits = np.unique(np.concatenate([offsets, feeds, feeds + 1]))
    line_starts, line_ends = limits[:-1], limits[1:]
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_at = np.searchsorted(line_starts, offsets)
    _, later, _ = _again(hasher.ranges(data, line_starts, line_ends), line_at)
    first_word, end_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    word_total = np.concatenate([[0], np.cumsum(chars)])
    out["n_lines"], out["n_dup_lines"] = np.diff(line_at), segment_sums(later, line_at)
    out["dup_line_chars"] = segment_sums(np.where(later, word_total[end_word] - word_total[first_word], 0), line_at)
    return out


def with_counts(docs: DataFrame, text="text", keep=("doc_id",), lengths=LENGTHS) -> DataFrame:
    """The ``keep`` columns of every row and the counts of its whole text (null counts as empty).

    One row per input row, repeated rows included; a kept column may not have the name of a count. The counts describe bytes, characters, words and
    lines; a word's hash stands for it, so its case matters.
    """
    source = docs.select(*keep, F.col(text).alias("_counted_text"))
    fields = [source.schema[k] for k in keep]
    names = count_names(lengths)
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in names]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(len(keep))):
                found = text_counts(data, offsets, hasher, lengths)
                part = batch.slice(first, end - first)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(np.asarray(found[c], np.int64)) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(count, schema)


def repetition_rules(docs: DataFrame, text="text", keep=("doc_id",), min_words=MIN_WORDS) -> DataFrame:
    """Counts, coverage fractions and the verdict for every text.

    ``base_failed``: fewer than ``min_words`` words, or over half of the words in repeated three-word
    runs. ``kept`` is false for those, and for texts whose duplicated runs, repeated lines or symbols
    exceed the limits above. A null or empty text has no words and is not kept. Rows are judged one by
    one, so ties, repeated rows, null ids and further columns have no effect.
    """
    counted = with_counts(docs, text, keep)
    words_, chars = F.col("n_words"), F.col("word_chars")
    share = lambda c: F.when(chars > 0, F.col(c) / chars).otherwise(F.lit(0.0))
    base = (words_ < min_words) | (100 * F.col("n_repeat_words") > 50 * words_)
    good = (share("dup_line_chars") <= LINE_LIMIT) & (F.col("n_symbols") <= SYMBOL_LIMIT * words_)
    for size, limit in RUN_LIMITS.items():
        good = good & (share(f"dup_chars_{size}") <= limit)
    return counted.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("dup_line_chars").alias("dup_line_coverage"),
        *[share(f"dup_chars_{n}").alias(f"dup_coverage_{n}") for n in LENGTHS],
        base.alias("base_failed"), (~base & good).alias("kept"))
