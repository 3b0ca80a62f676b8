"""Packing without padding: every document is cut into pieces whose lengths are powers of two.

A document of n tokens gives full windows and then one piece for each binary digit of what is left.
A sequence is one piece, so no sequence holds two documents, and pieces of equal length form a
bucket. Nothing is shuffled: lengths follow from each document alone.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_bytes import Hasher, Known, Lists, lower_ascii, text_runs

WINDOW = 4096
RUN = 2 << 20


def pieces(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens, longest first."""
    out, at = [], 0
    while at < n:
        length = min(window, 1 << ((n - at).bit_length() - 1))
        out.append((at, length))
        at += length
    return out


class StretchIds:
    """Ids of whole texts, each distinct stretch of a task encoded once.

    For a vocabulary of words that lower-cases and drops white space (runs of letters, single digits,
    runs of other characters): blanks, tabs and line ends part stretches, and so does any place between
    an ASCII letter and an ASCII sign other than the apostrophe. No id reaches across these places. Texts
    that spell one of the vocabulary's special tokens are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write the bytes that do not print as letters from 256 on.
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printed]
        self.letters = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        probes = ["a", "the", "Packing", "straße", "Été", "señorón", "xqzjkvw", "ÀÖØÞàöøÿ"]
        if [self._direct(p) for p in probes] != self._whole(probes):
            self.plain = lambda text: None
        kind = np.zeros(256, np.uint8)
        kind[[9, 10, 13, 32]] = 1
        kind[97:123] = 2
        kind[[b for b in range(33, 127) if not (chr(b).isalnum() or b == 39)]] = 3
        self.kind = kind
        self.hasher, self.known, self.ids = Hasher(3), Known(1 << 19), Lists()

    def _direct(self, word: str) -> list[int]:
        """Ids of a run of plain Latin letters: lower-cased, its bytes in the vocabulary's letters, then merged."""
        return [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in word.lower().encode()]))]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches end to end, and the number of ids of each."""
        plain = [self.plain(t) is not None for t in texts]
        rest = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        found = [self._direct(t) if p else next(rest) for t, p in zip(texts, plain, strict=True)]
        return np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found])

    def __call__(self, data, offsets):
        """All ids of a run of texts, and where each text's ids begin."""
        if self.known.size > self.known.limit:
            self.known.forget()
            self.ids = Lists()
        low = lower_ascii(data)
        kind = self.kind[low]
        inside = kind != 1
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data):
            before, after = kind[:-1], kind[1:]
            cut[1:-1] |= (before == 1) | (after == 1) | ((before == 2) & (after == 3)) | ((before == 3) & (after == 2))
        starts = np.flatnonzero(cut[:-1] & inside)
        ends = np.flatnonzero(cut[1:] & inside) + 1
        rows, first = self.known.rows_of(self.hasher.ranges(low, starts, ends))
        raw = low.tobytes()
        for k in range(0, len(first), 20_000):
            new = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[k : k + 20_000]], ends[first[k : k + 20_000]], strict=True)]
            self.ids.add(*self._encode(new))
        values, at = self.ids.take(rows)
        text_at = at[np.searchsorted(starts, offsets)]
        whole = data.tobytes()
        if any(s in whole for s in self.special):
            parts = []
            for i in range(len(offsets) - 1):
                text = whole[offsets[i] : offsets[i + 1]]
                if any(s in text for s in self.special):
                    parts.append(np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64))
                else:
                    parts.append(values[text_at[i] : text_at[i + 1]])
            values, text_at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return values, text_at


def pack(docs: DataFrame, vocabulary: str, id_col="doc_id", text="text", end_id=2, window=WINDOW, with_ids=True) -> DataFrame:
    """One row per piece: its document, place, checksum, sequence, the bucket of its length, and its ids.

    Every document is its ids and then ``end_id``; a null or empty text is that one id. ``vocabulary``
    is a tokenizer file that every executor can open. Each input row is packed by itself, so repeated
    rows and null ids are packed as often as they occur; further columns are left out. Sequence numbers
    are unique in a result and differ between runs of another partitioning. ``with_ids=False`` leaves the
    ids out of the rows once their checksum is taken.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    source = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("_text"))
    schema = T.StructType([
        source.schema[id_col], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "offset", "bucket")],
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = StretchIds(vocabulary)
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(1), RUN):
                values, at = encode(data, offsets)
                n = end - first
                tokens = np.insert(values, at[1:], end_id).astype("<u4")
                limits = at + np.arange(n + 1)
                rows = []
                for i in range(n):
                    total = int(limits[i + 1] - limits[i])
                    for start, length in pieces(total, window):
                        here = int(limits[i]) + start
                        rows.append((first + i, start, length, zlib.crc32(tokens[here : here + length]), total, 0, length.bit_length() - 1))
                numbers = np.array(rows, np.int64).reshape(-1, 7)
                columns = [pc.take(batch.column(0), pa.array(numbers[:, 0])), *[pa.array(numbers[:, k]) for k in range(1, 7)]]
                if with_ids:  # the pieces lie end to end in document order
                    cuts = np.concatenate([[0], np.cumsum(numbers[:, 2])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, so that a reader takes batches of equal lengths without padding."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
