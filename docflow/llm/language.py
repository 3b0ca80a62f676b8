"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed per task, label and feature before the shuffle; the finished log-probability
matrix has a fixed number of features and one column per label, and only it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_bytes import mix, text_runs

FEATURES, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
#: Cells of the broadcast matrix; more labels than it has room for are refused.
MAX_CELLS = 1 << 24
UNKNOWN = "und"


def n_gram_features(data, offsets, features=FEATURES, orders=ORDERS):
    """Feature numbers of each text's n-grams of letters, lower-cased, any other characters as one
    blank; and per text the number of its first feature. A text without letters has no features."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if at[-1] != len(points):  # bytes that are no UTF-8
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    table = np.zeros(int(points.max()) + 1, np.uint32)
    for p in np.flatnonzero(np.bincount(points)):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            table[p] = ord(low) if len(low) == 1 else p
    codes = table[points]
    blank = codes == 0
    # Of a stretch of blanks one stays; a blank also stands before and after each text.
    drop = np.zeros(len(codes), bool)
    drop[1:] = blank[1:] & blank[:-1]
    starts = at[:-1][at[:-1] < len(codes)]
    drop[starts] = blank[starts]
    left = np.concatenate([[0], np.cumsum(~drop)])[at]
    texts = len(offsets) - 1
    size = left[-1] + texts + 1
    line = np.zeros(size, np.uint64)
    kept = codes[~drop]
    text = np.repeat(np.arange(texts), np.diff(left))
    line[np.arange(len(kept)) + text + 1] = kept
    owner = np.concatenate([np.repeat(np.arange(texts), np.diff(left) + 1), [texts]])
    out, who = [], []
    for n in orders:
        if size < n:
            continue
        hashed = np.full(size - n + 1, n, np.uint64)
        letters = np.zeros(size - n + 1, np.int8)
        for k in range(n):
            part = line[k : size - n + 1 + k]
            hashed = hashed * np.uint64(0x100000001B3) + part
            letters += part != 0
        # A window starts at its text's leading blank or later and ends at the next text's one at the latest.
        inside = (owner[: size - n + 1] == owner[n - 1 :]) | ((line[n - 1 :] == 0) & (owner[: size - n + 1] == owner[max(n - 2, 0) : size - 1] if n > 1 else False))
        good = inside & (letters >= max(1, n - 1))
        out.append((mix(hashed[good]) % np.uint64(features)).astype(np.int64))
        who.append(owner[: size - n + 1][good])
    features_, who_ = np.concatenate(out), np.concatenate(who)
    order = np.argsort(who_, kind="stable")
    return features_[order], np.searchsorted(who_[order], np.arange(texts + 1))


def feature_counts(train: DataFrame, text="text", label="lang", features=FEATURES) -> DataFrame:
    """(label, docs, numbers, counts): features of each label's texts, summed over all rows.

    Every task first sums its own rows; a label's parts then meet by ranges of feature numbers.
    """
    ranges = 16
    step = features // ranges
    part = "label string, part int, docs long, numbers array<int>, counts array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for first, end, data, offsets in text_runs(batch.column(0)):
                found, at = n_gram_features(data, offsets, features)
                of = np.array(labels[first:end], object)
                for name in dict.fromkeys(of):
                    mine = of == name
                    picked = found[np.repeat(mine, np.diff(at))]
                    if name not in sums:
                        sums[name], docs[name] = np.zeros(features, np.int64), 0
                    sums[name] += np.bincount(picked, minlength=features)
                    docs[name] += int(mine.sum())
        for name, total in sums.items():
            for k in range(ranges):
                there = np.flatnonzero(total[k * step : (k + 1) * step])
                yield pa.RecordBatch.from_pydict({
                    "label": [name], "part": pa.array([k], pa.int32()), "docs": [docs[name]],
                    "numbers": pa.array([(there + k * step).astype(np.int32)], pa.list_(pa.int32())),
                    "counts": pa.array([total[there + k * step]], pa.list_(pa.int64()))})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(step, np.int64), 0
        first = key[1].as_py() * step
        for b in batches:
            docs += sum(b.column("docs").to_pylist())
            np.add.at(total, b.column("numbers").flatten().to_numpy() - first, b.column("counts").flatten().to_numpy())
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({
            "label": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()], pa.int32()), "docs": [docs],
            "numbers": pa.array([(there + first).astype(np.int32)], pa.list_(pa.int32())),
            "counts": pa.array([total[there]], pa.list_(pa.int64()))})

    return (train.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
            .mapInArrow(count, part).groupBy("label", "part").applyInArrow(add, part))


def fit(train: DataFrame, text="text", label="lang", features=FEATURES):
    """(labels, matrix): log-probabilities of features by label, the label's prior in the last row.

    The matrix has ``features + 1`` rows and a column per label; labels for which it would have more than
    MAX_CELLS cells are refused before any text is read.
    """
    most = MAX_CELLS // (features + 1)
    named = train.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"))
    if named.distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels need more than {MAX_CELLS} cells; use fewer features")
    # At most MAX_CELLS numbers, whatever the rows.
    parts = feature_counts(train, text, label, features).collect()
    labels = sorted({r["label"] for r in parts})
    counts, docs = np.zeros((features, len(labels))), np.zeros(len(labels))
    for r in parts:
        k = labels.index(r["label"])
        counts[np.array(r["numbers"], np.int64), k] = r["counts"]
        docs[k] = r["docs"]
    matrix = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * features)
    return labels, np.vstack([matrix, np.log(docs / max(docs.sum(), 1))]).astype(np.float32)


def identify(docs: DataFrame, model, text="text", keep=("doc_id",), features=FEATURES) -> DataFrame:
    """``lang_pred`` and ``score``, the posterior of the label, for the whole text of every row.

    A text that is null, empty or without letters, and any text if no label was learned, gets ``und``
    with score 0. Equal posteriors go to the first label in name order. Rows are judged one by one, so
    repeated rows and null ids are kept as they are; further columns are left out.

    A run of texts is a sparse matrix of feature numbers by row. It is multiplied with the weights of one label
    after the other, so memory follows the run's features and not their product with the labels.
    """
    from pyspark.sql import types as T

    labels, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*[source.schema[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        names = np.array([*labels, UNKNOWN], object)
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(len(keep))):
                found, at = n_gram_features(data, offsets, features)
                n = np.diff(at)
                best, share = np.full(end - first, len(labels)), np.zeros(end - first)
                if labels and len(found):
                    sums = np.zeros((end - first, len(labels)))
                    some = np.flatnonzero(n)
                    for k, column in enumerate(weights):
                        sums[some, k] = np.add.reduceat(column[found], at[:-1][some], dtype=np.float64) + column[features]
                    top = sums.argmax(1)
                    post = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                    best[some], share[some] = top[some], post[some]
                part = batch.slice(first, end - first)
                columns = [*[part.column(i) for i in range(len(keep))], pa.array(names[best], pa.string()), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(score, schema)
