"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 64 values of 16 bits. Two documents whose similarity reaches the limit differ in at
most ``2 * chunks - 1`` of them, but for a chance that ``chunks_for`` keeps below MISS. Split into
``chunks`` parts, at least one part then differs in one value at most (pigeonhole). So each signature
is filed under every part with any one value left out, and all pairs under the distance meet in a file.

No file is ever expanded into its pairs. First all members are compared with the file's smallest one;
components of the confirmed links follow. In files that still hold several components, the members
outside the largest are compared with a few members of it. Only files that are parted even then are
looked into, in blocks; only pairs of different components below the distance leave a block, each from
the first of the files that it shares, and only if signatures of FINE more values of 8 bits agree too. Equal sets count as one class throughout, so copies cost nothing
after the first aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .marks import with_mark
from .staging import staged
from .text_bytes import Hasher, lower_ascii, mix, shingles, text_runs, words

VALUES, FINE, MISS, BLOCK, PIVOTS = 64, 1024, 2e-5, 512, 4


def chunks_for(similarity: float, values=VALUES, miss=MISS) -> int:
    """The fewest parts for which a pair at the limit exceeds the distance with a chance below ``miss``."""
    p = 1 - similarity
    for chunks in range(1, values // 2 + 1):
        tail = sum(comb(values, d) * p**d * (1 - p) ** (values - d) for d in range(2 * chunks, values + 1))
        if tail <= miss:
            return chunks
    raise ValueError("the similarity is too low for this signature")


def fine_distance(similarity: float, values=FINE, miss=MISS) -> int:
    """The distance of fine signatures that a pair at the limit exceeds with a chance below ``miss``."""
    p, tail = (1 - similarity) * 255 / 256, 1.0
    for d in range(values + 1):
        tail -= comb(values, d) * p**d * (1 - p) ** (values - d)
        if tail <= miss:
            return d
    return values


def patterns(chunks: int, values=VALUES) -> list[np.ndarray]:
    """The signature positions that stay of each part with each one value left out.

    Pattern number k leaves out value k, so there are as many patterns as values.
    """
    parts = np.array_split(np.arange(values), chunks)
    return [np.delete(part, k) for part in parts for k in range(len(part))]


def text_sets(data, offsets, hasher, size):
    """Distinct shingle hashes of each text, end to end, and where each text's begin."""
    low = lower_ascii(data)
    starts, ends, word_at = words(low, offsets)
    runs, run_at = shingles(hasher.ranges(low, starts, ends), word_at, size)
    sets = [np.unique(runs[a:b]) for a, b in zip(run_at[:-1], run_at[1:], strict=True)]
    return (np.concatenate(sets) if sets else runs), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(sets, at, values=VALUES, first=0):
    """A row of 16-bit values for each set that is not empty: low bits of the least hash under each of many maps."""
    some = np.flatnonzero(np.diff(at))
    starts = at[:-1][some]
    odd = mix(np.arange(first + 1, first + values + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    plus = mix(odd)
    out = np.zeros((len(at) - 1, values), np.uint16)
    if len(some):
        for k in range(values):
            out[some, k] = (mix(np.minimum.reduceat(mix_lite(sets, odd[k], plus[k]), starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def mix_lite(x, odd, plus):
    return (x ^ (x >> np.uint64(29))) * odd + plus


def profiles(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, n_shingles, set_1, set_2, signature) per row; the set's two numbers identify it."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "set_1", "set_2")],
                           T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(1)):
                sets, at = text_sets(data, offsets, hasher, size)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(k)), dtype=np.uint64)]) for k in (1, 2)]
                marks = [mix(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                found = signatures(sets, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(at)), pa.array(marks[0]), pa.array(marks[1]),
                     pa.array([r.tobytes() for r in found], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def _matrix(column, kind=np.uint16, values=VALUES) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), values)


def filed(classes: DataFrame, chunks: int) -> DataFrame:
    """(file, node): every class under each of its patterns; a file's last bits are its pattern's number."""
    plan = patterns(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(nodes), 8192):
                signs = _matrix(batch.column(1).slice(a, 8192)).astype(np.uint64)
                keys = np.empty((len(signs), len(plan)), np.uint64)
                for k, places in enumerate(plan):
                    key = np.full(len(signs), k + 1, np.uint64)
                    for place in places:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signs[:, place])
                    keys[:, k] = (key & ~np.uint64(VALUES - 1)) | np.uint64(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes[a : a + 8192], len(plan)))], names=["file", "node"])

    return classes.select("node", "signature").mapInArrow(run, "file long, node long")


def _close(pairs: DataFrame, distance: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures are near enough and whose set sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1) <= distance
            yield batch.select([0, 1]).filter(pa.array(near))

    sized = pairs.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return sized.select("a", "b", "a_signature", "b_signature").mapInArrow(run, "a long, b long")


def _with_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    out = pairs
    for side in "ba":  # many pairs may share b: they meet it while their rows are short
        own = classes.select(F.col("node").alias(f"_{side}"), F.col("n_shingles").alias(f"{side}_n"), F.col("signature").alias(f"{side}_signature"))
        out = out.join(own, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    return out


def _fine(texts: DataFrame, size: int) -> DataFrame:
    """(node, n_shingles, signature, fine) of each text; the fine signature has further values of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(1)):
                sets, at = text_sets(data, offsets, hasher, size)
                coarse, fine = signatures(sets, at), signatures(sets, at, FINE, VALUES).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(at)), *[pa.array([r.tobytes() for r in found], pa.binary()) for found in (coarse, fine)]],
                    names=["node", "n_shingles", "signature", "fine"])

    return texts.select("id", "text").mapInArrow(run, "node long, n_shingles long, signature binary, fine binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity; both texts are read and compared whole.

    A pair comes several times if its ids stand for several texts. Many pairs may share b, which joins
    first, while their rows are short; few share a.
    """
    left = texts.select(F.col("id").alias("_a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("_b"), F.col("text").alias("b_text"))
    both = pairs.join(right, F.col("b") == F.col("_b")).drop("_b").join(left, F.col("a") == F.col("_a")).drop("_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                sides = []
                for k in (2, 3):
                    column = pc.dictionary_encode(part.column(k))  # one text often meets many
                    found = []
                    for _, _, data, offsets in text_runs(column.dictionary):
                        sets, at = text_sets(data, offsets, hasher, size)
                        found += [sets[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                    sides.append((column.indices.to_numpy(), found))
                (ia, sa), (ib, sb) = sides
                for k in range(len(part)):
                    x, y = sa[ia[k]], sb[ib[k]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good[a + k] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def _first_shared(equal, part_starts):
    """The number of the first pattern in which signatures agree, given which of their values are equal."""
    wrong = np.add.reduceat(~equal, part_starts, axis=1)
    part = (wrong <= 1).argmax(1)
    inside = np.arange(equal.shape[1])[None, :] >= part_starts[part][:, None]
    left_out = (~equal & inside).argmax(1)
    return np.where(wrong[np.arange(len(part)), part] == 1, left_out, part_starts[part])


def _across(members: DataFrame, chunks: int, distance: int, fine: int, percent: int) -> DataFrame:
    """Pairs of different components that share a file and are near enough.

    ``members`` has file, node, component, n_shingles, signature, fine, the file's largest component ``main``
    and its numbers of ``blocks`` and of ``rest_blocks`` for members outside ``main``. Every block of the
    rest meets every block of the file, so no task holds a whole file, and ``main`` never meets itself.
    """
    spot = F.xxhash64("node")
    columns = ["node", "component", "main", "n_shingles", "signature", "fine"]
    upto = lambda c, place: F.transform(F.sequence(F.lit(0).cast("long"), F.col(c) - 1), place)
    meets = lambda block, rest_block, rest: F.struct(block.alias("block"), rest_block.alias("rest_block"), F.lit(rest).alias("rest"))
    every = upto("rest_blocks", lambda k: meets(F.pmod(spot, F.col("blocks")), k, False))
    rest = upto("blocks", lambda k: meets(k, F.pmod(spot, F.col("rest_blocks")), True))
    dealt = members.select("file", *columns, F.explode(F.when(F.col("component") != F.col("main"), F.concat(every, rest)).otherwise(every)).alias("at"))
    keys = ["file", "block", "rest_block"]
    part_starts = np.array([p[0] for p in np.array_split(np.arange(VALUES), chunks)])

    def pairs(rows: pa.Table, out_a: list, out_b: list) -> None:
        node, comp, main, n, rest_ = (rows.column(c).to_numpy() for c in ("node", "component", "main", "n_shingles", "rest"))
        signs, fines = _matrix(rows.column("signature")), _matrix(rows.column("fine"), np.uint8, FINE)
        left, right = np.flatnonzero(rest_), np.flatnonzero(~rest_)
        pattern = rows.column("file")[0].as_py() & (VALUES - 1)
        for k in range(0, len(left), 64):
            i, j = (x.ravel() for x in np.meshgrid(left[k : k + 64], right, indexing="ij"))
            once = (comp[j] == main[j]) | (node[i] > node[j])  # two of the rest meet twice
            fit = once & (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[fit], j[fit]
            equal = signs[i] == signs[j]
            near = (~equal).sum(1) <= distance
            near[near] = _first_shared(equal[near], part_starts) == pattern
            near[near] = (fines[i[near]] != fines[j[near]]).sum(1) <= fine
            out_a.append(np.maximum(node[i[near]], node[j[near]]))
            out_b.append(np.minimum(node[i[near]], node[j[near]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not len(held):
                continue
            marks = [held.column(c).to_numpy() for c in keys]
            change = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            limits = [0, *change.tolist(), *([len(held)] if batch is None else [])]
            out_a, out_b = [], []
            for a, b in zip(limits[:-1], limits[1:], strict=True):
                if b - a > 1:
                    pairs(held.slice(a, b - a), out_a, out_b)
            held = held.slice(limits[-1]).combine_chunks()
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return dealt.select("file", "at.*", *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _unlike(pairs: DataFrame, others: DataFrame) -> DataFrame:
    other = others.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return pairs.join(other, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")


def _linked(parts: DataFrame) -> DataFrame:
    """Links (a, b) that keep each component (node, component) together, one for each further node."""
    return parts.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _parted(members: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """The members (file, node, n) of files with several components, with their own and the file's largest one,
    and the number of blocks of members outside that one."""
    placed = staged(members.join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "file", "node", "n", F.coalesce("component", "node").alias("component")), f"{name}-placed")
    counted = placed.repartition("file").groupBy("file", "component").agg(F.count("*").alias("k")).groupBy(F.col("file").alias("_file")).agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), (F.sum("k") - F.max("k")).alias("rest"))
    mixed = counted.where("rest > 0").withColumn("rest_blocks", F.ceil(F.col("rest") / BLOCK).cast("long"))
    return staged(placed.join(mixed, F.col("file") == F.col("_file")).drop("_file"), f"{name}-open")


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col="doc_id", text="text", size=5, similarity=0.8) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row, by links of shingle-set similarity or more.

    Words are lower-cased in A-Z; a text with fewer than ``size`` words has its whole sequence as its
    one shingle. Null and empty texts have no shingles and link with nothing. ``component_id`` is the
    smallest id reachable by links, ``kept`` whether it is the row's own. A row with a null id links
    with nothing and is kept, without a component. Rows that share an id share a node of the graph, so
    repeated rows get equal results. Further columns are left out. ``similarity`` counts in whole
    percent. An empty table gives an empty result.
    """
    percent = round(100 * similarity)
    chunks = chunks_for(percent / 100)
    distance = 2 * chunks - 1
    rows = staged(profiles(docs, id_col, text, size), "profiles")
    some = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    key = ["set_1", "set_2"]
    # Equal sets have equal signatures, so any of a class's will do.
    classes = staged(rows.where(some).groupBy(*key).agg(
        F.min("id").cast("long").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    # Files with several members, and then those members.
    files = filed(classes, chunks)
    shared = files.groupBy(F.col("file").alias("_file")).agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = staged(files.join(shared, F.col("file") == F.col("_file")).drop("_file"), "members")
    stars = staged(members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    near = stars.select(F.explode(F.array("a", "b")).alias("_id"))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    texts = staged(with_mark(whole, "id", near).where("maybe").drop("maybe").join(near.distinct(), F.col("id") == F.col("_id"), "left_semi"), "texts")
    parts = components(_confirmed(_close(_with_signatures(stars, classes), distance, percent), texts, size, percent))
    # Files of three and more members may still part what belongs together.
    open_ = _parted(members.where("n > 2").select("file", "node", "n"), parts, "first")
    outside = open_.where("component != main").select("file", "node")
    inside = open_.where("component = main").groupBy(F.col("file").alias("_file")).agg(
        *[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("node"))).alias(f"p{k}") for k in range(PIVOTS)])
    tried = outside.join(inside, F.col("file") == F.col("_file")).select("node", F.explode(F.array(*[f"p{k}.node" for k in range(PIVOTS)])).alias("other"))
    tried = staged(_unlike(tried.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), stars), "tried")
    close = staged(_close(_with_signatures(tried, classes), distance, percent), "pivot-pairs")
    parts = components(_linked(parts).unionByName(_confirmed(close, texts, size, percent)))
    open_ = _parted(open_.select("file", "node", "n"), parts, "second").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    wanted = with_mark(texts, "id", open_.select("node")).where("maybe")
    fines = staged(_fine(wanted, size).where("n_shingles > 0"), "fine")
    across = _across(open_.join(fines.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node"), chunks, distance, fine_distance(percent / 100), percent)
    fresh = staged(_unlike(_unlike(across, stars), tried), "across-pairs")
    parts = components(_linked(parts).unionByName(_confirmed(fresh, texts, size, percent)))
    named = classes.join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        *[F.col(c).alias(f"_{c}") for c in key], F.coalesce("component", "node").alias("component_id"))
    linked = rows.where(some).join(named, [F.col(c) == F.col(f"_{c}") for c in key]).select("id", "n_shingles", "component_id")
    alone = rows.where(~some | F.col("id").isNull()).select("id", "n_shingles", F.col("id").cast("long").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
