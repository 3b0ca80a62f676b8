"""Near-duplicate embeddings: a small-world graph per shard, every shard queried, links checked exactly.

Vectors of a label are dealt into shards of about SHARD_ROWS. When a shard's graph is built its recall is audited:
for every vector a partner just above the limit is planted, in a direction of its own, and searched. The beam
widens until all but a thousandth of the vectors are found by their partners; those that are not even found by the widest
beam are listed as lost.

Each pair of shards of a label is one task: the vectors of each query the graph of the other with the audited beam, and
the few lost vectors are compared with all. A query whose beam holds nothing but links is asked again with a wider one,
and compared with the whole shard only if the widest is full too. A task returns counts and a spanning forest of its
links, never the links themselves, so a cluster of any size gives as many rows as it has vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .hnsw import Graph
from .staging import staged

SHARD_ROWS, BEAM, WIDEST, RECALL = 8192, 32, 256, 0.999
_SLACK = 1e-4  # float32 similarities this far below the limit are still checked


def _exact(unit_a, unit_b, rows, limit, same):
    """Blocks (rows, mask of links) of exact comparison of some rows of one side with all of the other."""
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        mask = unit_a[part] @ unit_b.T >= limit
        if same:
            mask[np.arange(len(part)), part] = False
        yield part, mask


def _beam_links(graph, unit_a, unit_b, rows, beam, limit, same):
    """(links, rows whose beam held nothing but links): links are pairs (row, other), checked in double precision."""
    ids, sims = graph.search(unit_a[rows].astype(np.float32), min(beam, len(unit_b)), rows if same else None)
    near = (ids >= 0) & (sims >= limit - _SLACK)
    full = near.all(1) if beam < len(unit_b) else np.zeros(len(rows), bool)
    r, c = np.nonzero(near & ~full[:, None])
    a, b = rows[r], ids[r, c]
    good = np.einsum("ij,ij->i", unit_a[a], unit_b[b]) >= limit
    if same:
        good &= a != b
    return np.stack([a[good], b[good]], 1), rows[full]


def planted(unit, limit, seed=0):
    """For each vector another at a cosine a little above ``limit``, in a random direction from it."""
    aside = np.random.default_rng(seed).normal(size=unit.shape)
    aside -= np.einsum("ij,ij->i", aside, unit)[:, None] * unit
    length = np.sqrt(np.einsum("ij,ij->i", aside, aside))[:, None]
    near = limit + 0.02 * (1 - limit)
    out = near * unit + np.sqrt(max(1 - near * near, 0.0)) * aside / np.where(length > 0, length, 1)
    return np.where(length > 0, out, unit).astype(np.float32)


def audit(graph, unit, limit, beam=BEAM, widest=WIDEST, recall=RECALL):
    """(beam, lost): the narrowest doubled beam that finds ``recall`` of all vectors from planted partners, and the
    vectors that it, or the widest one, does not find. A beam that is full of links finds them by being asked again."""
    rows, asked = np.arange(len(unit)), planted(unit, limit)
    while True:
        ids, sims = graph.search(asked[rows], min(beam, len(unit)))
        found = (ids == rows[:, None]).any(1) | ((ids >= 0) & (sims >= limit - _SLACK)).all(1)
        rows = rows[~found]
        if len(rows) <= (1 - recall) * len(unit) or 2 * beam > widest:
            return beam, rows
        beam *= 2


def find_links(graph, unit_a, unit_b, limit, same, widest=WIDEST):
    """(links, full rows): all rows of side a queried against side b's graph with its audited beam, and its lost
    vectors with all rows. Full rows have too many links for the widest beam and are to be compared exactly."""
    rows, links, width = np.arange(len(unit_a)), [], graph.beam
    while len(rows) and (width <= widest or not links):
        found, rows = _beam_links(graph, unit_a, unit_b, rows, width, limit, same)
        links.append(found)
        width *= 2
    for part, mask in _exact(unit_b, unit_a, graph.lost, limit, same):
        lost, a = np.nonzero(mask)
        links.append(np.stack([a, part[lost]], 1))
    found = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
    found = found[~np.isin(found[:, 0], rows)] if len(rows) else found
    return np.unique(found, axis=0), rows


class Forest:
    """Components of a task's links by the smallest member."""

    def __init__(self, count):
        self.root = np.arange(count)

    def join(self, nodes):
        roots = np.unique(self.root[nodes])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]


def pair_links(graph, unit_a, unit_b, copies_a, copies_b, limit, same, back=None):
    """Weighted numbers of links of both sides, and the forest over side a's and then side b's places.

    With side a's graph as ``back``, side b's rows query it too, and a link needs to be found from one side.
    """
    n = len(unit_a)
    links, full = find_links(graph, unit_a, unit_b, limit, same)
    full_b = full[:0]
    if back is not None and len(full) < n:
        more, full_b = find_links(back, unit_b, unit_a, limit, False)
        links = np.unique(np.concatenate([links, more[:, ::-1]]), axis=0)
    count_a, count_b = np.zeros(n, np.int64), np.zeros(len(unit_b), np.int64)
    forest = Forest(n if same else n + len(unit_b))
    off = 0 if same else n
    isfull = np.zeros(n, bool)
    isfull[full] = True
    if same:
        links = links[~isfull[links[:, 0]] & ~isfull[links[:, 1]]]
        links = np.unique(np.sort(links, 1), axis=0) if len(links) else links
    else:
        links = links[~isfull[links[:, 0]] & ~np.isin(links[:, 1], full_b)]
    a, b = links[:, 0], links[:, 1]
    np.add.at(count_a, a, copies_b[b])
    np.add.at(count_a if same else count_b, b, copies_a[a])
    for x, y in zip(a.tolist(), (b + off).tolist(), strict=True):
        if forest.root[x] != forest.root[y]:
            forest.join([x, y])
    for part, mask in _exact(unit_a, unit_b, full, limit, same):
        count_a[part] += mask @ copies_b
        if same:
            count_a[~isfull] += (copies_a[part] @ mask)[~isfull]
        else:
            count_b += copies_a[part] @ mask
        for r, line in zip(part.tolist(), mask, strict=True):
            others = np.flatnonzero(line) + off
            if len(others):
                forest.join(np.append(others, r))
    for part, mask in _exact(unit_b, unit_a, full_b, limit, False):
        mask &= ~isfull  # those are counted
        count_b[part] += mask @ copies_a
        count_a += copies_b[part] @ mask
        for r, line in zip(part.tolist(), mask, strict=True):
            others = np.flatnonzero(line)
            if len(others):
                forest.join(np.append(others, r + off))
    return count_a, count_b, forest.root


def _unit(raw, width):
    vectors = np.frombuffer(raw, np.float64).reshape(-1, width)
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # neither over- nor underflow when squared
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def near_vectors(vectors: DataFrame, id_col="vec_id", vector="embedding", label="label", limit=0.98, shard_rows=SHARD_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; links join vectors of equal labels whose cosine
    is ``limit`` or more.

    Vectors that are null, empty, zero, or hold null or non-finite numbers, rows without label or id, and
    vectors of unequal lengths link with nothing; such a row is its own component. Equal vectors of a
    label are one class in the graph and link with each other. Links are those that the audited search
    finds, none below the limit. Rows that share an id share a node. An empty table gives an empty result;
    further columns are left out. A label may be of any type that groups.
    """
    size = F.size("vector")
    sound = (F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull() & (size > 0)
             & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")) \
        .withColumn("sound", F.coalesce(sound, F.lit(False)))
    key = ["label", "key_1", "key_2"]
    good = rows.where("sound").withColumn("width", size).withColumn("key_1", F.xxhash64("vector")).withColumn("key_2", F.xxhash64(F.lit(1), "vector"))
    sets = staged(good.groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vector-sets")
    named = staged(
        good.join(sets.select(*[F.col(c).alias(f"_{c}") for c in key], "node", "copies"), [F.col(c) == F.col(f"_{c}") for c in key])
        .select("id", "node", "copies", "width", *key, F.when(F.col("id") == F.col("node"), F.col("vector")).alias("vector")), "vector-rows")
    classes = staged(named.where("vector IS NOT NULL").dropDuplicates(["node", *key]).drop("id", "key_1", "key_2"), "vector-classes")
    sizes = classes.groupBy(F.col("label").alias("_label"), F.col("width").alias("_width")).agg(F.count("*").alias("n"))
    sizes = staged(sizes.select("_label", "_width", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards")), "vector-sizes")
    dealt = classes.join(sizes, (F.col("label") == F.col("_label")) & (F.col("width") == F.col("_width"))).select(
        "label", "width", "shards", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), "node", "copies", "vector")
    kind = classes.schema["label"].dataType
    shard_schema = T.StructType([
        T.StructField("label", kind), T.StructField("width", T.IntegerType()), T.StructField("shards", T.IntegerType()), T.StructField("shard", T.IntegerType()),
        *[T.StructField(c, T.BinaryType()) for c in ("nodes", "copies", "vectors", "graph")]])

    def build(rows: pa.Table) -> pa.Table:
        width = rows.column("width")[0].as_py()
        order = np.argsort(rows.column("node").to_numpy(), kind="stable")
        raw = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width)[order]
        raw = np.ascontiguousarray(raw, np.float64).tobytes()
        unit = _unit(raw, width)
        graph = Graph(unit)
        beam, lost = audit(graph, unit, limit)
        one = rows.select(["label", "width", "shards", "shard"]).slice(0, 1)
        for name, value in (("nodes", rows.column("node").to_numpy()[order].tobytes()), ("copies", rows.column("copies").to_numpy()[order].tobytes()),
                            ("vectors", raw), ("graph", pickle.dumps((graph.level, graph.near, graph.entry, beam, lost)))):
            one = one.append_column(name, pa.array([value], pa.binary()))
        return one

    shards = staged(dealt.groupBy("label", "width", "shards", "shard").applyInArrow(build, shard_schema), "vector-shards")
    pairs = shards.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        "label", "width", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "nodes", "copies", "vectors", "graph")

    def link(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard").to_pylist()
        first = rows[0]
        same = len(rows) == 1
        width = first["width"]
        side = [(np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["copies"], np.int64), _unit(r["vectors"], width)) for r in rows]
        graphs = []
        for row, (_, _, unit) in zip(rows, side, strict=True):
            graphs.append(Graph.__new__(Graph))
            graphs[-1].level, graphs[-1].near, graphs[-1].entry, graphs[-1].beam, graphs[-1].lost = pickle.loads(row["graph"])
            graphs[-1].vectors = unit.astype(np.float32)
        (node_a, copies_a, unit_a), (node_b, copies_b, unit_b) = side[0], side[-1]
        count_a, count_b, root = pair_links(graphs[-1], unit_a, unit_b, copies_a, copies_b, limit, same, None if same else graphs[0])
        nodes = node_a if same else np.concatenate([node_a, node_b])
        counts = count_a if same else np.concatenate([count_a, count_b])
        return pa.table({"node": pa.array(nodes), "links": pa.array(counts), "joined": pa.array(nodes[root])})

    found = staged(pairs.groupBy("label", "width", "low", "high").applyInArrow(link, "node long, links long, joined long").where("links > 0 OR node != joined"), "vector-links")
    parts = staged(components(found, "node", "joined"), "parts")
    counts = staged(found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("links")), "vector-counts")
    told = counts.join(parts, F.col("_node") == F.col("node"), "full").select(F.coalesce("_node", "node").alias("_node"), "links", "component")
    told = staged(told, "vector-told")
    linked = named.join(told, F.col("node") == F.col("_node"), "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
