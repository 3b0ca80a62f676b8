"""A trie of conversation openings: which prefixes of turns are shared, by how many, and what sharing saves.

A node is a distinct sequence of first turns. Its key is the xor of hashes of (place, turn), so a prefix's key
follows from running xors and no node has to know the ones before it.

Sums over subtrees are rolled up in depth bands. Inside a band of fixed height every node adds its own
amounts to its ancestors of that band only. The bands' top nodes form a smaller trie, whose own sums are rolled
up in the same way; these completed totals are then added inside the band above. A trie of depth D takes
log D / log height rounds, and a node is repeated at most ``height`` times in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged

HEIGHT = 32
#: Turns of a conversation that one task orders, and ids of one block of a node's list of ends, as powers of two.
CHUNK_BITS, BLOCK_BITS = 10, 12

_KEY = ("k1", "k2")
_SUMS = ("leaves", "saved")


def numbered_turns(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv, pos, total, digest, words) of every turn: its place from 0, its conversation's turns, and what it holds.

    Turns are ordered by number, null first, equal numbers by the SHA-256 of their role's length, role and text. A
    null role or text counts as empty. Repeated rows are turns of their own; rows with a null id are left out.

    A conversation is ordered in buckets of 1,024 turn numbers; the turns of earlier buckets are counted.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.concat(F.length(filled(role)).cast("string"), F.lit(":"), filled(role), filled(text))
    number = F.col(turn).cast("bigint")
    source = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), number.alias("turn"),
        F.coalesce(F.shiftright(number, CHUNK_BITS), F.lit(-(1 << 62)).cast("bigint")).alias("bucket"),
        F.substring(F.unhex(F.sha2(content.cast("binary"), 256)), 1, 16).alias("digest"),
        F.regexp_count(filled(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    counts = source.groupBy("conv", "bucket").agg(F.count("*").alias("n"))
    by_conv = W.partitionBy("conv")
    offsets = counts.select(
        F.col("conv").alias("_conv"), F.col("bucket").alias("_bucket"), F.sum("n").over(by_conv).alias("total"),
        F.coalesce(F.sum("n").over(by_conv.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.row_number().over(W.partitionBy("conv", "bucket").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    placed = source.withColumn("here", here).join(offsets, (F.col("conv") == F.col("_conv")) & (F.col("bucket") == F.col("_bucket")))
    return staged(placed.select("conv", (F.col("before") + F.col("here") - 1).alias("pos"), "total", "digest", "words"), "turns")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv, total) of each conversation in :func:`numbered_turns`."""
    return turns.where("pos = 0").select("conv", "total")


def with_borrowed_openings(turns: DataFrame, group=20, most=4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches: (turns, conversations) as above, with the turns numbered anew.

    The first h turns of conversation c - c % ``group`` (as many as it has, none if it is absent) come before c's own
    turns from the h-th on; h is the crc32 of c as text, modulo ``most``. A conversation may lose all its turns.
    """
    base = lambda c: F.col(c) - F.col(c) % group
    taken = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    convs = conversations_of(turns).withColumn("h", taken("conv")).withColumn("base", base("conv"))
    lengths = turns.where(F.col("pos") == 0).where(F.col("conv") % group == 0).select(F.col("conv").alias("_base"), F.col("total").alias("_total"))
    found = convs.join(lengths, F.col("base") == F.col("_base"), "left")
    borrowed = F.least("h", F.coalesce("_total", F.lit(0).cast("bigint")))
    convs = staged(found.select("conv", "h", "base", borrowed.alias("b"), (borrowed + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).select(F.col("conv").alias("_base"), "pos", "digest", "words")
    first = convs.where("h > 0").join(heads, (F.col("base") == F.col("_base")) & (F.col("pos") < F.col("h"))).select(
        "conv", "pos", F.col("length").alias("total"), "digest", "words")
    # Only conversations that borrow fewer turns than they give up are shifted.
    shifts = convs.where("b < h").select(F.col("conv").alias("_conv"), (F.col("h") - F.col("b")).alias("shift"))
    own = turns.where(F.col("pos") >= taken("conv")).join(shifts, F.col("conv") == F.col("_conv"), "left")
    shift = F.coalesce("shift", F.lit(0).cast("bigint"))
    rest = own.select("conv", (F.col("pos") - shift).alias("pos"), (F.col("total") - shift).alias("total"), "digest", "words")
    return first.unionByName(rest), convs.select("conv", F.col("length").alias("total"))


def _chunk(depth="depth") -> Column:
    return F.shiftright(F.col(depth) - 1, CHUNK_BITS)


def _with_ancestors(paths: DataFrame, height: int) -> DataFrame:
    """Adds ``above`` to (conv, depth, k1, k2, up1, up2, ..): the keys from the band's top down to the parent."""
    banded = paths.withColumn("chunk", _chunk()).withColumn("band", F.floor((F.col("depth") - 1) / height))
    before = W.partitionBy("conv", "chunk", "band").orderBy("depth")
    top = F.first(F.struct(F.col("up1").alias("k1"), F.col("up2").alias("k2"))).over(before)
    inner = F.collect_list(F.struct(*_KEY)).over(before.rowsBetween(W.unboundedPreceding, -1))
    return banded.withColumn("above", F.concat(F.array(top), inner)).drop("chunk", "band")


def _paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, up1, up2, words, last): the node that every turn leads to, and the one it comes from."""
    mixed = turns.select(
        "conv", (F.col("pos") + 1).alias("depth"), "total", "words",
        F.xxhash64("pos", "digest").alias("x1"), F.xxhash64("digest", "pos").alias("x2")).withColumn("chunk", _chunk())
    running = W.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = mixed.select("*", *[F.bit_xor(f"x{i}").over(running).alias(f"s{i}") for i in (1, 2)])
    # Conversations of more than one chunk start each with what the chunks before come to.
    long = mixed.where(F.col("total") > 1 << CHUNK_BITS).groupBy("conv", "chunk").agg(*[F.bit_xor(f"x{i}").alias(f"x{i}") for i in (1, 2)])
    earlier = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = long.select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"), *[F.bit_xor(f"x{i}").over(earlier).alias(f"o{i}") for i in (1, 2)])
    joined = inside.join(starts, (F.col("conv") == F.col("_conv")) & (F.col("chunk") == F.col("_chunk")), "left")
    key = lambda i: F.col(f"s{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0).cast("bigint")))
    return joined.select("conv", "depth", *[key(i).alias(f"k{i}") for i in (1, 2)], *[key(i).bitwiseXOR(F.col(f"x{i}")).alias(f"up{i}") for i in (1, 2)],
                         "words", (F.col("depth") == F.col("total")).alias("last"))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _to_ancestors(nodes: DataFrame, above="above") -> DataFrame:
    """Each node's amounts once for every key in its list."""
    return nodes.select(F.explode(above).alias("_to"), *_SUMS).select("_to.*", *_SUMS)


def _bands(nodes: DataFrame, listed: DataFrame, local: DataFrame, top: int, height: int) -> DataFrame:
    """What the bands below add to the amounts that nodes got from their own band (``local``).

    ``listed`` are the paths with their ancestors, ``nodes`` the same once per node, ``top`` the largest depth.
    """
    ends = staged(nodes.where((F.col("depth") > 0) & (F.col("depth") % height == 0)).select(*_KEY, "depth", "above")
                  .join(local.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).drop("_k1", "_k2"), "band-tops")
    paths = listed.where((F.col("depth") > 0) & (F.col("depth") % height == 0)).select(
        "conv", F.floor(F.col("depth") / height).alias("depth"), *_KEY, F.get("above", F.lit(0))["k1"].alias("up1"), F.get("above", F.lit(0))["k2"].alias("up2"))
    upper = staged(_with_ancestors(paths, height), "band-paths")
    amounts = ends.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), *_SUMS)
    tops = staged(upper.groupBy(*_KEY).agg(F.max("depth").alias("depth"), F.any_value("above").alias("above"))
                  .join(amounts, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).drop("_k1", "_k2"), "band-nodes")
    below = _added(_to_ancestors(tops))
    if top // height > height:
        below = _added(below.unionByName(_bands(tops, upper, staged(below, "band-local"), top // height, height)))
    below = staged(below, "below")
    more = below.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
    whole = ends.join(more, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select(
        F.slice("above", 2, height).alias("above"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0).cast("bigint"))).alias(c) for c in _SUMS])
    return _to_ancestors(whole).unionByName(below)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the SHA-256 of each node's ascending ids joined by commas, of (k1, k2, conv).

    Ids are joined in blocks of 4,096 possible values first; a node's blocks then pass one by one through the hash,
    which has to see them in order.
    """
    block = F.shiftright("conv", BLOCK_BITS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*_KEY, block.alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys, digests):
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [pa.array(digests, pa.string())], names=names)

        names, at, state = [*_KEY, "ends_sha256"], None, None
        for batch in batches:
            keys, digests = [], []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if key != at:
                    if at is not None:
                        keys.append(at)
                        digests.append(state.hexdigest())
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(keys, digests)
        if at is not None:
            yield rows([at], [state.hexdigest()])

    ordered = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids")
    return ordered.mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, height=HEIGHT) -> DataFrame:
    """One row per node of the trie of conversations (conv, total) with their turns (:func:`numbered_turns`).

    ``node`` and ``parent_node`` (hex; null for the root), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs`` (conversations that start with the node's turns), ``n_children``, ``n_leaves`` (childless nodes of its
    subtree), ``saved_tokens`` (words that the subtree's shared turns would repeat) and ``ends_sha256`` (of the ids of
    the conversations that end here). Every conversation passes the root, those without turns end there; without
    conversations there is no node. Copies share all their nodes. ``height`` must divide 1,024.
    """
    if height < 2 or (1 << CHUNK_BITS) % height:
        raise ValueError("the height of a band must divide the turns of a chunk")
    nothing = F.array().cast("array<struct<k1:bigint,k2:bigint>>")
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("bigint").alias("up1"),
                        F.lit(None).cast("bigint").alias("up2"), zero.alias("words"), (F.col("total") == 0).alias("last"), nothing.alias("above"))
    listed = staged(_with_ancestors(_paths(turns), height).select(*root.columns).unionByName(root), "paths")
    nodes = listed.groupBy(*_KEY).agg(
        F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("up1").alias("up1"), F.max("up2").alias("up2"),
        F.bool_and("last").cast("bigint").alias("leaves"), ((F.count("*") - 1) * F.max("words")).alias("saved"), F.any_value("above").alias("above"))
    nodes = staged(nodes, "nodes")
    top = nodes.agg(F.max("depth")).first()[0] or 0
    # One pass adds every node to itself, with what it is, and to its band's ancestors, the last of which is its parent.
    own = ("conv", "depth", "n_convs", "up1", "up2")
    itself = F.struct(*_KEY, *own, zero.alias("child"), zero.alias("leaves"), zero.alias("saved"),
                      F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved"))
    unknown = [F.lit(None).cast("bigint").alias(c) for c in own]
    others = F.transform("above", lambda a, i: F.struct(
        a["k1"].alias("k1"), a["k2"].alias("k2"), *unknown, (i == F.size("above") - 1).cast("bigint").alias("child"),
        F.col("leaves").alias("leaves"), F.col("saved").alias("saved"), F.lit(None).cast("bigint").alias("own_leaves"), F.lit(None).cast("bigint").alias("own_saved")))
    sent = nodes.select(F.explode(F.concat(F.array(itself), others)).alias("_x")).select("_x.*")
    together = lambda rows: rows.groupBy(*_KEY).agg(
        *[F.max(c).alias(c) for c in (*own, "own_leaves", "own_saved")], *[F.sum(c).alias(c) for c in ("child", *_SUMS)])
    sums = staged(together(sent), "sums")
    if top > height:
        deeper = _bands(nodes, listed, sums.select(*_KEY, *_SUMS), top, height)
        sums = staged(together(sums.unionByName(deeper, allowMissingColumns=True)), "all-sums")
    ended = ends_digest(listed.where("last").select(*_KEY, "conv")).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    parents = sums.select(F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), F.col("conv").alias("parent_conv_id"))
    done = (sums.join(ended, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
            .join(parents, (F.col("up1") == F.col("_p1")) & (F.col("up2") == F.col("_p2")), "left"))
    name = lambda a, b: F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)])
    return done.select(
        name("k1", "k2").alias("node"), name("up1", "up2").alias("parent_node"), F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        F.coalesce("child", zero).alias("n_children"), (F.col("leaves") + F.col("own_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("own_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
