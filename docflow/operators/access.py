"""API keys, permissions and rate limits over request logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written


def key_hash(raw) -> Column:
    return F.sha2(F.col(raw).cast("binary"), 256)


def resolve_keys(requests: DataFrame, api_keys: DataFrame, raw="key") -> DataFrame:
    """Adds key_id and ``valid`` to each request: the key is known, active and not expired."""
    known = api_keys.select("key_id", "key_hash", "is_active", "expires_at")
    joined = requests.withColumn("key_hash", key_hash(raw)).join(known, "key_hash", "left")
    fresh = F.col("expires_at").isNull() | (F.col("ts") <= F.col("expires_at"))
    return joined.select(
        *requests.columns, "key_id",
        F.coalesce(F.col("is_active") & fresh, F.lit(False)).alias("valid"),
    )


def last_used(resolved: DataFrame) -> DataFrame:
    """Time of the latest valid use per key."""
    return resolved.where("valid").groupBy("key_id").agg(F.max("ts").alias("last_used"))


def keys_of_tenant(api_keys: DataFrame, tenant_id) -> DataFrame:
    return api_keys.where(F.col("tenant_id") == tenant_id)


def users_permissions(users: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """One row per user and permission, by role or granted explicitly."""
    granted = role_permissions.groupBy("role").agg(F.collect_list("permission").alias("_by_role"))
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("permissions", empty), F.coalesce("_by_role", empty)))
    return users.join(granted, "role", "left").select(
        "user_id", "role", F.explode(every).alias("permission"))


def check_permissions(requests: DataFrame, users: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Adds ``permitted`` to (user_id, permission) requests; unknown users are refused, and
    whether a user is active plays no part."""
    granted = role_permissions.groupBy("role").agg(F.collect_list("permission").alias("_by_role"))
    known = users.select("user_id", "role", "permissions").join(granted, "role", "left")
    joined = requests.join(known.drop("role"), "user_id", "left")
    by_hand = F.coalesce(F.array_contains("permissions", F.col("permission")), F.lit(False))
    by_role = F.coalesce(F.array_contains("_by_role", F.col("permission")), F.lit(False))
    return joined.select(*requests.columns, (by_hand | by_role).alias("permitted"))


# --- rate limit ---------------------------------------------------------------
#
# A window opens at a key's first request and the next one opens at the first request later than
# its end, so each window depends on the one before. Requests are cut into ranges of (key, time), which
# Spark samples to be about equal; a busy key has many of them.
#   1. the first and the last key of a range may go on in its neighbours. For those, a range says for every
#      window it may inherit which window is open at its end (a short step function, because windows
#      soon fall together);
#   2. these functions are chained per key - at most two rows per range;
#   3. every range places its requests on its own, from the window it inherits.
# Every request points at the one that opens the next window. Window starts are found by following these
# pointers with doubled steps for all keys of a range at once.


def _next_window(times: np.ndarray, new_run: np.ndarray, window: int) -> np.ndarray:
    """For each row the first one, of any run, more than a window later; other runs count as later.

    Gaps longer than a window are as good as a window and a bit, which puts all runs on one axis.
    """
    gaps = np.zeros(len(times), np.int64)
    gaps[1:] = np.minimum(times[1:] - times[:-1], window + 1)
    gaps[new_run] = window + 1
    axis = np.cumsum(gaps)
    return np.searchsorted(axis, axis + window, side="right")


def chunk_steps(times: np.ndarray, weights: np.ndarray, window: int):
    """Step function of one run (sorted times): for an inherited window ending before ``bounds[i]`` (the
    first such i) the window open at the end starts at ``exits[i]`` and holds ``counts[i]`` requests."""
    n = len(times)
    follows = _next_window(times, np.zeros(0, np.int64), window)
    jump = np.where(follows < n, follows, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    entries = np.arange(min(n, 1 + int(np.searchsorted(times, times[0] + window, side="right"))))
    last = jump[entries]
    keep = np.append(last[1:] != last[:-1], True)
    upto = np.concatenate([[0], np.cumsum(weights)])
    return times[entries][keep], times[last[keep]], upto[-1] - upto[last[keep]]


def window_places(times, weights, starts, inherited, window: int):
    """Start of each row's window and the requests in it up to the row.

    ``starts`` are the first rows of the runs (one key each, times sorted), ``inherited`` maps the number of a
    run to the (start, count) of the window that is open when it begins.
    """
    n = len(times)
    if not n:
        return times, times
    ends = np.append(starts[1:], n)
    run = np.repeat(np.arange(len(starts)), ends - starts)
    follows = _next_window(times, starts, window)
    follows = np.append(np.where(follows < ends[run], follows, n), n)
    entries = starts.copy()
    for k, (start, _) in inherited.items():
        entries[k] += np.searchsorted(times[starts[k] : ends[k]], start + window, side="right")
    opens = entries[entries < ends]
    jump = follows
    while True:  # the first 2, 4, 8 .. windows of every run
        more = jump[opens]
        more = more[more < n]
        if not len(more):
            break
        opens, jump = np.concatenate([opens, more]), jump[jump]
    marked = np.full(n, -1, np.int64)
    marked[opens] = opens
    opened = np.maximum.accumulate(marked)
    own = opened >= starts[run]
    upto = np.cumsum(weights)
    opened = np.where(own, opened, starts[run])
    begin, place = times[opened], upto - upto[opened] + weights[opened]
    for k, (start, count) in inherited.items():
        rows = slice(starts[k], min(entries[k], ends[k]))
        begin[rows], place[rows] = start, place[rows] + count
    return begin, place


STEPS = "bounds array<bigint>, exits array<bigint>, counts array<bigint>, total bigint"
INHERITED = "key {key}, chunk int, in_start bigint, in_count bigint"


def _changes(column: pa.Array) -> np.ndarray:
    """Rows whose value differs from the row before; nulls are equal to each other."""
    if len(column) < 2:
        return np.zeros(0, np.int64)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.fill_null(pc.equal(a, b), False)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.flatnonzero(~pc.or_(same, both).to_numpy(zero_copy_only=False)) + 1


def _with_steps(window: int, schema: pa.Schema, width: int):
    """Passes a sorted range on, and adds the step functions of its first and last key as rows without a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held = None, True, []

        def summary():
            times, weights = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            steps = [x.tolist() for x in chunk_steps(times, weights, window)]
            row = [key, None, None, None, held[0][0], *steps, int(weights.sum())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i) for i in range(width)] + [pa.nulls(batch.num_rows, t) for t in schema.types[width:]]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(rows, schema.types)], schema=schema)
            keys, times, weights = batch.column(0), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = [0, *_changes(keys).tolist(), len(keys)]
            chunk = batch.column(4)[0].as_py()
            if held and keys[0].as_py() != key:
                if first:
                    yield summary()
                first, held = False, []
            if len(cuts) > 2:  # runs inside the batch lie in this range alone
                if first:
                    key = keys[0].as_py()
                    held.append((chunk, times[: cuts[1]], weights[: cuts[1]]))
                    yield summary()
                first, held = False, []
            key = keys[cuts[-2]].as_py()
            held.append((chunk, times[cuts[-2] :], weights[cuts[-2] :]))
        if held:
            yield summary()

    return work


def _chain(window: int):
    def work(batches):
        at, start, count = None, None, 0
        for batch in batches:
            out = []
            for key, chunk, bounds, exits, counts, total in batch.itertuples(index=False):
                if at is None or key != at[0]:
                    at, start, count = (key,), None, 0
                out.append((key, chunk, start, count))
                i = 0 if start is None else int(np.searchsorted(bounds, start + window, side="right"))
                if i < len(bounds):
                    start, count = int(exits[i]), int(counts[i])
                else:
                    count += int(total)
            frame = pd.DataFrame(out, columns=["key", "chunk", "in_start", "in_count"])
            yield frame.astype({"in_start": "Int64", "in_count": "int64"})
    return work


def _places(window: int, names):
    """Places of whole runs of (chunk, key); a row without a time carries the window that its run inherits."""

    def placed(table: pa.Table, cuts) -> pa.RecordBatch:
        given = table.column("t").is_null().combine_chunks().to_numpy(zero_copy_only=False)
        starts = np.array([0, *cuts], np.int64)
        opens = np.flatnonzero(given)
        run = np.searchsorted(starts, opens, side="right") - 1
        said = table.take(pa.array(opens)).select(["in_start", "in_count"]).to_pylist()
        inherited = {int(r): (x["in_start"], x["in_count"]) for r, x in zip(run, said) if x["in_start"] is not None}
        rows = table.filter(pa.array(~given)).combine_chunks()
        starts = starts - np.searchsorted(opens, starts)
        sizes = np.diff(np.append(starts, rows.num_rows))
        number = np.cumsum(sizes > 0) - 1
        inherited = {int(number[k]): v for k, v in inherited.items() if sizes[k]}
        times, weights = (rows.column(c).to_numpy() for c in ("t", "weight"))
        begin, place = window_places(times, weights, starts[sizes > 0], inherited, window)
        columns = [rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in names[:-2]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(begin, pa.int64()), pa.array(place, pa.int64())], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch])
            table = batch if held is None else pa.concat_tables([held, batch])
            chunks = table.column("chunk").combine_chunks()
            keys = table.column("key").combine_chunks()
            cuts = np.union1d(_changes(chunks), _changes(keys))
            if len(cuts):  # the last run may go on in the next batch
                yield placed(table.slice(0, int(cuts[-1])), cuts[:-1])
                table = table.slice(int(cuts[-1]))
            held = table
        if held is not None:
            yield placed(held, [])

    return work


def _judged(rows: DataFrame, window: int, ranges: int | None) -> DataFrame:
    """``_start`` and ``_place`` of rows (key, ident, t in microseconds, weight)."""
    order = ["key", "t", "ident"]
    kinds = dict(rows.dtypes)
    cut = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).select("key", "ident", "t", "weight", F.spark_partition_id().alias("chunk"))
    fields = f"key {kinds['key']}, ident {kinds['ident']}, t bigint, weight bigint, chunk int, {STEPS}"
    shape = T.StructType.fromDDL(fields)
    ranged = written(cut.mapInArrow(_with_steps(window, to_arrow_schema(shape), 5), shape), "rate-limit")
    steps = ranged.where("t IS NULL").select("key", "chunk", "bounds", "exits", "counts", "total")
    chained = steps.repartition("key").sortWithinPartitions("key", "chunk")
    inherited = chained.mapInPandas(_chain(window), INHERITED.format(key=kinds["key"]))
    ready = ranged.where("t IS NOT NULL").select("key", "ident", "t", "weight", "chunk").unionByName(inherited, allowMissingColumns=True)
    sorted_ = ready.repartition("chunk").sortWithinPartitions("chunk", "key", F.col("t").asc_nulls_first(), "ident")
    out = f"key {kinds['key']}, ident {kinds['ident']}, t bigint, weight bigint, _start bigint, _place bigint"
    return sorted_.mapInArrow(_places(window, ["key", "ident", "t", "weight", "_start", "_place"]), out)


def rate_limit(requests: DataFrame, limit=60, window_seconds=60, key="key", ident="request_id", opened: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``allowed``, ``remaining`` and ``reset_at`` to each request of (key, ts, ident).

    A request exactly at a window's end still belongs to it; refused requests are not counted. Equal times are
    ordered by ``ident``. Requests with a null key share one key; one without a time is left out. ``opened`` may
    give keys the window that is open when their requests begin: (key, opened timestamp, used bigint); requests
    need an ``ident`` then. ``ranges`` fixes the number of ranges, which else follows the shuffle settings.
    """
    window = int(window_seconds * 1_000_000)
    rows = requests.where(F.col("ts").isNotNull()).select(
        F.col(key).alias("key"), F.col(ident).alias("ident"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.lit(1).cast("bigint").alias("weight"))
    if opened is not None:
        # A window that is open counts as one request at its start that stands for all of its requests.
        begun = opened.select(F.col("key"), F.lit(None).cast(dict(rows.dtypes)["ident"]).alias("ident"), F.unix_micros("opened").alias("t"), F.col("used").alias("weight"))
        rows = rows.unionByName(begun)
    walked = _judged(rows, window, ranges)
    if opened is not None:
        walked = walked.where("ident IS NOT NULL")
    return walked.select(
        F.col("ident").alias(ident), F.col("key").alias(key), F.timestamp_micros("t").alias("ts"),
        (F.col("_place") <= limit).alias("allowed"),
        F.greatest(F.lit(limit) - F.col("_place"), F.lit(0)).alias("remaining"),
        F.timestamp_micros(F.col("_start") + window).alias("reset_at"),
    )
