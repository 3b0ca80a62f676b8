"""Language-model scores by prediction by partial matching over bytes.

The model is the trie of all byte contexts of up to ORDER bytes of the training texts, kept as a table
of byte grams with their counts. A byte is predicted in its longest context; if it never followed
there, the model pays for an escape (method D: half a count of each distinct follower) and goes on with
the context shortened by one byte, where followers of the longer context are excluded. Contexts below
the longest count in how many one byte longer contexts a follower occurred (update exclusion).

Every quantity that a byte's cost needs lies on the path of its gram, so costs are worked out once for
each distinct gram of the corpus, in parts by the last two context bytes. Documents then fetch the
costs of their grams: they are dealt into blocks, and each block asks for its distinct grams and words
in BUCKETS lists. A list of a bucket's asking blocks and the model's part for that bucket meet in
one task, CHUNK blocks at a time, and the answers go back to their blocks. So no task holds more of the
model than a bucket; only the counts for contexts of at most one byte, 65,536 numbers at most, are sent
to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .text_bytes import Hasher, KeyRows, lower_ascii, ragged, segment_sums, text_runs, words

ORDER, BLOCK_BYTES, BUCKETS, CHUNK, SYMBOLS, ESCAPE = 5, 16 << 20, 251, 1024, 256, 0.5
RUN, TRIM_EVERY = 1 << 20, 8
#: Distinct keys that a task counts before it passes them on.
HELD_KEYS = 1 << 20
#: Ends a text, and fills the contexts of its first bytes; no word holds it.
END = 10
#: Grams are below this, the numbers of words at or above it.
WORDS_FROM = 1 << 62


def byte_lines(data, offsets):
    """The texts as the model reads them: ORDER end bytes, words in a-z with one blank between, an end byte.

    Also where each text begins, and the words' numbers with their text's first one.
    """
    low = lower_ascii(data)
    starts, ends, word_at = words(low, offsets)
    texts = len(offsets) - 1
    counts = np.diff(word_at)
    pads = np.where(counts > 0, ORDER, ORDER + 1)
    size = segment_sums(ends - starts + 1, word_at) + pads
    at = np.concatenate([[0], np.cumsum(size)])
    line = np.full(at[-1], END, np.uint8)
    text = np.repeat(np.arange(texts), counts)
    wide = ends - starts
    before = np.concatenate([[0], np.cumsum(wide + 1)])
    to = at[:-1][text] + ORDER + before[:-1] - before[word_at[:-1]][text]
    spots, _ = ragged(to, wide)
    places, _ = ragged(starts, wide)
    line[spots] = low[places]
    blank = np.ones(len(starts), bool)
    blank[word_at[1:][counts > 0] - 1] = False
    line[(to + wide)[blank]] = 32
    return line, at, (low, starts, ends, word_at)


def grams(line, at):
    """The gram of each predicted byte, with where each text's begin: ORDER context bytes and the byte."""
    whole = np.zeros(max(len(line) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        whole = (whole << np.uint64(8)) | line[k : len(line) - ORDER + k]
    n = np.diff(at) - ORDER
    places, gram_at = ragged(at[:-1], n)
    return whole[places].view(np.int64), gram_at


def word_numbers(hasher, low, starts, ends):
    return (hasher.ranges(low, starts, ends) >> np.uint64(2)).view(np.int64) | np.int64(WORDS_FROM)


def _sums(keys, counts):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def corpus_counts(docs: DataFrame, text: str, learns: str) -> DataFrame:
    """(key, n): every gram and word of all texts with its count in the texts that ``learns`` marks."""
    source = docs.select(F.col(text).alias("text"), F.coalesce(F.col(learns), F.lit(False)).alias("learns"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def full(table, counts):
            return pa.RecordBatch.from_arrays([pa.array(table.keys[: table.size]), pa.array(counts[: table.size].astype(np.int64))], names=["key", "n"])

        table, counts = KeyRows(), np.zeros(0)
        for batch in batches:
            marks = np.asarray(batch.column(1).to_pylist(), bool)
            for first, end, data, offsets in text_runs(batch.column(0), RUN, TRIM_EVERY):
                line, at, (low, starts, ends, word_at) = byte_lines(data, offsets)
                found, gram_at = grams(line, at)
                mine = marks[first:end].astype(float)
                for keys, key_at in ((found, gram_at), (word_numbers(hasher, low, starts, ends), word_at)):
                    rows = table.rows_of(keys)
                    added = np.bincount(rows, np.repeat(mine, np.diff(key_at)), table.size)
                    added[: len(counts)] += counts
                    counts = added
                if table.size > HELD_KEYS:
                    yield full(table, counts)
                    table, counts = KeyRows(), np.zeros(0)
        if table.size:
            yield full(table, counts)

    return source.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Costs:
    """log10 of each gram's probability, for all grams that end in some sets of two context bytes and a byte.

    ``pairs`` has for each two bytes in how many longer grams of the training text they end.
    """

    def __init__(self, pairs):
        self.pairs = np.zeros((SYMBOLS, SYMBOLS))
        for a, b, n in pairs:
            self.pairs[a, b] = n

    def __call__(self, keys, counts):
        cost, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        context = (keys >> 8).astype(np.int64)
        byte = (keys & 255).astype(np.int64)
        gone_n, gone_q = np.zeros(len(keys)), np.zeros(len(keys))  # what longer contexts exclude here
        tables = {}
        grams_, sums = keys, counts
        for order in range(ORDER, 1, -1):
            grams_, sums = _sums(grams_ & ((1 << 8 * (order + 1)) - 1), sums if order == ORDER else (sums > 0).astype(np.int64))
            tables[order] = grams_, sums
        # Sums over the followers of a context, and over the followers that a longer context has as well.
        for order in range(ORDER, -1, -1):
            if order >= 2:
                grams_, sums = tables[order]
                mine = sums[np.searchsorted(grams_, keys & ((1 << 8 * (order + 1)) - 1))]
                contexts, first = np.unique(grams_ >> 8, return_index=True)
                n, q = np.add.reduceat(sums, first), np.add.reduceat((sums > 0).astype(np.int64), first)
                here = np.searchsorted(contexts, context & ((1 << 8 * order) - 1))
                n, q = n[here].astype(float), q[here].astype(float)
            else:
                table = self.pairs if order else (self.pairs > 0).sum(0)[None, :].astype(float)
                row = context & 255 if order else np.zeros(len(keys), np.int64)
                mine, n, q = table[row, byte], table.sum(1)[row], (table > 0).sum(1)[row].astype(float)
            left_n, left_q = n - gone_n, q - gone_q
            some = open_ & (left_q > 0)
            hit = some & (mine > 0)
            cost[hit] += np.log10((mine[hit] - ESCAPE) / left_n[hit])
            missed = some & ~hit
            cost[missed] += np.log10(ESCAPE * left_q[missed] / left_n[missed])
            open_ &= ~hit
            if order == 0:
                break
            # The followers of this context, counted in the next shorter one.
            shorter = (1 << 8 * order) - 1
            if order >= 2:
                followers = grams_[sums > 0]
                if order > 2:
                    there = tables[order - 1][1][np.searchsorted(tables[order - 1][0], followers & shorter)]
                else:
                    there = self.pairs[(followers >> 8) & 255, followers & 255]
                at = np.searchsorted(contexts, followers >> 8)
                gone = np.bincount(at, there.astype(float), len(contexts))
                gone_n, gone_q = gone[here], q
            else:
                none = (self.pairs > 0).sum(0)
                gone_n, gone_q = ((self.pairs > 0) * none[None, :]).sum(1)[row], q
        cost[open_] += np.log10(1.0 / np.maximum(SYMBOLS - q[open_], 1.0))
        return cost


def gram_costs(counts: DataFrame, parts: int) -> DataFrame:
    """(key, value): for a gram its cost, for a word its training count."""
    found = counts.where(F.col("key") < WORDS_FROM)
    upto = lambda n: F.col("key").bitwiseAND((1 << 8 * n) - 1)
    triples = found.where("n > 0").select(upto(3).alias("key")).distinct()
    pairs = [(r["pair"] >> 8, r["pair"] & 255, r["n"]) for r in triples.groupBy(upto(2).alias("pair")).agg(F.count("*").alias("n")).collect()]
    group = F.shiftright("key", 8).bitwiseAND((1 << 16) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, held = Costs(pairs), None
        ended = False
        batches = iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or (len(held) < 200_000 and not ended):
                continue
            # A context's rows stay together: the last one may go on in the next batch.
            keys, n, of = (held.column(c).to_numpy() for c in ("key", "n", "context"))
            end = len(keys) if ended else int(np.searchsorted(of, of[-1])) if len(of) else 0
            held = held.slice(end).combine_chunks()
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(keys[:end]), pa.array(costs(keys[:end], n[:end]))], names=["key", "value"])

    grams_ = found.select("key", "n", group.alias("context")).repartition(parts, "context").sortWithinPartitions("context").mapInArrow(work, "key long, value double")
    return grams_.unionByName(counts.where(F.col("key") >= WORDS_FROM).select("key", F.col("n").cast("double").alias("value")))


def score(docs: DataFrame, learns: str, text="text", keep=("doc_id",), block_bytes=BLOCK_BYTES) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score for every row, with the ``keep`` columns.

    The model learns from the rows for which the column ``learns`` is true. It reads a text as its words
    in a-z with one blank between them and an end; ``score`` is the log10 of its probability.
    ``base_score`` is that of a unigram model over words and the end (add 0.5, one unseen word). A null
    or empty text is the end alone. Repeated rows are scored, and learned, as often as they occur. With
    nothing to learn from, bytes are equally likely. Further columns are left out.
    """
    counts = staged(corpus_counts(docs, text, learns), "counts")
    ends = docs.agg(F.count(F.when(F.col(learns), 1)).alias("ends"), F.sum(F.octet_length(text)).alias("bytes")).first()
    known = counts.where(F.col("key") >= WORDS_FROM).agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    end_count = ends["ends"]
    total, distinct = (known["n"] or 0) + end_count, known["v"] + (end_count > 0)
    blocks = max(1, -(-(ends["bytes"] or 0) // block_bytes))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, blocks)
    model = staged(gram_costs(counts, parts), "model")
    source = docs.select(*keep, F.col(text).alias("_text"))
    source = source.withColumn("_block", F.pmod(F.xxhash64(*keep, "_text"), F.lit(blocks)).cast("int")).repartition(blocks, "_block")
    schema = source.select(*keep).schema
    from pyspark.sql import types as T

    schema = T.StructType([*schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    place, width = len(keep), total + 0.5 * (distinct + 1)

    def ask(rows: pa.Table) -> pa.Table:
        """The distinct keys of a block, sorted, a row for each bucket that has some."""
        hasher, table = Hasher(), KeyRows()
        for _, _, data, offsets in text_runs(rows.column("_text"), RUN, TRIM_EVERY):
            line, at, (low, starts, ends_, _) = byte_lines(data, offsets)
            table.rows_of(grams(line, at)[0])
            table.rows_of(word_numbers(hasher, low, starts, ends_))
        keys = np.sort(table.keys[: table.size])
        of = keys % BUCKETS
        keys = keys[np.argsort(of, kind="stable")]
        cuts = np.searchsorted(np.sort(of), np.arange(BUCKETS + 1))
        some = np.flatnonzero(np.diff(cuts))
        block = rows.column("_block")[0].as_py()
        return pa.table({
            "_block": pa.array(np.full(len(some), block, np.int32)), "chunk": pa.array(np.full(len(some), block // CHUNK, np.int32)),
            "bucket": pa.array(some.astype(np.int32)), "keys": pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())})

    def meet(asking: pa.Table, model_: pa.Table) -> pa.Table:
        """The values of the keys of each list, in the list's order: costs of grams, then counts of words."""
        keys, values = model_.column("key").to_numpy(), model_.column("value").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = []
        for raw in asking.column("keys"):
            wanted = np.frombuffer(raw.as_py(), np.int64)
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            if not len(keys) or not (keys[spot] == wanted).all():
                raise ValueError("the rows changed between two readings")
            split = np.searchsorted(wanted, WORDS_FROM)
            out.append(values[spot[:split]].astype(np.float32).tobytes() + values[spot[split:]].astype(np.int64).tobytes())
        return asking.select(["_block", "keys"]).append_column("found", pa.array(out, pa.binary()))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        hasher = Hasher()
        lists = [np.frombuffer(x.as_py(), np.int64) for x in right.column("keys")]
        values = []
        for keys, found in zip(lists, right.column("found"), strict=True):
            split, raw = int(np.searchsorted(keys, WORDS_FROM)), found.as_py()
            values += [np.frombuffer(raw, np.float32, split).astype(np.float64), np.frombuffer(raw, np.int64, -1, 4 * split).astype(np.float64)]
        values, table = np.concatenate(values), KeyRows(np.concatenate(lists))
        unseen, end_cost = np.log10(0.5 / width), np.log10((end_count + 0.5) / width)
        out = []

        def look(wanted):
            return values[table.find(wanted)]

        for first, end, data, offsets in text_runs(left.column("_text"), RUN, TRIM_EVERY):
            line, at, (low, starts, ends_, word_at) = byte_lines(data, offsets)
            found, gram_at = grams(line, at)
            n = look(word_numbers(hasher, low, starts, ends_))
            base = segment_sums(np.where(n > 0, np.log10((n + 0.5) / width), unseen), word_at) + end_cost
            part = left.select(list(keep)).slice(first, end - first)
            columns = [part.column(k) for k in range(place)]
            columns += [pa.array(np.diff(word_at) + 1), pa.array(segment_sums(n > 0, word_at) + int(end_count > 0)),
                        pa.array(np.full(end - first, total, np.int64)), pa.array(base), pa.array(segment_sums(look(found), gram_at))]
            out.append(pa.Table.from_arrays(columns, names=schema.names))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=pa.schema([]))

    asked = source.groupBy("_block").applyInArrow(ask, "_block int, chunk int, bucket int, keys binary")
    chunks = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // CHUNK))).alias("chunk")
    known_ = model.select((F.col("key") % BUCKETS).cast("int").alias("bucket"), chunks, "key", "value")
    answers = asked.groupBy("bucket", "chunk").cogroup(known_.groupBy("bucket", "chunk")).applyInArrow(meet, "_block int, keys binary, found binary")
    return source.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(answer, schema)
