"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A text's lattice has an edge for each piece that matches somewhere; a segmentation's score is the sum
of its pieces' scores in the model file. Forward Viterbi scores of all nodes are computed in numpy for
all new stretches of a run of texts at once. They are exact heuristics for a backward A* search,
which then yields segmentations best first.

Where no piece holds two neighbouring bytes together, every segmentation has a border. So the lattice
of a text is a chain of stretches, and a task works out each distinct stretch once. At most
``n - 1`` stretches can differ from their best form among the ``n`` best of a text: those that lose
least by their second-best form. Only these are searched, and their lists are joined best first.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_bytes import _M3, Hasher, Known, Lists, mix, ragged, text_runs

BLANK = "▁".encode()
RUN = 2 << 20


class Pieces:
    """The pieces of a model file as byte strings, with blanks for the model's blank mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names, scores, ids = [], [], []
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = []
        for i in range(model.vocab_size()):
            name = model.id_to_piece(i)
            raw = b""
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                raw = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = name.encode().replace(BLANK, b" ")
                names.append(raw)
                scores.append(model.get_score(i))
                ids.append(i)
            self.bytes_of.append(raw)
        self.unknown_id = model.unk_id()
        self.names, self.scores, self.ids = names, np.array(scores, np.float64), np.array(ids, np.int64)
        self.unknown_score = (self.scores.min() if len(names) else 0.0) - 10.0
        # Two neighbouring bytes that no piece holds together part the lattice of a text.
        self.parted = np.ones((256, 256), bool)
        for name in names:
            raw = np.frombuffer(name, np.uint8)
            self.parted[raw[:-1], raw[1:]] = False
        self.hasher = Hasher(7)
        self.tables = {}
        for length in range(1, max(map(len, names), default=0) + 1):
            longer = [k for k, n in enumerate(names) if len(n) >= length]
            prefix = self._hash([names[k][:length] for k in longer])
            whole = np.array([len(names[k]) == length for k in longer])
            number = np.where(whole, np.array(longer), -1)
            order = np.lexsort((-number, prefix))
            prefix, number = prefix[order], number[order]
            first = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            self.tables[length] = prefix[first], number[first]

    def stretches(self, data, offsets):
        """Starts of the stretches of each text, and per text the number of its first one."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data):
            cut[1:-1] |= self.parted[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        starts = np.flatnonzero(cut[:-1])
        return starts, np.searchsorted(starts, offsets)

    def _hash(self, strings):
        ends = np.cumsum([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8)
        return self.hasher.ranges(data, np.concatenate([[0], ends[:-1]]), ends)


class Lattice:
    """The lattices of many stretches: edges sorted by end node, best and second-best forward scores."""

    def __init__(self, pieces: Pieces, data, at):
        self.pieces, self.data, self.at = pieces, data, at
        count = len(at) - 1
        lengths = np.diff(at)
        owner = np.repeat(np.arange(count), lengths)
        point = (data & 0xC0) != 0x80
        point[at[:-1][lengths > 0]] = True  # a stretch of broken bytes still starts
        active = np.flatnonzero(point)
        stop = at[1:][owner]
        boundary = np.concatenate([point, [True]])
        boundary[at] = True
        starts, ends, numbers = [], [], []
        single = np.zeros(len(data) + 1, bool)
        after = np.flatnonzero(boundary)
        width = np.zeros(len(data) + 1, np.int64)
        width[after[:-1]] = np.diff(after)
        pieces.hasher._powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(pieces.hasher.values[data] * pieces.hasher.up[: len(data)], dtype=np.uint64, out=sums[1:])
        for length, (prefix, number) in pieces.tables.items():
            active = active[active + length <= stop[active]]
            if not len(active):
                break
            raw = (sums[active + length] - sums[active]) * pieces.hasher.down[active]
            hashed = mix(raw + np.full(1, length, np.uint64) * _M3)
            place = np.minimum(np.searchsorted(prefix, hashed), len(prefix) - 1)
            hit = prefix[place] == hashed
            active, found = active[hit], number[place[hit]]
            whole = (found >= 0) & boundary[active + length]
            starts.append(active[whole])
            ends.append(active[whole] + length)
            numbers.append(found[whole])
            single[active[whole]] |= width[active[whole]] == length
        lone = np.flatnonzero(point & ~single[:-1])
        starts.append(lone)
        ends.append(lone + width[lone])
        numbers.append(np.full(len(lone), -1))
        start, end, number = np.concatenate(starts), np.concatenate(ends), np.concatenate(numbers).astype(np.int64)
        mine = owner[start]
        score = np.where(number >= 0, pieces.scores[number] if len(pieces.scores) else 0.0, pieces.unknown_score)
        relative = end - at[:-1][mine]
        order = np.lexsort((number, end, relative))
        self.start, self.number, self.score = start[order] + mine[order], number[order], score[order]  # nodes: a byte's place and one more per stretch before
        self.end, relative = end[order] + mine[order], relative[order]
        nodes = len(data) + count
        self.best, self.second = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        self.last = np.full(nodes, -1, np.int64)
        self.first_node = at[:-1] + np.arange(count)
        self.end_node = at[1:] + np.arange(count)
        self.best[self.first_node] = 0.0
        # All stretches advance together: first the edges that end after one byte, then after two, ...
        bounds = np.flatnonzero(np.concatenate([[True], relative[1:] != relative[:-1], [True]])) if len(relative) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            to, value = self.end[a:b], self.best[self.start[a:b]] + self.score[a:b]
            group = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(value, group)
            size = np.diff(np.concatenate([group, [b - a]]))
            tops = np.flatnonzero(value == np.repeat(top, size))
            which = tops[np.searchsorted(tops, group)]  # the first of equals
            node = to[group]
            self.best[node], self.last[node] = top, a + which
            rest = value.copy()
            rest[which] = self.second[self.start[a + which]] + self.score[a + which]
            self.second[node] = np.maximum.reduceat(rest, group)

    def best_paths(self):
        """Edge numbers of every stretch's best path in order, and per stretch the number of its first."""
        steps, owners = [], []
        node, mine = self.end_node.copy(), np.arange(len(self.end_node))
        while True:
            going = node > self.first_node[mine]
            node, mine = node[going], mine[going]
            if not len(node):
                break
            edge = self.last[node]
            steps.append(edge)
            owners.append(mine)
            node = self.start[edge]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(self.end_node) + 1, np.int64)
        edges, owner = np.concatenate(steps[::-1]), np.concatenate(owners[::-1])
        order = np.argsort(owner, kind="stable")
        return edges[order], np.searchsorted(owner[order], np.arange(len(self.end_node) + 1))

    def ids_of(self, edges):
        """The ids of edges in order, and the number of ids of each.

        A character without a piece has its bytes' ids, or the unknown id where the model has none.
        """
        pieces, number = self.pieces, self.number[edges]
        wide = np.where(number >= 0, 1, self.end[edges] - self.start[edges])
        owner = np.searchsorted(self.first_node, self.start[edges], "right") - 1
        places, _ = ragged(self.start[edges] - owner, wide)
        known = np.repeat(number, wide)
        raw = pieces.byte_ids[self.data[places]]
        own = pieces.ids[np.maximum(known, 0)] if len(pieces.ids) else known
        return np.where(known >= 0, own, np.where(raw >= 0, raw, pieces.unknown_id)), wide

    def index_by_end(self):
        self.by_end = np.argsort(self.end, kind="stable")
        self.end_at = np.searchsorted(self.end[self.by_end], np.arange(len(self.best) + 1))

    def n_best(self, stretch: int, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best paths as (score, edges), by A* from the end node backwards.

        A partial path's bound is its own score and the forward score of its first node; the bound is
        exact, so complete paths leave the queue best first. Equal scores leave in order of creation.
        """
        start_node, created, found = int(self.first_node[stretch]), 0, []
        queue = [(-float(self.best[self.end_node[stretch]]), 0, int(self.end_node[stretch]), 0.0, None)]
        while queue and len(found) < n:
            bound, _, node, behind, path = heapq.heappop(queue)
            if node == start_node:
                edges, at = [], path
                while at is not None:
                    edges.append(at[0])
                    at = at[1]
                found.append((-bound, edges))
                continue
            for e in self.by_end[self.end_at[node] : self.end_at[node + 1]].tolist():
                created += 1
                tail = behind + float(self.score[e])
                heapq.heappush(queue, (-(tail + float(self.best[self.start[e]])), created, int(self.start[e]), tail, (e, path)))
        return found


def join_lists(lists: list[list[tuple[float, list[int]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best choices of one entry from each list, as (score, entry numbers), best first."""
    first = (0,) * len(lists)
    total = lambda pick: sum(entries[k][0] for entries, k in zip(lists, pick, strict=True))
    queue, seen, out = [(-total(first), first)], {first}, []
    while queue and len(out) < n:
        value, pick = heapq.heappop(queue)
        out.append((-value, pick))
        for i, k in enumerate(pick):
            after = (*pick[:i], k + 1, *pick[i + 1 :])
            if k + 1 < len(lists[i]) and after not in seen:
                seen.add(after)
                heapq.heappush(queue, (-total(after), after))
    return out


class Segmenter:
    """Segmentations of whole texts; a task works out each distinct stretch once."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known = Known(1 << 19)
        self._forget()

    def _forget(self):
        self.known.forget()
        self.ids = Lists()
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.lists: dict[int, list[tuple[float, list[int]]]] = {}

    def _learn(self, data, starts, lengths):
        """Viterbi over the lattices of new stretches: best score, loss of the second best, ids."""
        pieces = self.pieces
        places, at = ragged(starts, lengths)
        lattice = Lattice(pieces, data[places], at)
        edges, edge_at = lattice.best_paths()
        ids, widths = lattice.ids_of(edges)
        id_at = np.concatenate([[0], np.cumsum(widths)])
        self.ids.add(ids, np.diff(id_at[edge_at]))
        best = lattice.best[lattice.end_node]
        self.best = np.concatenate([self.best, best])
        self.loss = np.concatenate([self.loss, best - lattice.second[lattice.end_node]])

    def __call__(self, data, offsets, n):
        """(ids of the best, scores of the ``n`` best, detail) for each text of a run."""
        if self.known.size > self.known.limit:
            self._forget()
        starts, text_at = self.pieces.stretches(data, offsets)
        lengths = np.diff(np.concatenate([starts, [len(data)]]))
        rows, first = self.known.rows_of(self.pieces.hasher.ranges(data, starts, starts + lengths))
        if len(first):
            self._learn(data, starts[first], lengths[first])
        flat, flat_at = self.ids.take(rows)
        flat, id_at = flat.astype(np.int32), flat_at[text_at]
        chosen, need = [], {}
        for t in range(len(offsets) - 1):
            a, b = text_at[t], text_at[t + 1]
            losses = self.loss[rows[a:b]]
            some = np.flatnonzero(np.isfinite(losses)) if n > 1 else np.zeros(0, np.int64)
            if len(some) > n - 1:
                limit = np.partition(losses[some], n - 2)[n - 2]
                some = some[losses[some] <= limit]
                some = np.sort(some[np.argsort(losses[some], kind="stable")[: n - 1]])
            chosen.append(some + a)
            for k in (some + a).tolist():
                if int(rows[k]) not in self.lists or len(self.lists[int(rows[k])]) < n:
                    need.setdefault(int(rows[k]), k)
        if need:
            spots = np.array(list(need.values()))
            places, at = ragged(starts[spots], lengths[spots])
            lattice = Lattice(self.pieces, data[places], at)
            lattice.index_by_end()
            for s, row in enumerate(need):
                self.lists[row] = [(score, lattice.ids_of(np.array(path, np.int64))[0].tolist()) for score, path in lattice.n_best(s, n)]
        out = []
        for t, picked in enumerate(chosen):
            mine = rows[text_at[t] : text_at[t + 1]]
            found = join_lists([self.lists[int(rows[k])] for k in picked], n)
            base = float(self.best[mine].sum()) - float(self.best[rows[picked]].sum())
            spot = {int(k) - int(text_at[t]): i for i, k in enumerate(picked)}
            out.append((flat[id_at[t] : id_at[t + 1]], [base + score for score, _ in found], (mine, spot, found)))
        return out

    def alternatives(self, detail) -> list[list[int]]:
        """The ids of each of a text's best segmentations, from the detail of the call."""
        mine, spot, found = detail
        out = []
        for _, pick in found:
            ids: list[int] = []
            for k, row in enumerate(mine.tolist()):
                ids += self.lists[row][pick[spot[k]]][1] if k in spot else self.ids.values[self.ids.at[row] : self.ids.at[row + 1]].tolist()
            out.append(ids)
        return out


    def each(self, found, n):
        """For each rank of the ``n``, from the results of the call: which texts have a segmentation of that
        rank, all texts' ids of it end to end (none for the others), and where each text begins."""
        details = [f[2] for f in found]
        text_at = np.concatenate([[0], np.cumsum([len(mine) for mine, _, _ in details])]).astype(np.int64)
        flat, flat_at = self.ids.take(np.concatenate([mine for mine, _, _ in details]))
        for rank in range(n):
            starts, lengths = flat_at[:-1].copy(), np.diff(flat_at)
            there = np.array([len(picks) > rank for _, _, picks in details])
            parts, size = [flat], len(flat)
            for t, (mine, spot, picks) in enumerate(details):
                if not there[t]:
                    lengths[text_at[t] : text_at[t + 1]] = 0
                    continue
                for k, i in spot.items():
                    ids = self.lists[int(mine[k])][picks[rank][1][i]][1]
                    starts[text_at[t] + k], lengths[text_at[t] + k] = size, len(ids)
                    parts.append(np.array(ids, np.int64))
                    size += len(ids)
            places, at = ragged(starts, lengths)
            yield there, np.concatenate(parts)[places], at[text_at]


class Checksums:
    """CRC of the ids of a segmentation, and of the text that they decode to."""

    def __init__(self, pieces_bytes: list[bytes]):
        self.size = np.array([len(x) for x in pieces_bytes])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(pieces_bytes), np.uint8)

    def __call__(self, ids) -> tuple[int, int]:
        raw = self.flat[ragged(self.at[ids], self.size[ids])[0]].tobytes()
        return zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(raw.removeprefix(b" "))


def _prepared(text):
    """The model's form of a text: a leading blank and blanks for blank marks; empty texts stay empty."""
    text = F.coalesce(F.col(text), F.lit(""))
    return F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.replace(text, F.lit("▁"), F.lit(" "))))


def n_best(docs: DataFrame, model: str, n: int, text="text", keep=("doc_id",), all_ids=True) -> DataFrame:
    """Per row the ids of the best segmentation, and the scores (and ids) of the ``n`` best, best first.

    ``model`` is a model file that every executor can open. A null or empty text has no pieces and one
    segmentation with score 0. Fewer than ``n`` scores mean that no further segmentation exists. Among
    equal scores the order is fixed by the lattice, so a text gets the same list wherever it occurs.
    Rows are handled one by one: repeated rows and null ids stay, further columns are left out.
    """
    source = docs.select(*keep, _prepared(text).alias("_text"))
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*[source.schema[k] for k in keep], T.StructField("ids", ids), T.StructField("scores", T.ArrayType(T.DoubleType())),
                           *([T.StructField("all_ids", T.ArrayType(ids))] if all_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segmenter(model)
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(len(keep)), RUN):
                found = segment(data, offsets, n)
                part = batch.slice(first, end - first)
                columns = [*[part.column(i) for i in range(len(keep))], pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                           pa.array([f[1] for f in found], pa.list_(pa.float64()))]
                if all_ids:
                    columns.append(pa.array([segment.alternatives(f[2]) for f in found], pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids="ids", keep=("doc_id",)) -> DataFrame:
    """The text of each row's ids: pieces joined, byte pieces as bytes, the leading blank removed.

    Null ids give a null text, no ids an empty one; bytes that are no UTF-8 show as replacement
    characters, ids outside the model as nothing.
    """
    source = encoded.select(*keep, F.col(ids).alias("_ids"))
    schema = T.StructType([*[source.schema[k] for k in keep], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Pieces(model).bytes_of
        for batch in batches:
            texts = []
            for row in batch.column(len(keep)):
                raw = None if row.as_py() is None else b"".join([of[i] for i in row.as_py() if i is not None and 0 <= i < len(of)])
                texts.append(None if raw is None else raw.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame, model: str, keep=("doc_id",)) -> DataFrame:
    """Per row of ``n_best``: number and CRC of the best ids, and CRC of the text that they decode to."""
    source = encoded.select(*keep, "ids", "scores")
    schema = T.StructType([*[source.schema[k] for k in keep], *[T.StructField(c, T.LongType()) for c in ("n_pieces", "ids_crc32", "text_crc32")],
                           source.schema["scores"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums(Pieces(model).bytes_of)
        for batch in batches:
            column = batch.column(len(keep))
            values, cuts = column.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            crcs = np.array([sums(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(len(keep))], pa.array(np.diff(cuts)), pa.array(crcs[:, 0]), pa.array(crcs[:, 1]),
                batch.column(len(keep) + 1)], names=schema.names)

    return source.mapInArrow(run, schema)


def n_best_digests(docs: DataFrame, model: str, n: int, text="text", keep=("doc_id",)) -> DataFrame:
    """Per row, for each of the ``n`` best segmentations, best first: number and CRC of its ids, CRC of the
    text that they decode to, and its score. What ``n_best`` tells of a row holds here; the ids are built
    and decoded in the task and do not leave it."""
    source = docs.select(*keep, _prepared(text).alias("_text"))
    schema = T.StructType([*[source.schema[k] for k in keep], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("n_pieces", "ids_crc32", "text_crc32")],
                           T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segmenter(model)
        sums = Checksums(segment.pieces.bytes_of)
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(len(keep)), RUN):
                found = segment(data, offsets, n)
                told = [([], [], []) for _ in found]
                for there, ids, at in segment.each(found, n):
                    for t in np.flatnonzero(there).tolist():
                        mine = ids[at[t] : at[t + 1]]
                        for out, value in zip(told[t], (len(mine), *sums(mine)), strict=True):
                            out.append(value)
                part = batch.slice(first, end - first)
                columns = [*[part.column(i) for i in range(len(keep))], *[pa.array([x[i] for x in told], pa.list_(pa.int64())) for i in range(3)],
                           pa.array([f[1] for f in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
