"""Hierarchical navigable small-world graphs in numpy, for the vectors of one shard.

Insertion and search work on many vectors in lockstep: every step expands the best open entries of all
beams at once, so the inner loops are array operations.
"""

from __future__ import annotations

import numpy as np

LINKS, BUILD_BEAM, BATCH, EXPAND = 12, 48, 512, 4


def levels_of(count: int, links=LINKS) -> np.ndarray:
    """Levels with geometric frequencies, a fixed function of a vector's place."""
    x = (np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    x = (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)
    share = (x.astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(np.clip(share, 1e-12, 1.0)) / np.log(links)).astype(np.int64)


def beam_search(vectors, near, queries, entries, beam: int):
    """(ids, similarities), best first, of a beam search on one level; -1 fills what was not reached.

    ``near`` has the neighbours of each vector, ``entries`` at least one start for each query.
    """
    total, n = len(queries), len(vectors)
    ids = np.full((total, beam), -1, np.int64)
    sims = np.full((total, beam), -np.inf, np.float32)
    opened = np.zeros((total, beam), bool)
    seen = np.zeros(total * n, bool)

    def add(rows, nodes):
        """Puts unseen nodes into the beams of their queries; rows are ascending."""
        flat = np.unique(rows * n + nodes)
        flat = flat[~seen[flat]]
        if not len(flat):
            return
        seen[flat] = True
        rows, nodes = flat // n, flat % n
        values = np.einsum("ij,ij->i", queries[rows], vectors[nodes])
        touched, first, counts = np.unique(rows, return_index=True, return_counts=True)
        wide = int(counts.max())
        slot = np.arange(len(rows)) - np.repeat(first, counts)
        line = np.repeat(np.arange(len(touched)), counts)
        new_ids = np.full((len(touched), wide), -1, np.int64)
        new_sims = np.full((len(touched), wide), -np.inf, np.float32)
        new_ids[line, slot], new_sims[line, slot] = nodes, values
        all_sims = np.concatenate([sims[touched], new_sims], 1)
        top = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        sims[touched] = np.take_along_axis(all_sims, top, 1)
        ids[touched] = np.take_along_axis(np.concatenate([ids[touched], new_ids], 1), top, 1)
        opened[touched] = np.take_along_axis(np.concatenate([opened[touched], np.zeros((len(touched), wide), bool)], 1), top, 1)

    rows = np.repeat(np.arange(total), entries.shape[1])
    good = entries.ravel() >= 0
    add(rows[good], entries.ravel()[good])
    active = np.arange(total)
    take = min(EXPAND, beam)
    while len(active):
        free = np.where(opened[active] | (ids[active] < 0), -np.inf, sims[active])
        best = np.argpartition(-free, take - 1, 1)[:, :take]
        usable = np.isfinite(np.take_along_axis(free, best, 1))
        going = usable.any(1)
        active, best, usable = active[going], best[going], usable[going]
        if not len(active):
            break
        r, c = np.nonzero(usable)
        row, place = active[r], best[r, c]
        opened[row, place] = True
        found = near[ids[row, place]]
        rows = np.repeat(row, found.shape[1])
        nodes = found.ravel()
        good = nodes >= 0
        add(rows[good], nodes[good])
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(vectors, ids, sims, count: int) -> np.ndarray:
    """Up to ``count`` neighbours for each row: best first, those nearer to a chosen one than to the
    row only if places are left. ``ids`` are sorted by similarity, -1 is empty."""
    rows, wide = ids.shape
    there = ids >= 0
    points = vectors[np.maximum(ids, 0)]
    among = np.einsum("bid,bjd->bij", points, points, optimize=True)
    chosen = np.zeros((rows, wide), bool)
    for k in range(wide):
        rival = (among[:, k, :] > sims[:, k, None]) & chosen
        chosen[:, k] = there[:, k] & ~rival.any(1) & (chosen.sum(1) < count)
    rank = np.where(chosen, 0, np.where(there, 1, 2)) * wide + np.arange(wide)
    order = np.argsort(rank, 1)[:, :count]
    out = np.take_along_axis(np.where(there, ids, -1), order, 1)
    if out.shape[1] < count:
        out = np.concatenate([out, np.full((rows, count - out.shape[1]), -1)], 1)
    return out


class Graph:
    """The graph of unit vectors (float32): the neighbours of each level, lowest first, and an entry."""

    def __init__(self, vectors, links=LINKS):
        self.vectors, self.links = np.ascontiguousarray(vectors, np.float32), links
        n = len(vectors)
        self.level = levels_of(n, links)
        top = int(self.level.max()) if n else 0
        self.near = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(top + 1)]
        self.entry = -1
        done = 0
        while done < n:
            size = max(1, min(BATCH, done if done > 32 else 32, n - done))
            self._insert(np.arange(done, done + size), done)
            done += size

    def _insert(self, new, done):
        queries = self.vectors[new]
        entry = np.full((len(new), 1), self.entry, np.int64)
        inside = queries @ queries.T
        np.fill_diagonal(inside, -np.inf)
        for k in range(len(self.near) - 1, -1, -1):
            here = self.level[new] >= k
            start = entry
            if self.entry >= 0 and self.level[self.entry] >= k:
                passing = np.flatnonzero(~here)
                if len(passing):
                    found, _ = beam_search(self.vectors, self.near[k], queries[passing], start[passing], 1)
                    entry[passing, 0] = found[:, 0]
            mine = np.flatnonzero(here)
            if not len(mine):
                continue
            ids = np.full((len(mine), BUILD_BEAM), -1, np.int64)
            sims = np.full((len(mine), BUILD_BEAM), -np.inf, np.float32)
            if self.entry >= 0 and self.level[self.entry] >= k:
                ids, sims = beam_search(self.vectors, self.near[k], queries[mine], start[mine], BUILD_BEAM)
                entry[mine, 0] = ids[:, 0]
            # The batch's own members do not find each other by the graph.
            own = inside[np.ix_(mine, mine)]
            wide = min(self.links, len(mine))
            top = np.argpartition(-own, wide - 1, 1)[:, :wide]
            own_sims = np.take_along_axis(own, top, 1)
            all_ids = np.concatenate([ids, np.where(np.isfinite(own_sims), new[mine][top], -1)], 1)
            all_sims = np.concatenate([sims, own_sims], 1)
            order = np.argsort(-all_sims, 1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            self._link(k, new[mine], choose(self.vectors, ids, sims, self.links))
        highest = new[np.argmax(self.level[new])]
        if self.entry < 0 or self.level[highest] > self.level[self.entry]:
            self.entry = int(highest)

    def _link(self, k, nodes, chosen):
        near = self.near[k]
        width = near.shape[1]
        near[nodes, : chosen.shape[1]] = chosen
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        good = target >= 0
        source, target = source[good], target[good]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        back, first, counts = np.unique(target, return_index=True, return_counts=True)
        by_count = np.argsort(counts, kind="stable")
        for a in range(0, len(back), 1024):  # targets with about as many new links together
            pick = by_count[a : a + 1024]
            wide = int(counts[pick].max())
            slot = np.arange(wide)[None, :]
            there = slot < counts[pick][:, None]
            added = np.where(there, source[np.minimum(first[pick][:, None] + slot, len(source) - 1)], -1)
            both = np.concatenate([near[back[pick]], added], 1)
            points = self.vectors[np.maximum(both, 0)]
            sims = np.where(both >= 0, np.einsum("bd,bjd->bj", self.vectors[back[pick]], points), -np.inf)
            sorted_ = np.sort(both, 1)
            if (sorted_[:, 1:] == sorted_[:, :-1])[sorted_[:, 1:] >= 0].any():  # a link made from both ends
                for row, (line, value) in enumerate(zip(both, sims, strict=True)):
                    _, keep = np.unique(line, return_index=True)
                    twice = np.setdiff1d(np.arange(len(line)), keep)
                    both[row, twice], value[twice] = -1, -np.inf
            order = np.argsort(-sims, 1, kind="stable")[:, : 4 * width]
            both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
            near[back[pick]] = choose(self.vectors, both, sims, width) if both.shape[1] > width else both

    def search(self, queries, beam: int, own=None):
        """(ids, similarities) of a beam for each query; ``own`` are further entries on the lowest level."""
        out_ids, out_sims = [], []
        step = max(1, min(1024, (64 << 20) // max(len(self.vectors), 1)))
        for a in range(0, len(queries), step):
            part = queries[a : a + step]
            entry = np.full((len(part), 1), self.entry, np.int64)
            for k in range(int(self.level[self.entry]), 0, -1):
                entry = beam_search(self.vectors, self.near[k], part, entry, 1)[0]
            if own is not None:
                entry = np.concatenate([entry, own[a : a + step, None]], 1)
            ids, sims = beam_search(self.vectors, self.near[0], part, entry, beam)
            out_ids.append(ids)
            out_sims.append(sims)
        return np.concatenate(out_ids), np.concatenate(out_sims)
