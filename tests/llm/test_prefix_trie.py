"""The trie of conversation openings against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from docflow.llm import prefix_trie as trie

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, words string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def sequences(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            found[conv].append(((turn is not None, turn or 0), digest, role, text))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in found.items()}


def rebuilt(seqs):
    out = {}
    for c, seq in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = seqs.get(rest, [])[:h] + seq[h:]
    return out


def by_hand(seqs):
    """All nodes by their turns, totals by walking up from every node."""
    ids = {(): 0} if seqs else {}
    member, parent, path_of = defaultdict(list), {0: None}, {}
    for c, seq in seqs.items():
        at, path = 0, [0]
        for turn in seq:
            up, at = at, ids.setdefault((at, turn), len(ids))
            parent[at] = up
            path.append(at)
        path_of[c] = path
        for n in path:
            member[n].append(c)
    last = {n: key[1][1] for key, n in ids.items() if key}
    depth = {}
    for path in path_of.values():
        depth.update({n: d for d, n in enumerate(path)})
    children, leaves, saved, ends = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for n, up in parent.items():
        if up is not None:
            children[up] += 1
    for n in sorted(depth, key=depth.get, reverse=True):
        leaves[n] += 0 if children[n] else 1
        saved[n] += (len(member[n]) - 1) * len(WORD.findall(last.get(n, "")))
        if parent[n] is not None:
            leaves[parent[n]] += leaves[n]
            saved[parent[n]] += saved[n]
    for c, path in path_of.items():
        ends[path[-1]].append(c)
    return sorted((min(member[n]), d, -1 if parent[n] is None else min(member[parent[n]]), len(member[n]), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, d in depth.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(df):
    rows = df.collect()
    assert len({r["node"] for r in rows}) == len(rows)
    assert {r["parent_node"] for r in rows} - {None} <= {r["node"] for r in rows}
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in rows)


def odd_rows():
    pick, rows = random.Random(3), []
    for c in [*range(-45, 130, 3), *range(0, 61, 20)]:
        if c == 40:
            continue  # a base that is not there
        for turn in range(pick.randrange(1, 7)):
            rows.append((c, turn, pick.choice(["user", "assistant", None]), pick.choice(["a b", "a", "", None, "long  text\twith é words"])))
    rows += [(200, None, "user", "x"), (200, None, "user", "x"), (200, 5, "user", "b"), (200, 5, "user", "a"), (200, -3, None, None)]
    rows += [(1 << 40, 1 << 45, "user", "far"), (1 << 40, 0, "user", "near"), (1 << 40, -(1 << 45), "user", "first"), (None, 0, "user", "no id")]
    return rows + rows[:4]


def test_rebuilt_conversations_equal_plain_python(spark):
    rows = odd_rows()
    turns, convs = trie.with_borrowed_openings(trie.numbered_turns(table(spark, rows)))
    assert found(trie.prefix_trie(turns, convs)) == by_hand(rebuilt(sequences(rows)))


@pytest.mark.parametrize("height", [2, 4, 32])
def test_bands_of_bands(spark, height):
    pick, rows = random.Random(height), []
    trunk = [("user", f"turn {i % 7} of many") for i in range(90 if height < 32 else 70)]
    for c in range(12):  # branches off a long trunk at several depths, some of them copies
        cut = pick.choice([0, 3, height, height + 1, 2 * height, 30, 64, len(trunk)])
        seq = trunk[:cut] + [("assistant", f"branch {c % 5} {i}") for i in range(pick.randrange(0, 40))]
        rows += [(c, i, *t) for i, t in enumerate(seq)]
    got = trie.numbered_turns(table(spark, rows))
    assert found(trie.prefix_trie(got, trie.conversations_of(got), height)) == by_hand(sequences(rows))


def test_conversations_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 4)
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rows = [(c, t, "user", f"word {t}") for c in (7, 3, 900) for t in range(75)] + [(c, 2 * t, "user", f"word {t}") for c in range(20, 60) for t in range(c % 4 + 30)]
    rows += [(-c, 0, "user", "one") for c in range(1, 30)]
    got = trie.numbered_turns(table(spark, rows))
    places = {(r["conv"], r["pos"]): r["total"] for r in got.collect()}
    assert len(places) == len(rows) and all(p < n for (_, p), n in places.items())
    assert found(trie.prefix_trie(got, trie.conversations_of(got), 16)) == by_hand(sequences(rows))


def test_no_rows_and_wrong_height(spark):
    turns, convs = trie.with_borrowed_openings(trie.numbered_turns(table(spark, odd_rows()).limit(0)))
    assert trie.prefix_trie(turns, convs).collect() == []
    with pytest.raises(ValueError):
        trie.prefix_trie(turns, convs, 48)
