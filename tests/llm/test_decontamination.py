"""Benchmark decontamination against plain Python, with one set and with many."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import decontamination as dec

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
pick = random.Random(8)
VOCABULARY = ["".join(pick.choices("abcdé日ß9", k=pick.randrange(1, 7))) for _ in range(60)]
LONG = " ".join(pick.choices(VOCABULARY, k=400))


def some(n):
    return " ".join(pick.choices(VOCABULARY, k=n))


ITEMS = [(1, some(14)), (2, some(10)), (3, "Only, three-words"), (4, "x"), (5, None), (6, ""), (7, " ... "), (8, LONG), (2, some(12)), (2, "no no"),
         (None, some(11)), (10, some(25)), (11, "same passage of ten words that two items do hold"), (12, "same passage of ten words that two items do hold too")]
TEXTS = [None, "", "  ", "x", "X!", "only THREE words", "only three", some(5000), "a same passage of ten words that, two items do hold too.", "no no no no",
         *(f"{some(7)} {i[1]}; {some(9)}" for i in ITEMS), *(f"Start {' '.join(i[1].upper().split()[:10])}. {some(3)} {LONG[500:900]}" for i in ITEMS if i[1]),
         " ".join((i[1] or "") for i in ITEMS) * 3]


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, items=ITEMS, size=10):
    words, hit, names = lowered(text), set(), set()
    for name, body in items:
        mine = lowered(body)
        n = min(len(mine), size)
        windows = {tuple(mine[i : i + n]) for i in range(len(mine) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add("" if name is None else str(name))
    return len(words), hit, sorted(names)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, 1, "r", 0.5) for i, t in enumerate(TEXTS)] + [(8, TEXTS[8], 1, "r", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string, spans double").repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(*x, "t", 1) for x in ITEMS], "item_id long, text string, words string, part int").repartition(2)


@pytest.mark.parametrize("set_bytes, slice_windows", [(1 << 20, 4096), (700, 5)])
def test_equals_plain_python(docs, benchmark, set_bytes, slice_windows, monkeypatch):
    monkeypatch.setattr(dec, "SLICE_WINDOWS", slice_windows)
    assert (len(list(dec.window_sets(benchmark, set_bytes=set_bytes))) > 2) == (set_bytes < 1000)
    rows = dec.find_benchmark_text(docs, benchmark, set_bytes=set_bytes).select("row.doc_id", "text", "n_words", "spans", "items").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        n, hit, names = by_hand(r["text"])
        assert (r["n_words"], r["items"]) == (n, names)
        assert {w for s in r["spans"] for w in range(s["first"], s["end"])} == hit
        assert all(a["end"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_report_and_removal(docs, benchmark):
    found = dec.find_benchmark_text(docs, benchmark)
    rows = {r["doc_id"]: r for r in dec.report(found).collect()}
    clean = {i for i, t in enumerate(TEXTS) if not by_hand(t)[1]}
    assert {i for i, r in rows.items() if i is not None and not r["contaminated"]} == clean - {4}
    assert rows[8]["n_items"] == 2 and rows[8]["n_hit"] == 11 and rows[8]["items"] == ["11", "12"]
    kept = dec.remove_documents(found)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean - {4}
    half = {r["doc_id"] for r in dec.remove_documents(found, 0.5).collect()}
    assert half - {None} == {i for i, t in enumerate(TEXTS) if i != 4 and len(by_hand(t)[1]) <= 0.5 * by_hand(t)[0]}
    cut = dec.remove_spans(found)
    assert cut.dtypes == docs.dtypes and cut.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[0] is None and texts[3] == "" and texts[6] == TEXTS[6] and texts[8] == "a ."
    for i, text in texts.items():
        if i is not None:
            n, hit, _ = by_hand(TEXTS[i])
            assert lowered(text) == [w for k, w in enumerate(lowered(TEXTS[i])) if k not in hit]


def test_empty_tables(spark, docs, benchmark):
    assert dec.find_benchmark_text(docs.limit(0), benchmark).collect() == []
    rows = dec.report(dec.find_benchmark_text(docs, benchmark.limit(0))).collect()
    assert len(rows) == len(TEXTS) + 1 and not any(r["contaminated"] for r in rows) and max(r["n_words"] for r in rows) > 100


def test_equal_hashes_of_other_words_are_no_hit(monkeypatch):
    whole = dec.WindowHasher.windows
    monkeypatch.setattr(dec.WindowHasher, "windows", lambda self, sums, first, size: whole(self, sums, first, size) & np.uint64(3))
    texts = [t for t in TEXTS if t and len(t) < 3000]
    windows = dec.WindowSet([i[1] for i in ITEMS if i[1] and lowered(i[1])], range(len([i for i in ITEMS if i[1] and lowered(i[1])])))
    (_, _, data, offsets), = dec.text_runs(pa.array(texts))
    normal = dec.NormalText(data, offsets)
    word, size, _ = windows.scan(normal)
    for i, text in enumerate(texts):
        mine = (word >= normal.word_at[i]) & (word < normal.word_at[i + 1])
        got = {w for a, n in zip(word[mine] - normal.word_at[i], size[mine]) for w in range(a, a + n)}
        assert got == by_hand(text)[1]


def test_merged_spans():
    a, b = dec.merge_spans(np.array([5, 0, 2, 20, 12, 7]), np.array([7, 3, 4, 21, 22, 9]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 4), (5, 9), (12, 22)]
    assert [len(x) for x in dec.merge_spans(np.zeros(0, int), np.zeros(0, int))] == [0, 0]
