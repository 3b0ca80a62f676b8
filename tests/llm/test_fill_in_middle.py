"""Fill-in-the-middle against plain Python, and the chunk memory on its own."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import fill_in_middle as fim
from docflow.llm.text_bytes import Hasher, text_runs

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = [None, "", " ", "\n\n", "word", " word ", "two words", "a <P> b", "<S>", "x<M>", "<", "P> <", "é café   nbsp \x85x", "日本語 テキスト",
         "🙂 emoji 🙂🙂 ", "no" * 30_000, " " * 20_000, "the end of a long text.\n" * 6000, "ends with < and P>"]


def by_hand(key, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 * r + i, t, 1, "f", "o") for r in range(6) for i, t in enumerate(TEXTS)]
    rows += [(None, "a text without an id", 1, "f", "o"), (3, "another text of id 3", 1, "f", "o"), rows[6], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, form string, output string").repartition(3)


def test_equals_plain_python(docs):
    got = docs.transform(fim.fill_in_middle).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore().alias("back")).collect()
    texts = docs.collect()
    want = sorted(((r["doc_id"], *by_hand(r["doc_id"], r["text"]), r["text"] or "") for r in texts), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(i, f"text number {i} (a) of <P> some") for i in range(50)], "k int, body string")
    made = fim.fill_in_middle(docs, "k", "body", seed=1, percent=100, suffix_first=0, marks=("(p)", "[s]", "{m}"))
    rows = made.select("k", "form", "output", fim.restore(marks=("(p)", "[s]", "{m}")).alias("back")).collect()
    assert {r["form"] for r in rows} == {"psm"} and all(r["back"] == f"text number {r['k']} (a) of <P> some" for r in rows)
    assert all(r["output"].startswith("(p)") and "[s]" in r["output"] and "{m}" in r["output"] for r in rows)


def run_of(texts):
    (_, _, data, offsets), = text_runs(pa.array(texts))
    return data, offsets


def test_shared_passages_are_counted_once():
    pick = random.Random(5)
    passage = " ".join("".join(pick.choices("abcdefgh", k=5)) for _ in range(3000))
    memory = fim.ChunkMemory()
    fim.UnitIndex(*run_of([f"{i} own start {passage} and end {i}" for i in range(20)]), memory)
    chunks = len(fim.chunk_limits(*run_of([passage]))) - 1
    assert chunks > 20 and memory.reused > 18 * (chunks - 2) and memory.known.size < 3 * chunks


def test_chunks_depend_on_content_only():
    pick = random.Random(6)
    passage = bytes(pick.choices(range(32, 127), k=20_000)).decode()
    cuts = []
    for before in ("", "x", "some other words " * 30):
        data, offsets = run_of([before + passage])
        cuts.append({int(x) - len(before) for x in fim.chunk_limits(data, offsets)} - {0, -len(before)})
    assert len(cuts[0] & cuts[1] & cuts[2]) >= len(cuts[0]) - 1


@pytest.mark.parametrize("limit", [0, 2000, 1 << 20])
def test_units_by_chunks_equal_units_by_scan(limit, monkeypatch):
    pick = random.Random(limit)
    monkeypatch.setattr(fim, "MOST_BYTES", 40)
    for hasher in (Hasher(7), type("Same", (), {"ranges": lambda self, d, s, e: (e - s).astype(np.uint64) % np.uint64(3)})()):
        memory = fim.ChunkMemory(hasher, limit)
        for _ in range(30):
            texts = ["".join(pick.choices(["ab", " ", "\n", "é", "日本", "  x", "word "], k=pick.randrange(120))) for _ in range(8)]
            texts += texts[:2]
            index = fim.UnitIndex(*run_of(texts), memory)
            for i, text in enumerate(texts):
                units = UNIT.findall(text)
                assert index.units[i] == len(units) and index.chars[i] == len(text)
                at = np.arange(len(units) + 1)
                assert index.chars_before(np.full(len(at), i), at).tolist() == [len("".join(units[:k])) for k in at]
