"""The text operators against plain Python on small rows with every kind of odd value."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm import language, line_dedup, packing, piece_lattice, repetition

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = "the end of a long text. " * 4000
TEXTS = [
    None, "", " ", "\n\n", "word", "two words", "The the THE the", "a b c a b c a b c", "Été über señor, straße; 12 345!",
    "line one\nline two\nline one\n\n  line one ", "x\ty\r\nz\x0bq\x0c", "# ## *** | <b> $5 & 7%", "日本語 テキスト 日本語", "🙂 emoji 🙂🙂", "é café   nbsp",
    "<|endoftext|> and <|startoftext|>end", "'s it's 'LL we'll", "▁mark ▁▁", LONG, "no" * 3000, "word", "İstanbul ΣΑΣ ǆ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "en", "src", 5, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "src", 5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, `_text` string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    rows = df.collect()
    return {r["doc_id"]: r for r in rows}, len(rows)


# --- packing -------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 4095, 4096, 4097, 10_000, 12_289])
def test_pieces_are_powers_of_two_that_cover_the_text(n):
    found = packing.pieces(n)
    assert [s for s, _ in found] == list(itertools.accumulate([0, *[x for _, x in found]]))[:-1]
    assert sum(x for _, x in found) == n and all(x <= 4096 and x & (x - 1) == 0 for _, x in found)
    assert len([x for _, x in found if x < 4096]) == bin(n % 4096).count("1")


def test_packed_ids_are_the_tokenizers(docs, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs, VOCABULARY).collect()
    assert packing.pack(empty, VOCABULARY).collect() == []
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    ids = [i for i in range(len(TEXTS)) if i not in (4, 5)]
    for i in ids:
        mine = sorted([r for r in rows if r["doc_id"] == i], key=lambda r: r["start"])
        want = [*tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert [x for r in mine for x in r["ids"]] == want, TEXTS[i]
        assert all(r["doc_tokens"] == len(want) and r["length"] == len(r["ids"]) and r["offset"] == 0 for r in mine)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    assert len([r for r in rows if r["doc_id"] is None and r["start"] == 0]) == 1
    assert len([r for r in rows if r["doc_id"] == 5 and r["start"] == 0]) == 2  # repeated rows are packed twice


def test_packed_ids_of_random_texts():
    encode = packing.StretchIds(VOCABULARY)
    tokenizer, pick = Tokenizer.from_file(VOCABULARY), random.Random(3)
    from docflow.llm.text_bytes import text_runs
    import pyarrow as pa

    signs = "abcXYZ .,;'-_\"!?09éÉßœ\n\t\ŕ İΣ日<|>🙂"
    texts = ["".join(pick.choice(signs) for _ in range(pick.randrange(60))) for _ in range(400)]
    for first, end, data, offsets in text_runs(pa.array(texts)):
        values, at = encode(data, offsets)
        for k, text in enumerate(texts[first:end]):
            assert values[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_buckets_hold_equal_lengths(spark, docs, tmp_path):
    packing.write_buckets(packing.pack(docs, VOCABULARY), str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.where("length != 1 << bucket").count() == 0


# --- pieces -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return piece_lattice.Pieces(MODEL)


def every_segmentation(pieces, raw):
    """(score, ids) of all segmentations of a byte string, by trying every piece everywhere."""
    table = {}
    for name, score, number in zip(pieces.names, pieces.scores, pieces.ids, strict=True):
        table.setdefault(name, []).append((float(score), [int(number)]))

    def go(at):
        if at == len(raw):
            return [(0.0, [])]
        out, width = [], 1
        while at + width < len(raw) and raw[at + width] & 0xC0 == 0x80:
            width += 1
        if raw[at : at + width] not in table:
            ids = [int(pieces.byte_ids[b]) for b in raw[at : at + width]]
            out += [(pieces.unknown_score + s, ids + rest) for s, rest in go(at + width)]
        for end in range(at + 1, len(raw) + 1):
            for score, ids in table.get(raw[at:end], []):
                out += [(score + s, ids + rest) for s, rest in go(end)]
        return out

    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["abc", "the cat", "Hello w", "été", "a\nbc", "漢x", "  b", "aaaa"])
@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_n_best_equals_every_segmentation_sorted(spark, pieces, text, n):
    want = every_segmentation(pieces, (" " + text).encode())
    row = piece_lattice.n_best(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL, n).first()
    assert row["scores"] == [s for s, _ in want[:n]]
    scores = {tuple(ids): s for s, ids in want}
    assert [scores[tuple(ids)] for ids in row["all_ids"]] == row["scores"]
    assert len({tuple(ids) for ids in row["all_ids"]}) == len(row["all_ids"])
    assert row["ids"] == row["all_ids"][0]


def test_a_star_order_on_ties_and_long_stretches(spark, pieces):
    text = "aaaaaaaa bbbbbbbb the thethe"
    one = piece_lattice.n_best(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL, 40).first()
    assert one["scores"] == sorted(one["scores"], reverse=True) and len(one["scores"]) == 40
    few = piece_lattice.n_best(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL, 7).first()
    assert few["scores"] == one["scores"][:7]


def test_decoding_gives_the_text_back(docs, empty):
    found = piece_lattice.n_best(docs, MODEL, 3)
    assert piece_lattice.n_best(empty, MODEL, 3).collect() == [] and piece_lattice.decode(piece_lattice.n_best(empty, MODEL, 3), MODEL).collect() == []
    back, n = by_id(piece_lattice.decode(found, MODEL))
    assert n == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        if i != 4:
            assert back[i]["text"] == (text or "").replace("▁", " ")
    told, _ = by_id(piece_lattice.digests(found, MODEL))
    assert all(told[i]["text_crc32"] == zlib.crc32((t or "").replace("▁", " ").encode()) for i, t in enumerate(TEXTS) if i != 4)
    assert told[0]["n_pieces"] == 0 and list(told[0]["scores"]) == [0.0]


def test_digests_describe_all_segmentations(spark, docs, empty, tmp_path):
    want, n = by_id(piece_lattice.n_best(docs, MODEL, 4))
    found, m = by_id(piece_lattice.n_best_digests(docs, MODEL, 4))
    assert n == m and piece_lattice.n_best_digests(empty, MODEL, 4).collect() == []
    for i, text in enumerate(TEXTS):
        if i != 4:
            assert found[i]["scores"] == want[i]["scores"] and found[i]["n_pieces"] == [len(ids) for ids in want[i]["all_ids"]]
            assert found[i]["ids_crc32"] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in want[i]["all_ids"]]
            assert set(found[i]["text_crc32"]) == {zlib.crc32((text or "").replace("▁", " ").encode())}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from docflow.llm.queries import QUERIES

    asked, _ = by_id(QUERIES["op1_piece_lattice"](spark, str(tmp_path)))
    assert all(asked[i]["ids_crc32"] == found[i]["ids_crc32"] for i in range(len(TEXTS)) if i != 4)
    assert len(set(asked[5]["ids_crc32"])) == 4


def test_a_text_has_the_same_list_wherever_it_occurs(spark):
    rows = [(i, "same old text, the same") for i in range(4)] + [(9, "other words entirely")]
    found = piece_lattice.n_best(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), MODEL, 6).collect()
    assert len({str(r["all_ids"]) for r in found if r["doc_id"] < 4}) == 1


# --- languages ----------------------------------------------------------------------


def test_language_of_clear_texts(spark):
    kinds = {"en": "the cat and the dog went with that house", "de": "der hund und die katze gehen nicht über", "fr": "le chat et les chiens où été déjà"}
    pick = random.Random(1)
    rows = [(i, " ".join(pick.choices(t.split(), k=12)), k) for i, (k, t) in enumerate(list(kinds.items()) * 30)]
    rows += [(900, "text without a label", None), (901, None, "en"), (902, "", "de")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels, matrix = language.fit(train)
    assert labels == ["de", "en", "fr"] and matrix.shape == (language.FEATURES + 1, 3)
    asked = [(1, "the dog", "x"), (2, "katze und hund", "x"), (3, "12 34 !!", "x"), (4, None, "x"), (5, "", "x"), (None, "THE CAT", "x"), (6, "chat " * 30000, "x"), (6, "chat " * 30000, "x")]
    found = language.identify(spark.createDataFrame(asked, "doc_id long, text string, lang_pred string"), (labels, matrix)).collect()
    assert [r["lang_pred"] for r in found] == ["en", "de", "und", "und", "und", "en", "fr", "fr"]
    assert all(0 <= r["score"] <= 1 for r in found) and found[2]["score"] == 0
    none = language.fit(train.limit(0))
    assert {r["lang_pred"] for r in language.identify(train, none).collect()} == {"und"}
    assert language.identify(train.limit(0), (labels, matrix)).collect() == []


def test_feature_counts_equal_one_pass_over_all_rows(spark):
    texts = ["abc abd", "ab", "", "Ünder Öl", "a" * 500]
    rows = [(t, "x") for t in texts] * 3
    parts = language.feature_counts(spark.createDataFrame(rows, "text string, lang string").repartition(5)).collect()
    total = np.zeros(language.FEATURES)
    for r in parts:
        total[r["numbers"]] += r["counts"]
    from docflow.llm.text_bytes import text_runs
    import pyarrow as pa

    want = np.zeros(language.FEATURES)
    for t in texts:  # each text by itself
        for _, _, data, offsets in text_runs(pa.array([t])):
            want += 3 * np.bincount(language.n_gram_features(data, offsets)[0], minlength=language.FEATURES)
    assert (total == want).all()


def plain_features(text):
    """Hashed n-grams of letters, one by one."""
    line = [0]
    for c in text or "":
        if c.isalpha():
            line.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif line[-1]:
            line.append(0)
    if line[-1]:
        line.append(0)
    whole, out = (1 << 64) - 1, []
    for n in language.ORDERS:
        for window in zip(*[line[k:] for k in range(n)]):
            if sum(p != 0 for p in window) < max(1, n - 1):
                continue
            h = n
            for p in window:
                h = (h * 0x100000001B3 + p) & whole
            h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & whole
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB & whole
            out.append((h ^ (h >> 31)) % language.FEATURES)
    return out


def plain_bayes(train, texts):
    """(label, posterior) of each text by counting in dictionaries and adding logarithms."""
    counts, docs = {}, Counter()
    for text, label in train:
        if label is not None:
            docs[label] += 1
            counts.setdefault(label, Counter()).update(plain_features(text))
    found = []
    for text in texts:
        features = plain_features(text)
        if not features or not docs:
            found.append(("und", 0.0))
            continue
        logs = {}
        for label in sorted(docs):
            below = sum(counts[label].values()) + language.SMOOTHING * language.FEATURES
            logs[label] = math.log(docs[label] / docs.total()) + sum(math.log((counts[label][f] + language.SMOOTHING) / below) for f in features)
        best = max(logs, key=logs.get)
        found.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return found


def test_language_equals_plain_naive_bayes(spark):
    pick = random.Random(4)
    words = {"en": "the cat and dog İx straße", "de": "der und über katze hund", "fr": "le chat été où the", None: "no label"}
    rows = [(" ".join(pick.choices(words[k].split(), k=pick.randrange(0, 9))) + pick.choice(["", "!", " 12", "\n"]), k) for k in [*words] * 12]
    rows += [(None, "en"), ("", "fr"), ("12 34", "de"), (rows[0][0], rows[0][1])]
    train = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    asked = [t for t in TEXTS if len(t or "") < 10_000] + [t for t, _ in rows] + ["the über", "chat dog", "x"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(2)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, language.fit(train)).collect()}
    for i, (label, score) in enumerate(plain_bayes(rows, asked)):
        assert found[i][0] == label and found[i][1] == pytest.approx(score, rel=1e-3), repr(asked[i])


def test_too_many_labels_are_refused_before_counting(spark):
    train = spark.range(300).select(F.lit("a text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="labels"):
        language.fit(train)
    assert len(language.fit(train.limit(255))[0]) == 255


# --- repetition ---------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(size):
        runs = [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)]
        return {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(size)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside(3))} | {
                f"dup_coverage_{n}": sum(len(ws[i]) for i in inside(n)) / max(1, sum(map(len, ws))) for n in repetition.LENGTHS}


def test_repetition_equals_plain_counting(docs, empty):
    found, n = by_id(repetition.repetition_rules(docs))
    assert n == len(TEXTS) + 1 and repetition.repetition_rules(empty).collect() == []
    for i, text in enumerate(TEXTS):
        if i != 4 and len(text or "") < 10_000:
            want = plain_counts(text)
            assert {k: found[i][k] for k in want} == pytest.approx(want), repr(text)
            assert found[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
    assert found[18]["base_failed"] and not found[18]["kept"]


def test_clean_text_is_kept_and_symbols_are_not(spark):
    pick = random.Random(2)
    word = lambda: "".join(pick.choices("abcdefghij", k=6))
    clean, marked = " ".join(word() for _ in range(200)), " ".join(word() + "***" for _ in range(200))
    lines = "\n".join([" ".join(word() for _ in range(10)) for _ in range(10)] * 4)
    rows = spark.createDataFrame([(1, clean), (2, marked), (3, lines)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in repetition.repetition_rules(rows).collect()} == {1: True, 2: False, 3: False}


def test_repetition_below_half_is_rejected(spark):
    pick = random.Random(5)
    some = lambda n: [f"{pick.randrange(10**6):06d}" for _ in range(n)]
    five, eight, line = some(5), some(40), " ".join(some(20))
    texts = {
        1: " ".join(x for _ in range(7) for x in [*five, *some(9)]),  # 35 of 98 words in runs of five, none of eight
        2: " ".join([*eight, *some(58), *eight, *some(135)]),  # 80 of 273 words in runs of eight
        3: "\n".join([line, *[" ".join(some(20)) for _ in range(8)], line, line]),  # 40 of 220 words in lines seen before
        4: " ".join([*eight[:20], *some(150), *eight[:20], *some(100)]),  # 40 of 290 words
        5: " ".join([*eight, *some(150), *eight, *some(100)]),  # 80 of 330 words
    }
    found, _ = by_id(repetition.repetition_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert not any(found[i]["base_failed"] for i in texts)
    assert found[1]["dup_coverage_5"] == pytest.approx(35 / 98) and found[1]["dup_coverage_8"] == 0
    assert found[2]["dup_coverage_8"] == pytest.approx(80 / 273) and found[2]["dup_coverage_5"] < 0.30
    assert found[3]["dup_line_coverage"] == pytest.approx(40 / 220) and found[3]["dup_coverage_8"] < 0.28
    assert {i: found[i]["kept"] for i in texts} == {1: False, 2: False, 3: False, 4: True, 5: False}


# --- lines --------------------------------------------------------------------------


def test_lines_are_judged_within_their_site(spark):
    rows = [(i, "a", f"menu\nown {i}\n menu \n") for i in range(20)] + [(100 + i, "b", f"own {i}\n" + ("menu\n" if i < 2 else "")) for i in range(40)]
    rows += [(200, None, "menu"), (201, "a", None), (202, "a", ""), (203, "c", "menu\nmenu"), (204, "a", "menu"), (204, "a", "menu")]
    table = spark.createDataFrame([(*r, "k", 7) for r in rows], "doc_id long, source string, text string, `_host` string, `n_lines` int").repartition(4)
    found = line_dedup.drop_boilerplate(table)
    assert found.columns == ["doc_id", "source", "text", "_host", "n_lines", "n_dropped"]
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert got[3] == [("own 3\n", 4, 2)]
    assert got[100] == [("own 0\nmenu\n", 3, 0)]  # two pages of forty
    assert got[200] == [("menu", 1, 0)] and got[201] == [(None, 0, 0)] and got[202] == [("", 1, 0)]
    assert got[203] == [("menu\nmenu", 2, 0)] and got[204] == [("", 1, 1)] * 2
    assert line_dedup.drop_boilerplate(table.limit(0)).collect() == []


def test_large_lists_are_joined_by_salt(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"h{i % 3}", f"top\nline {i}") for i in range(60)], "doc_id long, source string, text string")
    want = sorted(map(tuple, line_dedup.drop_boilerplate(rows).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    found = line_dedup.drop_boilerplate(rows)
    assert sorted(map(tuple, found.collect())) == want and all(t[2].startswith("line") for t in want)


def test_line_dedup_runs_no_python(spark):
    rows = spark.createDataFrame([(1, "h", "a\nb")], "doc_id long, source string, text string")
    plan = line_dedup.drop_boilerplate(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_repetition_alone_rejects_a_text(spark):
    """A third of the words in long repeated runs passes the base's rule and fails the limits."""
    pick = random.Random(12)
    word = lambda: "".join(pick.choices("abcdefghijklmnop", k=6))
    run = [word() for _ in range(18)]
    texts = [[word() for _ in range(30)] + run + [word() for _ in range(30)] + run + [word() for _ in range(10)], [word() for _ in range(100)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bad, good = repetition.repetition_rules(docs).orderBy("doc_id").collect()
    assert not bad["base_failed"] and 0.3 < bad["dup_coverage_8"] < 0.4 and not bad["kept"]
    assert not good["base_failed"] and good["kept"] and good["dup_coverage_2"] == 0
