"""The pipeline's stages on odd rows, on no rows, and one after the other."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docflow.llm.marks import with_mark

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, stats double, `_id` string, n_dropped int, score string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick, path = random.Random(4), tmp_path_factory.mktemp("tables")
    word = lambda: "".join(pick.choices("abcdefghijklmnop", k=pick.randrange(2, 8)))
    rows, labels = [], []
    for i in range(240):
        ws = [word() for _ in range(pick.randrange(20, 90))]
        bad = i % 4 == 0
        text = " ".join(w + "***" if bad else w for w in ws) + "\nshared line of the site"
        rows.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, int(not bad)))
    rows += [(300, rows[1][1], "en", "s1"), (300, rows[1][1], "en", "s1"), (301, rows[1][1] + " more", "en", "s1"), (None, "a clean text without an id", None, None),
             (302, None, "en", "s1"), (303, "", "en", None), (304, "word " * 50_000, "en", "s2")]
    table = spark.createDataFrame([(*r, len(r[1] or ""), "r", 1, 0.5, "i", 3, "s") for r in rows], SCHEMA)
    table.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (9999, 0)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = corpus_pipeline.staged(out, "test")
        kept[name] = docs.collect()
    ids = [r["doc_id"] for r in kept["quality classifier"]]
    assert not any(i is not None and i < 240 and i % 4 == 0 for i in ids)
    assert {i for i in range(240) if i % 4} <= set(ids)
    ruled = {r["doc_id"] for r in kept["quality rules"]}
    assert {i for i in range(240) if i % 4} <= ruled and not ruled & {302, 303, 304} and None in ruled
    lines = {r["doc_id"]: r for r in kept["line dedup"]}
    assert "shared line" not in lines[1]["text"] and lines[1]["n_chars"] == len(lines[1]["text"]) and lines[1]["n_dropped"] == 3
    assert len(kept["line dedup"]) == len(kept["quality rules"])
    left = [r["doc_id"] for r in kept["near dedup"]]
    assert len(left) == len(set(left)) and 1 in left and 300 not in left and None in left
    pieces = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in pieces} == set(left) and all(r["n"] == r["t"] for r in pieces)


def test_stages_on_no_rows(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []


def test_one_id_with_two_texts_keeps_both(spark):
    rows = [(1, "one two three four five six seven eight"), (1, "red orange yellow green blue indigo violet white"), (1, "red orange yellow green blue indigo violet white"),
            (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, "alpha beta gamma delta epsilon zeta eta theta"), (None, "alpha beta gamma delta epsilon zeta eta theta")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.near_deduplication(spark, docs, "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"][:3]) for r in kept) == [(0, "alp"), (1, "one"), (1, "red"), (2, "alp")]


def test_near_deduplication_shuffles_no_kept_text(spark, capsys):
    rows = [(i, " ".join(f"w{i * 7 + k}x{k}" for k in range(6))) for i in range(3000)]
    rows += [(9000 + i, rows[i][1]) for i in range(20)] + [(9100, "one two three four five six"), (9100, "six five four three two one"), (9100, "one two three four five six"), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "s", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars int")
    whole = sorted([(i, t) for i, t in rows[:3000]] + [(9100, "one two three four five six"), (9100, "six five four three two one"), (-1, rows[0][1])])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("4k", "-1"):  # the list of all kept ids is longer than the first, and nothing is sent under the second
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            out = corpus_pipeline.near_deduplication(spark, docs, "")
            out.explain()
            assert ("SortMergeJoin" in capsys.readouterr().out) == (limit == "-1")
            assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in out.collect()) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_marks_miss_no_id(spark):
    rows = spark.range(-10, 20_000).unionByName(spark.createDataFrame([(None,)], "id long"))
    for listed in ([], [None, -5], [None, *range(0, 25_000, 7)], list(range(-10, 20_000))):
        ids = spark.createDataFrame([(i,) for i in listed], "_id long")
        found = {r["id"]: r["maybe"] for r in with_mark(rows, "id", ids).collect()}
        assert len(found) == 20_011 and not found[None]
        there = {i for i in listed if i in found and i is not None}
        marked = {i for i, m in found.items() if m}
        assert there <= marked and len(marked - there) < 0.05 * len(found)
