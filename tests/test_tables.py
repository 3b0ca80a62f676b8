import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docflow import dims
from docflow.operators import batch, chat, pages
from docflow.sources import files, logs, results, sinks
from docflow.streaming import jobs
from docflow.streaming.live_table import LiveTable

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# --- pages ------------------------------------------------------------------------


@pytest.fixture
def book(spark):
    rows = [("d", n, f"text {n}", {"items": f"[{n}, {n + 100}]", "kind": '"k"'} if n != 2 else None) for n in range(1, 13)]
    rows.append(("e", 1, None, {}))
    return spark.createDataFrame(rows, "doc_id string, page_no int, text string, data map<string,string>").repartition(4)


def test_merged_texts(book):
    parts = {r["doc_id"]: r["text"] for r in pages.merge_concatenate(book, 1000).collect()}
    assert parts["d"] == "\n\n".join(f"--- Page {n} ---\n\ntext {n}" for n in range(1, 13))
    assert parts["e"] == "--- Page 1 ---\n\n"
    split = pages.merge_plain(book.where("doc_id = 'd'"), pages_per_part=5).orderBy("part_no").collect()
    assert [r["pages_in_part"] for r in split] == [5, 5, 2]
    assert "\n\n".join(r["text"] for r in split) == "\n\n".join(f"text {n}" for n in range(1, 13))


def test_merged_data(book):
    rows = pages.merge_structured(book)
    lists = {(r["doc_id"], r["key"]): r["values"] for r in pages.merged_lists(rows, 1000).collect()}
    numbers = [n for n in range(1, 13) if n != 2]
    assert lists == {("d", "items"): [str(x) for n in numbers for x in (n, n + 100)], ("d", "kind"): ['"k"'] * 11}
    assert pages.page_data(book).count() == 11
    assert {r["doc_id"]: r["total_pages"] for r in pages.page_totals(book).collect()} == {"d": 12, "e": 1}


def test_document_groups(book):
    alone = pages.document_groups(book).where("doc_id = 'd'").orderBy("page_no").collect()
    assert [r["group_no"] for r in alone] == list(range(1, 13))
    starts = F.col("page_no") % 4 == 1
    grouped = pages.document_groups(book, starts=starts, pages_per_task=3).where("doc_id = 'd'").orderBy("page_no").collect()
    assert [r["group_no"] for r in grouped] == [1] * 4 + [2] * 4 + [3] * 4


# --- batch ------------------------------------------------------------------------

ITEMS = "job_id string, item_id string, status string"


def test_progress_and_status(spark):
    rows = [("half", "1", "completed"), ("half", "2", "pending"), ("bad", "3", "failed"), ("bad", "4", "failed"),
            ("mixed", "5", "failed"), ("mixed", "6", "completed")]
    items = spark.createDataFrame(rows, ITEMS)
    every = spark.createDataFrame([("half",), ("bad",), ("mixed",), ("empty",)], "job_id string")
    got = {r["job_id"]: tuple(r)[1:] for r in batch.job_progress(items, every).collect()}
    assert got == {"half": (2, 1, 0, 50.0), "bad": (2, 2, 2, 100.0), "mixed": (2, 2, 1, 100.0), "empty": (0, 0, 0, 0.0)}
    state = {r["job_id"]: r["status"] for r in batch.job_status(items, every).collect()}
    assert state == {"half": "completed", "bad": "failed", "mixed": "completed", "empty": "completed"}


def test_cancel_and_list(spark):
    listed = spark.createDataFrame([("a", "pending"), ("b", "processing"), ("c", "pending")], "job_id string, status string")
    ids = spark.createDataFrame([("a",), ("b",), ("a",), ("x",)], "job_id string")
    got = {r["job_id"]: (r["status"], r["changed"]) for r in batch.cancel_jobs(listed, ids).collect()}
    assert got == {"a": ("cancelled", True), "b": ("processing", False), "c": ("pending", False)}
    assert batch.jobs_by_status(listed, "pending").count() == 2 and batch.jobs_by_status(listed).count() == 3


def test_run_batch(spark):
    def upper():
        return lambda item: {"text": item["file_path"].upper(), "n": 10 // item["n"]}

    items = spark.createDataFrame([("j", "1", "a", 5), ("j", "2", "b", 0)], "job_id string, item_id string, file_path string, n int")
    rows = batch.run_batch(items, upper).orderBy("item_id").collect()
    assert [r["status"] for r in rows] == ["completed", "failed"]
    assert json.loads(rows[0]["result"]) == {"text": "A", "n": 2} and rows[0]["error"] is None
    assert rows[1]["result"] is None and "zero" in rows[1]["error"] and rows[1]["processing_time_ms"] >= 0
    done = batch.run_batch(items, upper)
    assert batch.job_results(done, "j").columns == ["item_id", "file_path", "status", "result", "error", "processing_time_ms"]
    assert batch.job_results(done, "none").count() == 0


# --- chats ------------------------------------------------------------------------


def test_chats(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "  "), (1, 4, "user", "c"), (1, 5, "user", "d"),
            (1, 6, "assistant", "e"), (2, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for size in (1000, 2):
        pairs = [(r["turn"], r["user"], r["assistant"]) for r in chat.pair_turns(turns, size).orderBy("turn").collect()]
        assert pairs == [(1, "a", "b"), (4, "c", ""), (5, "d", "e")]
    h = chat.chat_histories(turns, turns_per_part=3).orderBy("conv_id", "part_no").collect()
    assert [(r["conv_id"], r["part_no"], [m["content"] for m in r["messages"]]) for r in h] == [
        (1, 0, ["s", "a", "b"]), (1, 1, ["c", "d"]), (1, 2, ["e"]), (2, 0, ["x"])]
    asked = spark.createDataFrame([("OCR Reader", " ", ""), ("none", "", "q"), (None, " mine ", None)], "usage_mode string, custom_system_prompt string, message string")
    got = chat.effective_system_prompt(asked, dims.chat_modes(spark)).collect()
    assert [r["system_prompt"] for r in got] == [dims.CHAT_MODES["OCR Reader"], dims.CHAT_MODES["General Assistant"], "mine"]
    assert [r["question"] for r in got] == ["Describe this image.", "q", "Describe this image."]


# --- files ------------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    for name, content in {
        "b.png": b"bb", "a.jpg": b"a", "c.pdf": b"ccc", "notes.txt": b"n", "sub/d.png": b"dddd", "sub/deep/e.json": b"{}",
        "a.jpg.meta": b'{"owner": "x", "n": "1"}',
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.utime(tmp_path / "a.jpg", (2_000_000_000, 2_000_000_000))
    return str(tmp_path)


def test_folder_scan(spark, tree):
    by_name = [(r["page_no"], r["name"]) for r in files.scan_folder(spark, tree).orderBy("page_no").collect()]
    assert by_name == [(1, "a.jpg"), (2, "b.png")]
    by_time = [r["name"] for r in files.scan_folder(spark, tree, ("*.png", "*.jpg", "*.pdf"), "modified").orderBy("page_no").collect()]
    assert by_time[-1] == "a.jpg" and len(by_time) == 3
    assert files.batch_files(spark, tree).count() == 3
    with pytest.raises(ValueError, match="No files found"):
        files.batch_files(spark, tree, ("*.gif",))
    items = batch.create_items(files.batch_files(spark, tree), "j", "ocr")
    assert items.where("status = 'pending'").select("item_id").distinct().count() == 3


def test_keys_and_blobs(spark, tree):
    keys = lambda *a, **k: sorted(r["key"] for r in files.list_keys(spark, tree, *a, **k).collect())
    assert keys() == ["a.jpg", "b.png", "c.pdf", "notes.txt", "sub/d.png", "sub/deep/e.json"]
    assert keys("sub") == ["sub/d.png", "sub/deep/e.json"] and keys("missing") == []
    assert keys("su", as_folder=False) == ["sub/d.png", "sub/deep/e.json"] and keys("b", as_folder=False) == ["b.png"]
    stored = files.blobs(spark, tree)
    asked = spark.createDataFrame([("b.png",), ("gone",)], "key string")
    got = {r["key"]: (r["content"], r["exists"]) for r in files.load_blobs(asked, stored).collect()}
    assert got == {"b.png": (bytearray(b"bb"), True), "gone": (None, False)}
    meta = {r["key"]: r["metadata"] for r in files.join_sidecar(stored).collect()}
    assert meta["a.jpg"] == {"owner": "x", "n": "1"} and meta["b.png"] is None and len(meta) == 6


def test_uploads(spark):
    listing = spark.createDataFrame([("a.PNG", 20 * 1024 * 1024), ("b.jpg", 20 * 1024 * 1024 + 1), ("c.mp4", 10**8), ("d.doc", 1), ("e.pdf", 1)], "path string, length long")
    asked = spark.createDataFrame([("a.PNG",), ("b.jpg",), ("c.mp4",), ("d.doc",), ("e.pdf",), ("",), ("gone.png",)], "path string")
    got = {r["path"]: (r["kind"], r["accepted"]) for r in files.filter_uploads(asked, listing).collect()}
    assert got == {"a.PNG": ("image", True), "b.jpg": ("image", False), "c.mp4": ("video", True), "d.doc": ("unsupported", False), "e.pdf": ("pdf", True)}


def test_saved_blobs_replace_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "key string, content binary, metadata map<string,string>, task_type string"
    sinks.save_blobs(spark.createDataFrame([("k", b"1", {}, "ocr"), ("l", b"2", {}, "ner")], schema), path)
    sinks.save_blobs(spark.createDataFrame([("k", b"3", {"a": "b"}, "ocr")], schema), path)
    assert [(r["key"], bytes(r["content"]), r["task_type"]) for r in spark.read.parquet(path).collect()] == [("k", b"3", "ocr")]


def test_result_store(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("d1", "ocr", "{}", None), ("d2", "ner", '{"a":1}', "{}")], "document_id string, task_type string, result string, metadata string")
    results.append_results(rows, path)
    results.append_results(rows, path)
    stored = results.read_results(spark, path)
    assert stored.count() == 4 and stored.select("result_id").distinct().count() == 4
    one = stored.first()["result_id"]
    assert results.get_result(stored, one).count() == 1 and results.get_result(stored, "x").count() == 0
    made = spark.createDataFrame([(f"r{i}", "ocr" if i % 2 else "ner", at(i)) for i in range(10)], "result_id string, task_type string, created_at timestamp")
    assert [r["result_id"] for r in results.query_results(made, 3, "ocr", at(1), at(7)).collect()] == ["r7", "r5", "r3"]
    assert results.query_results(made, 100).count() == 10
    plan = results.query_results(stored, 100, "ocr")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "task_type" in plan.split("PartitionFilters")[1]


def test_log_lines(spark, tmp_path):
    (tmp_path / "log").write_text(
        '{"timestamp": "2024-01-01T10:00:00.5Z", "level": "INFO", "logger": "l", "message": "m", "module": "x", "function": "f", "line": 3, "request": "r1", "n": 5}\n'
        '{"level": "ERROR", "exception": "trace"}\nnot json\n{"a": 1} x\n')
    rows = logs.read_log_lines(spark, str(tmp_path / "log")).collect()
    assert [(r["level"], r["line"], r["extra"], r["corrupt"]) for r in rows] == [
        ("INFO", 3, {"request": "r1", "n": "5"}, None), ("ERROR", None, {}, None), (None, None, None, "not json"), (None, None, None, '{"a": 1} x')]
    assert rows[0]["ts"] == datetime(2024, 1, 1, 10, 0, 0, 500000) and rows[1]["exception"] == "trace"


# --- exports ----------------------------------------------------------------------


def read_parts(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(open(os.path.join(path, n), encoding="utf-8").read() for n in names)


def test_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x, "y"', {"k": 1}, None), (2, None, None, [1, 2])], "a int, b string, c map<string,int>, d array<int>").coalesce(1)
    sinks.export_json(df, str(tmp_path / "j"))
    assert [json.loads(line) for line in read_parts(tmp_path / "j").splitlines()] == [
        {"a": 1, "b": 'x, "y"', "c": {"k": 1}, "d": None}, {"a": 2, "b": None, "c": None, "d": [1, 2]}]
    assert json.loads(sinks.json_lines(df).first()["value"])["d"] is None
    sinks.export_csv(df, str(tmp_path / "c"), ["b", "a", "zz", "d"])
    assert read_parts(tmp_path / "c") == 'b,a,zz,d\n"x, ""y""",1,,\n,2,,"[1,2]"\n'


def test_first_list(spark, tmp_path):
    df = spark.createDataFrame([("t", [{"p": 1, "q": "a"}, {"p": 2, "q": "b"}], [9])], "t string, items array<struct<p:int,q:string>>, z array<int>").coalesce(1)
    sinks.export_first_list(df, str(tmp_path / "c"))
    assert read_parts(tmp_path / "c") == "p,q\n1,a\n2,b\n"
    assert sinks.first_list(df.select("t")).columns == ["t"]
    assert [r["value"] for r in sinks.first_list(df.select("z")).collect()] == [9]


def test_audit_text(spark, tmp_path):
    df = spark.createDataFrame([("1", at(0), "auth.login", "t", None, "a,b", "", True), ("2", at(0.5), "x", None, "u", None, "r", False)],
                               "entry_id string, ts timestamp, action string, tenant_id string, user_id string, resource_type string, resource_id string, success boolean").coalesce(1)
    sinks.export_audit(df, str(tmp_path / "c"), "csv")
    assert read_parts(tmp_path / "c") == (
        "timestamp,action,tenant_id,user_id,resource_type,resource_id,success\n"
        "2024-01-01T00:00:00,auth.login,t,,a,b,,True\n2024-01-01T00:00:00.500000,x,,u,,r,False\n")
    first = json.loads(sinks.audit_lines(df).first()["value"])
    assert first["timestamp"] == "2024-01-01T00:00:00" and first["user_id"] is None and first["success"] is True
    with pytest.raises(ValueError, match="Unknown format"):
        sinks.audit_lines(df, "xml")


def test_metric_text(spark, tmp_path):
    obs = spark.createDataFrame(
        [("c", {"a": "b"}, "counter", at(0), 1, 2.0), ("g", {}, "gauge", at(0), 2, 1.5), ("h", {"x": "y"}, "histogram", at(0), 3, 1.0),
         ("h", {"x": "y"}, "histogram", at(1), 4, 2.0)], "name string, labels map<string,string>, kind string, ts timestamp, obs_id long, value double")
    sinks.export_prometheus(obs, str(tmp_path / "p"))
    assert read_parts(tmp_path / "p").splitlines() == [
        "# TYPE c counter", 'c{a="b"} 2.0', "# TYPE g gauge", "g 1.5", "# TYPE h histogram", 'h_count{x="y"} 2', 'h_sum{x="y"} 3.0']


def test_a_huge_item_is_alone_in_its_task(spark):
    rows = [(i, f"f{i}", 1 << 30 if i == 77 else 1000 + i % 7) for i in range(10_000)] + [(10_000, None, None), (10_001, None, None)]
    items = spark.createDataFrame(rows, "item_id long, file_path string, length long").repartition(5)
    dealt = batch.spread_by_cost(items, "length", 8).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["item_id"] for r in dealt) == list(range(10_002))
    tasks = {}
    for r in dealt:
        tasks.setdefault(r["task"], []).append(r["item_id"])
    assert [77] in tasks.values() and len(tasks) >= 4
    assert max(len(t) for t in tasks.values()) < 4000
    assert batch.spread_by_cost(items.limit(0), "length", 8).collect() == []
    done = batch.run_batch(items, lambda: lambda item: {"n": item["item_id"]}, keys=("item_id",), cost="length", tasks=4)
    assert done.where("status = 'completed'").count() == 10_002


# --- streams ----------------------------------------------------------------------


def test_audit_stream_keeps_going_when_a_callback_fails(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, action string, success boolean"
    spark.createDataFrame([(at(i), "auth.login", None if i else False) for i in range(5)], schema).write.parquet(src)
    seen = []

    def fails(rows):
        raise RuntimeError("observer")

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.ingest_audit(stream, str(tmp_path / "out"), str(tmp_path / "check"), True, [fails, lambda rows: seen.append(rows.count())]).awaitTermination()

    run()
    spark.createDataFrame([(at(100000), "auth.logout", True)], schema).write.mode("append").parquet(src)
    run()
    stored = jobs.live_audit(spark, str(tmp_path / "out"))
    assert seen == [5, 1] and stored.count() == 6 and stored.select("entry_id").distinct().count() == 6
    assert [r["error"] for r in LiveTable(spark, str(tmp_path / "out-errors")).read().collect()] == ["RuntimeError: observer"] * 2
    assert stored.where("not success").count() == 1 and stored.select("day").distinct().count() == 2


def test_streams_equal_batch_jobs(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "key string, request_id long, ts timestamp"
    rows = [(f"k{i % 3}", i, at(i * 7)) for i in range(120)]
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.rate_limit_stream(stream, str(tmp_path / "r"), str(tmp_path / "rc"), 2, 60, available_now=True).awaitTermination()
    from docflow.operators import access

    want = access.rate_limit(spark.read.parquet(src), 2, 60)
    cols = ["request_id", "allowed", "remaining", "reset_at"]
    got = jobs.live_limits(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))

    usage = stream.select(F.col("key").alias("tenant_id"), "ts", F.lit(1).alias("request_count"), F.lit(2).alias("document_count"),
                          F.lit(3).alias("processing_time_ms"), F.lit(4).alias("tokens_used"))
    jobs.daily_usage_stream(usage, str(tmp_path / "u"), str(tmp_path / "uc"), available_now=True).awaitTermination()
    live = {(r["tenant_id"], str(r["day"])): r["request_count"] for r in jobs.live_usage(spark, str(tmp_path / "u")).collect()}
    assert live == {(f"k{i}", "2024-01-01"): 40 for i in range(3)}

    states = stream.select(F.col("key").alias("job_id"), (F.col("request_id") % 30).cast("string").alias("item_id"),
                           F.when(F.col("request_id") < 90, "pending").otherwise("completed").alias("status"), "ts", F.col("request_id").alias("seq"))
    jobs.job_progress_stream(states, str(tmp_path / "p"), str(tmp_path / "pc"), available_now=True).awaitTermination()
    assert {r["job_id"]: (r["total_items"], r["progress"]) for r in jobs.live_progress(spark, str(tmp_path / "p")).collect()} == {
        f"k{i}": (10, 100.0) for i in range(3)}


def test_streams_keep_late_rows(spark, tmp_path, monkeypatch):
    """Unsorted micro-batches, compacted on the way, give every request its verdict and every row its share of the sums."""
    import random

    from docflow.operators import access

    monkeypatch.setattr(jobs, "COMPACT_EVERY", 4)
    src, pick = str(tmp_path / "in"), random.Random(3)
    # Half of all requests belong to one key; two keys come in order, the others anyhow.
    rows = [(None if i % 17 == 0 else f"k{pick.randrange(5) * (i % 2)}", i, at(pick.randrange(400_000))) for i in range(6_000)]
    rows += [(f"in order {i % 2}", 10_000 + i, at(i * 100 + pick.randrange(90))) for i in range(1_300)]
    rows[6_000:] = sorted(rows[6_000:], key=lambda r: r[2])
    parts = [rows[k:6_000:13] + rows[6_000 + 100 * k : 6_100 + 100 * k] for k in range(13)]
    for part in parts:
        spark.createDataFrame(part, "key string, request_id long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, request_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    path = str(tmp_path / "r")
    jobs.rate_limit_stream(stream, path, str(tmp_path / "rc"), 3, 600, available_now=True).awaitTermination()
    cols = ["request_id", "allowed", "remaining", "reset_at"]
    want = access.rate_limit(spark.read.parquet(src), 3, 600).select(cols).collect()
    got = jobs.live_limits(spark, path).select(cols).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, want))
    # A batch that is replayed after a failure changes nothing.
    jobs.judge_batch(spark.read.schema("key string, request_id long, ts timestamp").parquet(*_files_of(tmp_path / "rc", 12)), 12, path, 3, 600)
    assert sorted(map(tuple, jobs.live_limits(spark, path).select(cols).collect())) == sorted(map(tuple, want))
    jobs.compact(jobs.verdict_table(spark, path), jobs.window_table(spark, path))
    assert jobs.window_table(spark, path).version() == 11
    assert sorted(map(tuple, jobs.live_limits(spark, path).select(cols).collect())) == sorted(map(tuple, want))
    usage = stream.select(F.col("key").alias("tenant_id"), "ts", *[F.lit(k).alias(c) for k, c in enumerate(jobs.USAGE, 1)])
    jobs.daily_usage_stream(usage, str(tmp_path / "u"), str(tmp_path / "uc"), available_now=True).awaitTermination()
    total = jobs.live_usage(spark, str(tmp_path / "u")).agg(F.sum("request_count"), F.sum("tokens_used")).first()
    assert tuple(total) == (len(rows), 4 * len(rows)) and jobs.usage_table(spark, str(tmp_path / "u")).version() == 10


def _files_of(checkpoint, batch_id):
    """The files of a micro-batch, from the stream's own log of its source."""
    import json

    lines = (checkpoint / "sources" / "0" / str(batch_id)).read_text().splitlines()[1:]
    return [json.loads(x)["path"] for x in lines]


def test_live_table_is_compacted_under_a_stream(spark, tmp_path):
    """Store, compact, store, read; a reader that has planned before keeps its rows; the number of folders is bounded."""
    path = str(tmp_path / "t")
    table = jobs.usage_table(spark, path)
    batch = lambda n: spark.createDataFrame([(f"t{n % 3}", at(n * 20_000))] * 5, "tenant_id string, ts timestamp").select(
        "tenant_id", "ts", *[F.lit(k).alias(c) for k, c in enumerate(jobs.USAGE, 1)])
    assert table.read() is None and table.compact() == -1
    for n in range(23):
        table.store(jobs.daily_usage(batch(n)), n)
        if n == 1:
            early = table.read()
        if n == 2:
            assert table.compact() == 1  # the newest batch may still be replayed
            table.store(jobs.daily_usage(batch(2)), 2)
            assert early.agg(F.sum("request_count")).first()[0] == 10
        if n % 5 == 4:
            assert table.compact() == n - 1
        folders = [len(list((tmp_path / "t" / f).glob("*=*"))) for f in ("batches", "snapshots", "versions") if (tmp_path / "t" / f).exists()]
        assert sum(folders) <= 15
    want = jobs.daily_usage(spark.createDataFrame([r for n in range(23) for r in batch(n).collect()])).collect()
    assert sorted(map(str, jobs.live_usage(spark, path).select("tenant_id", "day", *jobs.USAGE).collect())) == sorted(map(str, want))
    with pytest.raises(ValueError):
        table.rows(before=3)


def test_audit_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 3)
    src = str(tmp_path / "in")
    for n in range(8):
        spark.createDataFrame([(at(n * 9000 + i), "auth.login", None) for i in range(4)], "ts timestamp, action string, success boolean").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, action string, success boolean").option("maxFilesPerTrigger", 1).parquet(src)
    jobs.ingest_audit(stream, str(tmp_path / "out"), str(tmp_path / "check"), True).awaitTermination()
    stored = jobs.live_audit(spark, str(tmp_path / "out"))
    assert stored.count() == 32 and stored.select("entry_id").distinct().count() == 32
    assert len(list((tmp_path / "out" / "batches").glob("batch_id=*"))) < 8
