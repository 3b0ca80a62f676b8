"""Queries over files, stored results, pages, batch jobs, frames and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import batch, chat, media, pages
from ..session import scratch_dir, written
from ..sources import files, logs, results, sinks
from . import inputs as I
from .catalog import query


def text(c):
    return F.col(c).cast("string")


# --- files ------------------------------------------------------------------------


def _stored_documents(spark, sf, name):
    """The documents as text files below a folder per source."""
    path = scratch_dir(spark, name)
    d = I.table(spark, sf, "documents").select("source", F.col("text"))
    d.write.partitionBy("source").text(path)
    return path


@query("scan_folder", """
SELECT true AS from_one, true AS without_gaps, true AS by_name, true AS all_bytes FROM (SELECT count(*) AS n FROM documents) WHERE n > 0""")
def scan_folder(spark, sf):
    """Files of a folder written from the documents, numbered by name; the sizes add up."""
    path = scratch_dir(spark, "scan_folder")
    d = I.table(spark, sf, "documents")
    d.select("text").write.text(path)
    listed = files.scan_folder(spark, path, ("*.txt",))
    total = d.agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    seen = listed.agg(
        F.min("page_no").alias("lo"), F.max("page_no").alias("hi"), F.count("*").alias("n"),
        F.min_by("name", "page_no").alias("first"), F.min("name").alias("least"), F.sum("length").alias("length"))
    return seen.select(
        (F.col("lo") == 1).alias("from_one"), (F.col("hi") == F.col("n")).alias("without_gaps"),
        (F.col("first") == F.col("least")).alias("by_name"), (F.col("length") == total.scalar()).alias("all_bytes"))


_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("table_files", " UNION ALL ".join(f"SELECT '{n}.parquet' AS name, CAST({i} AS BIGINT) AS page_no" for i, n in enumerate(_TABLES, 1)))
def table_files(spark, sf):
    """The files of the tables' own folder, numbered by name."""
    return files.scan_folder(spark, sf, ("*.parquet",)).select("name", F.col("page_no").cast("bigint").alias("page_no"))


@query("list_keys", "SELECT DISTINCT source AS folder FROM documents")
def list_keys(spark, sf):
    path = _stored_documents(spark, sf, "list_keys")
    keys = files.list_keys(spark, path, "source=", as_folder=False)
    return keys.select(F.regexp_extract("key", "^source=([^/]+)/", 1).alias("folder")).distinct()


@query("load_blobs", """
SELECT source AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source""")
def load_blobs(spark, sf):
    path = _stored_documents(spark, sf, "load_blobs")
    keys = files.list_keys(spark, path)
    loaded = files.load_blobs(keys, files.blobs(spark, path))
    folder = F.regexp_extract("key", "^source=([^/]+)/", 1).alias("folder")
    return loaded.where("exists").groupBy(folder).agg(F.sum(F.octet_length("content")).alias("bytes"))


@query("join_sidecar", """
SELECT lang || '/' || d.doc_id || '.txt' AS key, CASE WHEN l.doc_id IS NOT NULL THEN source END AS source,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(n_chars AS VARCHAR) END AS n_chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def join_sidecar(spark, sf):
    """Labelled documents have a sidecar."""
    d = I.table(spark, sf, "documents")
    key = F.concat("lang", F.lit("/"), text("doc_id"), F.lit(".txt"))
    data = d.select(key.alias("key"), F.col("text").cast("binary").alias("content"))
    meta = d.join(I.table(spark, sf, "labels"), "doc_id", "left_semi").select(
        F.concat(key, F.lit(".meta")).alias("key"),
        F.to_json(F.struct("source", text("n_chars").alias("n_chars"))).cast("binary").alias("content"))
    joined = files.join_sidecar(data.unionByName(meta))
    at = lambda name: F.try_element_at("metadata", F.lit(name)).alias(name)
    return joined.select("key", at("source"), at("n_chars"))


@query("save_blobs", "SELECT CAST(doc_id AS VARCHAR) AS key, lang, octet_length(encode(text)) AS bytes, source FROM documents")
def save_blobs(spark, sf):
    path = scratch_dir(spark, "save_blobs")
    d = I.table(spark, sf, "documents")
    rows = d.select(text("doc_id").alias("key"), F.col("text").cast("binary").alias("content"),
                    F.create_map(F.lit("source"), "source").alias("metadata"), "lang")
    sinks.save_blobs(rows, path, partition="lang")
    back = spark.read.parquet(path)
    return back.select("key", "lang", F.octet_length("content").cast("bigint").alias("bytes"), F.col("metadata")["source"].alias("source"))


@query("filter_uploads", """
SELECT lang || '/' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'unsupported' END AS kind,
       CASE doc_id % 5 WHEN 0 THEN n_chars * 1000 <= 20971520 WHEN 1 THEN n_chars * 1000 <= 20971520 WHEN 2 THEN n_chars * 1000 <= 104857600 ELSE false END AS accepted
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def filter_uploads(spark, sf):
    """Labelled documents stand for paths without a file."""
    d = I.table(spark, sf, "documents")
    ends = F.get(F.array(*map(F.lit, (".PDF", ".jpeg", ".mp4", ".docx", ""))), (F.col("doc_id") % 5).cast("int"))
    name = F.concat("lang", F.lit("/"), text("doc_id"))
    asked = d.select(F.concat(name, ends).alias("path")).union(d.select(F.lit("")))
    there = d.join(I.table(spark, sf, "labels"), "doc_id", "left_anti").select(F.concat(name, ends).alias("path"), (F.col("n_chars") * 1000).alias("length"))
    kept = files.filter_uploads(asked, there)
    return kept.select(F.regexp_replace("path", r"\.\w+$", "").alias("path"), "kind", "accepted")


@query("read_log_lines", """
SELECT event_id, event_type AS message, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, json_extract_string(props, '$.k') AS k, event_id % 10 = 0 AS corrupt
FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 10 = 0""")
def read_log_lines(spark, sf):
    path = scratch_dir(spark, "logs")
    e = I.table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    record = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"), level.alias("level"),
        F.lit("api").alias("logger"), F.col("event_type").alias("message"), F.lit("m").alias("module"), F.lit("f").alias("function"),
        F.lit(7).alias("line"), "event_id", F.get_json_object("props", "$.k").alias("k"))
    line = F.to_json(record)
    e.select(F.when(F.col("event_id") % 10 == 0, F.concat(line, F.lit(" cut"))).otherwise(line).alias("value")).write.text(path)
    read = logs.read_log_lines(spark, path)
    extra = lambda name: F.try_element_at("extra", F.lit(name))
    return read.select(
        extra("event_id").cast("bigint").alias("event_id"), "message", "level",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), extra("k").alias("k"), F.col("corrupt").isNotNull().alias("corrupt"))


# --- exports ----------------------------------------------------------------------


@query("export_json", """
SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CAST(length(text) AS INTEGER) AS n FROM documents""")
def export_json(spark, sf):
    path = scratch_dir(spark, "export_json")
    d = I.table(spark, sf, "documents")
    sinks.export_json(d.select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"), "text"), path)
    back = spark.read.schema("doc_id bigint, lang string, source string, text string").json(path)
    return back.select("doc_id", "lang", "source", F.length("text").alias("n"))


@query("export_csv", """
SELECT doc_id, '{"lang":"' || lang || '","n":' || n_chars || '}' AS info, CAST(length(text) AS INTEGER) AS n FROM documents""")
def export_csv(spark, sf):
    path = scratch_dir(spark, "export_csv")
    d = I.table(spark, sf, "documents")
    rows = d.select("doc_id", "text", F.struct("lang", F.col("n_chars").alias("n")).alias("info"), "source")
    sinks.export_csv(rows, path, ["doc_id", "info", "missing", "text"])
    back = spark.read.schema("doc_id bigint, info string, missing string, text string").csv(
        path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    return back.select("doc_id", "info", F.length("text").alias("n"))


@query("export_first_list", """
SELECT CAST(doc_id AS VARCHAR) AS word, n AS place FROM documents, (VALUES (0), (1)) AS v(n)""")
def export_first_list(spark, sf):
    d = I.table(spark, sf, "documents")
    item = lambda n: F.struct(text("doc_id").alias("word"), F.lit(n).alias("place"))
    return sinks.first_list(d.select("lang", F.array(item(0), item(1)).alias("items")))


# --- stored results -----------------------------------------------------------------


def _results(spark, sf):
    """Results as they would be stored, ids and times taken from the orders."""
    o = I.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    task = F.get(F.array(*map(F.lit, dims.TASKS)), (k % 8).cast("int"))
    return o.select(
        F.concat(F.lit("r-"), k.cast("string")).alias("result_id"), F.concat(F.lit("d-"), text("o_custkey")).alias("document_id"),
        task.alias("task_type"), F.to_json(F.struct("o_orderstatus")).alias("result"), F.lit(None).cast("string").alias("metadata"),
        F.col("o_orderdate").alias("created_at"))


_TASK_OF = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(dims.TASKS)) + " END"


@query("append_results", f"""
SELECT {_TASK_OF} AS task_type, count(*) AS n, count(*) AS ids, true AS stamped FROM orders GROUP BY 1""")
def append_results(spark, sf):
    path = scratch_dir(spark, "results")
    results.append_results(_results(spark, sf).drop("result_id", "created_at"), path)
    back = results.read_results(spark, path)
    return back.groupBy("task_type").agg(
        F.count("*").alias("n"), F.count_distinct("result_id").alias("ids"),
        F.every(F.col("created_at").isNotNull()).alias("stamped"))


@query("get_result", f"SELECT 'd-' || o_custkey AS document_id, {_TASK_OF} AS task_type FROM orders WHERE o_orderkey = 77")
def get_result(spark, sf):
    return results.get_result(_results(spark, sf), "r-77").select("document_id", "task_type")


@query("query_results", """
SELECT 'r-' || o_orderkey AS result_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE o_orderkey % 8 = 2 AND o_orderdate >= '1995-03-01' AND o_orderdate <= '1997-06-30'
ORDER BY o_orderdate DESC, 'r-' || o_orderkey DESC LIMIT 100""")
def query_results(spark, sf):
    found = results.query_results(_results(spark, sf), 100, "table", "1995-03-01", "1997-06-30")
    return found.select("result_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


# --- pages ------------------------------------------------------------------------


@query("merge_concatenate", r"""
SELECT conv_id AS doc_id, 0 AS part_no, string_agg('--- Page ' || (turn + 1) || E' ---\n\n' || text, E'\n\n' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def merge_concatenate(spark, sf):
    return pages.merge_concatenate(I.pages(spark, sf), 1000).select("doc_id", "part_no", "text")


@query("merge_plain", r"""
SELECT conv_id AS doc_id, CAST(turn // 3 AS INTEGER) AS part_no, string_agg(text, E'\n\n' ORDER BY turn) AS text, count(*) AS pages_in_part
FROM conversations GROUP BY conv_id, turn // 3""")
def merge_plain(spark, sf):
    """In parts of three pages, to show how long documents come out."""
    return pages.merge_plain(I.pages(spark, sf), pages_per_part=3).select("doc_id", "part_no", "text", "pages_in_part")


@query("merge_structured", """
SELECT conv_id AS doc_id, 'role' AS key, CAST(turn + 1 AS INTEGER) AS page_no, 0 AS pos, '"' || role || '"' AS value FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, 'sizes', CAST(turn + 1 AS INTEGER), 0, CAST(length(text) AS VARCHAR) FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, 'sizes', CAST(turn + 1 AS INTEGER), 1, CAST(turn AS VARCHAR) FROM conversations WHERE role <> 'system'""")
def merge_structured(spark, sf):
    return pages.merge_structured(I.pages(spark, sf))


@query("merged_lists", """
SELECT conv_id AS doc_id, 'sizes' AS key, string_agg(length(text) || ',' || turn, ',' ORDER BY turn) AS list FROM conversations WHERE role <> 'system' GROUP BY conv_id
UNION ALL SELECT conv_id, 'role', string_agg('"' || role || '"', ',' ORDER BY turn) FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def merged_lists(spark, sf):
    lists = pages.merged_lists(pages.merge_structured(I.pages(spark, sf)), 1000)
    return lists.select("doc_id", "key", F.array_join("values", ",").alias("list"))


@query("page_data", """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, '"' || role || '"' AS role,
       '[' || length(text) || ',' || turn || ']' AS sizes
FROM conversations WHERE role <> 'system'""")
def page_data(spark, sf):
    return pages.page_data(I.pages(spark, sf)).select("doc_id", "page", F.col("data.role").alias("role"), F.col("data.sizes").alias("sizes"))


@query("page_totals", "SELECT conv_id AS doc_id, count(*) AS total_pages, 'concatenate' AS merge_strategy FROM conversations GROUP BY conv_id")
def page_totals(spark, sf):
    return pages.page_totals(I.pages(spark, sf))


@query("document_groups", """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no,
       CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS group_no FROM conversations""")
def document_groups(spark, sf):
    """Every user turn starts a document; buckets of two pages."""
    starts = F.coalesce(F.element_at("data", F.lit("role")), F.lit("")) == '"user"'
    grouped = pages.document_groups(I.pages(spark, sf), "doc_id", starts, pages_per_task=2)
    return grouped.select("doc_id", "page_no", "group_no")


# --- batch ------------------------------------------------------------------------


def count_words():
    """A handler: words of a text, an error for texts with many symbols."""

    def handle(item):
        if "###" in item["text"]:
            raise ValueError("symbols in " + str(item["item_id"]))
        return {"words": len(item["text"].split())}

    return handle


@query("run_batch", r"""
SELECT doc_id AS item_id, CASE WHEN contains(text, '###') THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN contains(text, '###') THEN 'symbols in ' || doc_id END AS error,
       CASE WHEN NOT contains(text, '###') THEN '{"words": ' || CASE WHEN trim(text, E' \n\t\r') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, E' \n\t\r'), '\s+')) END || '}' END AS result
FROM documents""")
def run_batch(spark, sf):
    items = I.spread(I.table(spark, sf, "documents")).select(F.col("source").alias("job_id"), F.col("doc_id").alias("item_id"), "text")
    done = batch.run_batch(items, count_words, keys=("job_id", "item_id"))
    return done.select("item_id", "status", "error", "result")


def _size(item):
    return {"bytes": item["length"]}


@query("folder_job", """
SELECT 'job-1' AS job_id, 'completed' AS status, CAST(100 AS DOUBLE) AS progress, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
FROM documents HAVING count(*) > 0""")
def folder_job(spark, sf):
    """A job made from a folder: its files become items, which are dealt out by size and worked on."""
    path = scratch_dir(spark, "folder-job")
    I.spread(I.table(spark, sf, "documents")).select("text").write.text(path)
    found = files.batch_files(spark, path, ("*.txt",))
    items = batch.create_items(found, "job-1", "ocr").join(found.select(F.col("path").alias("file_path"), "length"), "file_path")
    done = written(batch.run_batch(items, lambda: _size, cost="length"), "folder-job-items")
    state = batch.job_progress(done).join(batch.job_status(done), "job_id")
    sizes = done.groupBy("job_id").agg(F.sum(F.get_json_object("result", "$.bytes").cast("bigint")).alias("bytes"))
    return state.join(sizes, "job_id").select("job_id", "status", "progress", "bytes")


ITEMS = """
items AS (
  SELECT source AS job_id, CAST(d.doc_id AS VARCHAR) AS item_id, lang || '/' || d.doc_id || '.txt' AS file_path,
         CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN quality = 1 THEN 'ok ' || d.doc_id END AS result, CASE WHEN quality = 0 THEN 'low quality' END AS error,
         CAST(n_chars % 5000 AS INTEGER) AS processing_time_ms
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
progress AS (
  SELECT job_id, count(*) AS total_items, count(*) FILTER (status <> 'pending') AS processed_items, count(*) FILTER (status = 'failed') AS failed_items
  FROM items GROUP BY job_id)
"""


@query("job_progress", f"""
WITH {ITEMS} SELECT *, CAST(processed_items AS DOUBLE) / total_items * 100 AS progress FROM progress
UNION ALL SELECT 'empty-' || r_name, 0, 0, 0, 0.0 FROM region""")
def job_progress(spark, sf):
    items = I.batch_items(spark, sf)
    empty = I.table(spark, sf, "region").select(F.concat(F.lit("empty-"), "r_name").alias("job_id"))
    return batch.job_progress(items, items.select("job_id").distinct().union(empty))


@query("job_status", f"""
WITH {ITEMS}, one AS (SELECT job_id || '/' || (CAST(item_id AS BIGINT) % 40) AS job_id, status FROM items)
SELECT job_id, CASE WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'completed' END AS status FROM one GROUP BY job_id""")
def job_status(spark, sf):
    part = F.concat("job_id", F.lit("/"), (F.col("item_id").cast("bigint") % 40).cast("string"))
    return batch.job_status(I.batch_items(spark, sf).withColumn("job_id", part))


def _jobs(spark, sf):
    states = F.array(*map(F.lit, dims.JOB_STATES))
    return I.table(spark, sf, "orders").select(
        text("o_orderkey").alias("job_id"), F.get(states, (F.col("o_orderkey") % 5).cast("int")).alias("status"))


_STATE = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(dims.JOB_STATES)) + " END"


@query("jobs_by_status", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'failed' AS status FROM orders WHERE o_orderkey % 5 = 3")
def jobs_by_status(spark, sf):
    return batch.jobs_by_status(_jobs(spark, sf), "failed")


@query("cancel_jobs", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, hit AS changed
FROM (SELECT o_orderkey, {_STATE} AS status, o_orderkey % 5 = 0 AND o_orderkey IN (SELECT c_custkey * 3 FROM customer) AS hit FROM orders)""")
def cancel_jobs(spark, sf):
    ids = I.table(spark, sf, "customer").select((F.col("c_custkey") * 3).cast("string").alias("job_id"))
    return batch.cancel_jobs(_jobs(spark, sf), ids)


@query("job_results", f"""
WITH {ITEMS} SELECT item_id, file_path, status, result, error, processing_time_ms FROM items WHERE job_id = (SELECT min(source) FROM documents)""")
def job_results(spark, sf):
    items = I.batch_items(spark, sf)
    first = I.table(spark, sf, "documents").agg(F.min("source")).scalar()
    return batch.job_results(items, first)


# --- frames -----------------------------------------------------------------------

SAMPLED = """
numbered AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events),
wanted AS (
  SELECT DISTINCT user_id, i AS sample_no, CASE WHEN i = 15 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(15 AS DOUBLE))) AS BIGINT) END AS place
  FROM numbered, unnest(range(16)) AS u(i)),
sampled AS (SELECT w.user_id, w.sample_no, n.event_id, w.place FROM wanted w JOIN numbered n ON n.user_id = w.user_id AND n.place = w.place)
"""


def _sampled(spark, sf):
    e = I.table(spark, sf, "events").select("user_id", "event_id", "ts")
    return media.sample_evenly(e, "user_id", ["ts", "event_id"], F.to_date("ts"), 16)


@query("sample_evenly", f"WITH {SAMPLED} SELECT user_id, CAST(sample_no AS INTEGER) AS sample_no, event_id, place AS frame_index FROM sampled")
def sample_evenly(spark, sf):
    return _sampled(spark, sf).select("user_id", "sample_no", "event_id", "frame_index")


@query("grid_positions", f"""
WITH {SAMPLED} SELECT user_id, event_id, CAST(sample_no // 8 AS BIGINT) AS grid_row, CAST(sample_no % 8 AS BIGINT) AS grid_col,
  CAST(sample_no % 8 * 320 AS BIGINT) AS offset_x, CAST(sample_no // 8 * 180 AS BIGINT) AS offset_y FROM sampled""")
def grid_positions(spark, sf):
    frames = _sampled(spark, sf).withColumn("width", F.lit(320)).withColumn("height", F.lit(180))
    return media.grid_positions(frames).select("user_id", "event_id", "grid_row", "grid_col", "offset_x", "offset_y")


@query("video_tokens", """
SELECT source, CAST(sum(CAST(trunc((doc_id % 128) / CAST(2 AS DOUBLE) * (n_chars % 700) / CAST(28 AS DOUBLE) * 640 / CAST(28 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY source""")
def video_tokens(spark, sf):
    videos = I.table(spark, sf, "documents").select(
        "source", (F.col("doc_id") % 128).alias("frames"), (F.col("n_chars") % 700).alias("height"), F.lit(640).alias("width"))
    return media.video_tokens(videos).groupBy("source").agg(F.sum("tokens").alias("tokens"))


# --- chats ------------------------------------------------------------------------


@query("chat_histories", """
SELECT conv_id, 0 AS part_no, CAST(count(*) AS INTEGER) AS message_count, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS outline
FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def chat_histories(spark, sf):
    h = chat.chat_histories(I.chat(spark, sf), 1000)
    outline = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), " ")
    return h.select("conv_id", F.col("part_no").cast("int").alias("part_no"), "message_count", outline.alias("outline"))


@query("pair_turns", """
SELECT conv_id, turn, text AS "user", CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS assistant
FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations WHERE trim(text) <> '' AND role IN ('user', 'assistant'))
WHERE role = 'user'""")
def pair_turns(spark, sf):
    """In buckets of two turns, so that pairs cross a bucket's edge."""
    return chat.pair_turns(I.chat(spark, sf), turns_per_task=2)


def _prompt_case():
    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    modes = list(dims.CHAT_MODES)
    cases = " ".join(f"WHEN {i} THEN {lit(dims.CHAT_MODES[m])}" for i, m in enumerate(modes))
    return f"CASE conv_id % 6 {cases} ELSE {lit(dims.CHAT_MODES[dims.DEFAULT_MODE])} END"


@query("effective_system_prompt", f"""
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'be brief ' || turn ELSE {_prompt_case()} END AS system_prompt,
       CASE WHEN turn % 3 = 0 THEN '{dims.DEFAULT_QUESTION}' ELSE text END AS question FROM conversations""")
def effective_system_prompt(spark, sf):
    modes = F.array(*map(F.lit, [*dims.CHAT_MODES, "No Such Mode"]))
    asked = I.chat(spark, sf).select(
        "conv_id", "turn", F.get(modes, (F.col("conv_id") % 6).cast("int")).alias("usage_mode"),
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("  be brief "), text("turn"), F.lit("\n"))).otherwise("  ").alias("custom_system_prompt"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("message"))
    return chat.effective_system_prompt(asked, dims.chat_modes(spark)).select("conv_id", "turn", "system_prompt", "question")
