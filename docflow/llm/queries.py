"""One query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, language, line_dedup, near_duplicates, near_vectors, packing, piece_lattice, ppm, prefix_trie, repetition, rules, warc
from .catalog import ORACLE, QUERIES, query, share_of, table

__all__ = ["ORACLE", "QUERIES"]


@query("op1_piece_lattice")
def op1(spark, sf):
    """Four best segmentations of every text: ids, decoded text and score of each."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return piece_lattice.n_best_digests(docs, model, 4)


@query("op2_near_duplicates")
def op2(spark, sf):
    return near_duplicates.near_duplicates(table(spark, sf, "documents"), size=3, similarity=0.85)


@query("op3_language")
def op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.coalesce(share_of() == 0, F.lit(False)).alias("held_out"))
    model = language.fit(docs.where((share_of() != 0) & F.col("lang").isNotNull()))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


@query("op4_ppm")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce(share_of() == 1, F.lit(False)).alias("held_out"))
    return ppm.score(docs.withColumn("learns", ~F.col("held_out")), "learns", keep=("doc_id", "held_out"))


@query("op5_rules")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = rules.classify(docs, table(spark, sf, "labels"), share_of() != 0)
    return scored.select("doc_id", F.coalesce(share_of() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


OP6_SQL = """
WITH digests AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM digests WINDOW same AS (PARTITION BY body)
"""


@query("op6_warc", OP6_SQL)
def op6(spark, sf):
    """All pages written, then all records read back by the index."""
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_near_vectors")
def op7(spark, sf):
    return near_vectors.near_vectors(table(spark, sf, "embeddings"))


def _op8_sql() -> str:
    """Word windows of three lengths, the words and characters that repeated ones cover, and the verdict."""
    def covered(size):
        run = " || chr(10) || ".join(f"words[i + {k}]" for k in range(size))
        inside = ", ".join(f"i + {k}" for k in range(size))
        return f"""
windows_{size} AS (
  SELECT row_no, i, {run} AS run FROM (SELECT row_no, words, unnest(range(1, len(words) - {size - 2})) AS i FROM tokens)),
twice_{size} AS (
  SELECT DISTINCT row_no, unnest([{inside}]) AS j
  FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, run) AS n FROM windows_{size}) WHERE n > 1),
covered_{size} AS (
  SELECT row_no, count(*) AS n, sum(length(words[j])) AS chars FROM twice_{size} JOIN tokens USING (row_no) GROUP BY row_no)"""

    windows = ",".join(covered(n) for n in repetition.LENGTHS)
    share = "CASE WHEN word_chars > 0 THEN CAST({} AS DOUBLE) / word_chars ELSE 0.0 END"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT row_no, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM docs),
lines AS (
  SELECT row_no, line, count(*) AS n FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
repeated_lines AS (
  SELECT row_no, sum(n - 1) AS n, sum((n - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars
  FROM lines GROUP BY row_no),{windows},
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(l.chars, 0) AS line_chars, coalesce(c2.chars, 0) AS chars_2, coalesce(c3.chars, 0) AS chars_3,
         coalesce(c5.chars, 0) AS chars_5, coalesce(c8.chars, 0) AS chars_8
  FROM tokens t LEFT JOIN repeated_lines l USING (row_no) LEFT JOIN covered_2 c2 USING (row_no) LEFT JOIN covered_3 c3 USING (row_no)
  LEFT JOIN covered_5 c5 USING (row_no) LEFT JOIN covered_8 c8 USING (row_no)),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         {share.format("line_chars")} AS dup_line_coverage, {", ".join(f"{share.format(f'chars_{n}')} AS dup_coverage_{n}" for n in repetition.LENGTHS)},
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counted)
SELECT *, NOT base_failed AND dup_line_coverage <= {repetition.LINE_LIMIT}::DOUBLE AND n_symbols <= {repetition.SYMBOL_LIMIT}::DOUBLE * n_words
       {" ".join(f"AND dup_coverage_{n} <= {limit}::DOUBLE" for n, limit in repetition.RUN_LIMITS.items())} AS kept
FROM judged
"""


@query("op8_repetition", _op8_sql())
def op8(spark, sf):
    return repetition.repetition_rules(table(spark, sf, "documents"))


OP9_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, * FROM documents),
lines AS (SELECT DISTINCT row_no, source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM docs),
totals AS (SELECT source, count(*) AS pages FROM docs GROUP BY source),
often AS (
  SELECT source, line, count(*) AS n FROM lines WHERE line <> '' AND source IS NOT NULL GROUP BY ALL
  HAVING count(*) >= {line_dedup.MIN_PAGES}),
boilerplate AS (
  SELECT source, list(line) AS bad FROM often JOIN totals USING (source) WHERE n > {line_dedup.RATIO}::DOUBLE * pages GROUP BY source),
split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines, coalesce(bad, []) AS bad FROM docs LEFT JOIN boilerplate USING (source)),
kept AS (
  SELECT doc_id, text, lines,
         list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS good
  FROM split)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(good), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(good, chr(10)) END AS text
FROM kept
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


@query("op10_packing")
def op10(spark, sf):
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM drawn),
cut AS (
  SELECT doc_id, text, CAST(len(units) AS BIGINT) AS n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(h1 % (len(units) + 1), h2 % (len(units) + 1))], '') AS prefix,
         array_to_string(units[1:greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))], '') AS until
  FROM numbers),
parts AS (
  SELECT doc_id, text, n, form, prefix, substr(until, length(prefix) + 1) AS middle, substr(text, length(until) + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark, sf):
    made = fill_in_middle.fill_in_middle(table(spark, sf, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fill_in_middle.restore()).alias("restored_sha256"))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS seq
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
marked AS (  -- crc32 of the id as text, a bit at a time
  SELECT conv_id, seq, (4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, range(8 * length(CAST(conv_id AS VARCHAR)))),
    lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INT), 1))::BIGINT ELSE 0::BIGINT END) >> 1,
      CASE WHEN (c + CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INT), 1)) ELSE 0 END) % 2 = 1
           THEN 3988292384 ELSE 0::BIGINT END))) % 4 AS h
  FROM turns),
rebuilt AS (
  SELECT m.conv_id, list_concat(coalesce(b.seq[1:h], []), m.seq[h + 1:]) AS seq
  FROM marked m LEFT JOIN turns b ON b.conv_id = m.conv_id - m.conv_id % 20),
steps AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT seq[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(len(regexp_extract_all(any_value(seq[depth].text), '[^\x20\x09-\x0D]+')), 0) * (count(*) - 1) AS saved,
         bool_and(len(seq) = depth) AS leaf, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
totals AS (
  SELECT path[1:k] AS path, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (k = depth - 1) AS n_children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1] AND p.depth = n.depth - 1
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf):
    """The trie of all conversations, rebuilt so that they share openings."""
    turns, convs = prefix_trie.with_borrowed_openings(prefix_trie.numbered_turns(table(spark, sf, "conversations")))
    return prefix_trie.prefix_trie(turns, convs).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS run
  FROM (SELECT item, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM items WHERE len(words) > 0)),
places AS (
  SELECT row_no, size, i, array_to_string(words[i:i + size - 1], ' ') AS run
  FROM (SELECT row_no, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM low, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
hits AS (SELECT row_no, p.size, i, item FROM places p JOIN windows w ON p.size = w.size AND p.run = w.run),
words_hit AS (SELECT row_no, count(DISTINCT j) AS n FROM (SELECT row_no, unnest(range(i, i + size)) AS j FROM hits) GROUP BY row_no),
named AS (SELECT row_no, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM low LEFT JOIN words_hit h USING (row_no) LEFT JOIN named i USING (row_no)
"""


@query("op12_decontamination", OP12_SQL)
def op12(spark, sf):
    found = decontamination.find_benchmark_text(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return decontamination.report(found).select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated")
