"""Raw documents to packed training sequences, in five stages.

Every stage reads what the one before kept. Its parameters are those of the operators' modules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import line_dedup, near_duplicates, packing, repetition, rules
from docflow.llm.catalog import share_of
from docflow.llm.marks import with_mark
from docflow.llm.staging import staged


def _whole(docs: DataFrame, *names) -> DataFrame:
    """Each row as one column ``row`` beside the named ones, so that no further column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones at hand, does not reject.

    A fifth of the labels, by the id's checksum, is left for measuring.

    Repeated rows are judged alike; rows with a null id or text are judged as any other. Without labels
    nothing is known of quality and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged = staged(rules.with_statistics(_whole(docs, "doc_id", "text"), keep=("row", "doc_id")), "judged")
    score = rules.score_column(rules.learn(judged, labels, "quality", share_of() != 0))
    return judged.where(score >= 0.3).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word and without too much repetition; brevity alone is no fault here."""
    judged = repetition.repetition_rules(_whole(docs, "text"), keep=("row",), min_words=1)
    return judged.where("kept").select("row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text."""
    found = line_dedup.drop_boilerplate(_whole(docs, "source", "text"))
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows that repeat an id and its text leave one row (that with the smallest hash over all columns); rows that share
    an id and differ in text all stay if the id does. Rows with a null id are in no group and stay.
    """
    found = near_duplicates.near_duplicates(docs)
    kept = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count_if("kept").alias("n"))
    # Most ids keep one row. The others are the shorter list; only rows that may be in it are joined, so that few texts are shuffled.
    others = staged(kept.where("n != 1"), "others")
    repeated = staged(others.where("n > 1"), "repeated")
    rows = with_mark(_whole(docs, F.col("doc_id").alias("id")), "id", others.select("_id"))
    maybe = rows.where("maybe").select("row", "id")
    once = rows.where("NOT maybe").select("row").unionByName(maybe.join(others, F.col("id") == F.col("_id"), "left_anti").select("row"))
    again = maybe.join(repeated, F.col("id") == F.col("_id"), "left_semi")
    text = F.col("row.text")
    one = again.groupBy("id", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), text.isNull()).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(one.select("row")).select("row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids; the last stage."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("packing", sequence_packing),
]

#: The classifier's training and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
