"""A sparse rule ensemble as quality classifier.

Shallow trees over text statistics give conjunctive rules (the paths from their roots); a logistic
regression with an L1 penalty keeps a few of them with weights. The result is one Spark column
expression over the statistics, so scoring is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repetition import with_counts
from .staging import staged

TREES, DEPTH, PENALTY, SEED, RUNS = 24, 3, 0.002, 7, (2, 3)


def _over(a, b) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def statistics() -> dict[str, Column]:
    """The statistics that rules speak of, over the columns of ``with_counts``; an empty text has zeros."""
    return {
        "log_words": F.log1p("n_words"), "word_length": _over("word_chars", "n_words"), "line_words": _over("n_words", "n_lines"),
        "symbols": _over("n_symbols", "word_chars"), "upper": _over("n_upper", "word_chars"), "digits": _over("n_digits", "word_chars"),
        "signs": _over("n_punct", "word_chars"), "distinct": _over("n_distinct_words", "n_words"), "top": _over("top_word", "n_words"),
        "dup_lines": _over("n_dup_lines", "n_lines"), "dup_line_chars": _over("dup_line_chars", "word_chars"),
        **{f"dup_{n}": _over(f"dup_chars_{n}", "word_chars") for n in RUNS},
    }


def with_statistics(docs: DataFrame, text="text", keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns and a struct ``stats`` for every row, one row per input row."""
    counted = with_counts(docs, text, keep, RUNS)
    return counted.select(*keep, F.struct(*[c.alias(n) for n, c in statistics().items()]).alias("stats"))


Condition = tuple[str, bool, float]


def tree_paths(node, names, path=()) -> Iterator[tuple[Condition, ...]]:
    """The conjunctions of all nodes below the root; a condition is (statistic, greater, limit)."""
    if path:
        yield path
    if node.numDescendants() == 0:
        return
    name, limit = names[node.split().featureIndex()], node.split().threshold()
    yield from tree_paths(node.leftChild(), names, (*path, (name, False, limit)))
    yield from tree_paths(node.rightChild(), names, (*path, (name, True, limit)))


def simplified(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One limit for each statistic and side, in a fixed order, so that equal rules look equal."""
    tight: dict[tuple[str, bool], float] = {}
    for name, greater, limit in path:
        held = tight.get((name, greater), limit)
        tight[name, greater] = max(held, limit) if greater else min(held, limit)
    return tuple(sorted((n, g, x) for (n, g), x in tight.items()))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, greater, limit in rule:
        value = F.col(f"stats.{name}")
        out = out & ((value > limit) if greater else (value <= limit))
    return out


def fit(train: DataFrame, label="label", trees=TREES, depth=DEPTH, penalty=PENALTY):
    """(bias, [(rule, weight)]) from rows with ``stats`` and a 0/1 ``label``; all rows are used.

    Both models are trained by Spark on the rows where they lie; the driver sees split points and
    weights only. With one class, or no rows, there are no rules and the bias is that class's.
    """
    import math

    found = train.where(F.col(label).isNotNull()).select("stats", F.col(label).cast("double").alias("label"))
    n, ones = found.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return math.log(((ones or 0) + 0.5) / (n - (ones or 0) + 0.5)), []
    names = found.schema["stats"].dataType.names
    vectors = VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="features")
    rows = vectors.transform(found.select("label", "stats", *[F.col(f"stats.{c}").alias(f"_{c}") for c in names]))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.7, featureSubsetStrategy="0.5").fit(rows)
    rules = sorted({simplified(p) for t in forest.trees for p in tree_paths(t._call_java("rootNode"), names)})
    if not rules:
        return math.log((ones + 0.5) / (n - ones + 0.5)), []
    fires = found.select("label", *[rule_column(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    fires = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(fires).select("label", "features")
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(staged(fires, "rules"))
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]


def score_column(model) -> Column:
    """The probability of label 1, as one expression over ``stats``."""
    bias, rules = model
    total = F.lit(bias)
    for rule, weight in rules:
        total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(stats: DataFrame, labels: DataFrame, label: str, learns: Column, id_col="doc_id"):
    """The model of the labelled rows for which ``learns`` holds."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).alias("label"))
    known = stats.where(learns).join(marked, F.col(id_col) == F.col("_id")).select("stats", "label")
    return fit(staged(known, "labelled"))


def classify(docs: DataFrame, labels: DataFrame, learns: Column, label="quality", text="text", id_col="doc_id", threshold=0.3) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``, learned from ``labels`` where ``learns`` holds.

    ``learns`` is an expression over the id. Null and empty texts get the score of zero statistics. Rows
    with a null id are scored but teach nothing, repeated rows are scored as often as they occur, a
    label given twice counts twice. Further columns are left out.
    """
    stats = staged(with_statistics(docs, text, (id_col,)), "statistics")
    score = score_column(learn(stats, labels, label, learns, id_col))
    return stats.select(id_col, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
