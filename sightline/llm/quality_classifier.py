"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees over text statistics give paths; every path is a conjunctive rule.  A lasso logistic
regression over the rules' indicators keeps few of them, and the kept ones become one expression.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import crc_of_id, settle, texts_of
from sightline.llm.stats import with_statistics

LABELLED = 20_000  # labelled rows that the fit may see, by a hash of the id
TREES, DEPTH, LASSO, SEED = 12, 3, 0.001, 11
PREDICT = 0.3

# Statistics the rules may test: a count, or a count per another.
FEATURES = {
    "words": "cast(n_words as double)",
    "lines": "cast(n_lines as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "stop_ratio": "n_stop / greatest(n_words, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "upper_ratio": "n_upper / greatest(n_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


class Test(NamedTuple):
    feature: str
    up_to: bool  # feature <= bound, else feature > bound
    bound: float


Rule = tuple[Test, ...]


class Model(NamedTuple):
    base: float
    weights: dict[Rule, float]


def with_features(docs: DataFrame) -> DataFrame:
    """(row, one double per feature); a null or empty text has zeros."""
    found = with_statistics(docs)
    return found.select("row", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()])


def holds(rule: Rule) -> Column:
    test = F.lit(True)
    for t in rule:
        test = test & ((F.col(t.feature) <= t.bound) if t.up_to else (F.col(t.feature) > t.bound))
    return test


def _branch(line: str) -> tuple[int, Test | None]:
    """Depth and test of a line of a tree's printed form; None for a leaf."""
    depth = len(line) - len(line.lstrip())
    found = re.search(r"\(feature (\d+) (<=|>) (\S+)\)", line)
    name = list(FEATURES)[int(found[1])] if found else ""
    return depth, Test(name, found[2] == "<=", float(found[3])) if found else None


def paths(printed: str) -> list[Rule]:
    """Every path from the root of a printed tree, inner nodes' included, as a rule."""
    rules, stack = [], []
    for depth, test in map(_branch, printed.splitlines()[1:]):
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if test:
            stack.append((depth, test))
            rules.append(tuple(sorted({t for _, t in stack})))
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Model:
    """Fits on at most ``rows`` labels of documents that are not held out.

    With labels of one value only, or none, the model is their rate for every text.
    """
    told = labels.where("doc_id is not null and quality is not null").where(crc_of_id() % 5 != 0)
    told = told.select("doc_id", F.col("quality").cast("double").alias("label"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    known = texts_of(docs, told).join(F.broadcast(told), "doc_id")  # bounded by ``rows``
    sample = with_features(known).withColumn("label", F.col("row.label")).drop("row")
    sample = settle(sample, "labelled")
    n, good = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        rate = ((good or 0) + 0.5) / (n + 1)
        return Model(math.log(rate / (1 - rate)), {})
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    trees = forest.fit(vectors.select("features", "label")).trees
    rules = sorted({r for tree in trees for r in paths(tree.toDebugString)})
    told = sample.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    hits = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(told)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    fitted = lasso.fit(hits.select("features", "label"))
    weights = {r: float(w) for r, w in zip(rules, fitted.coefficients, strict=True) if abs(w) > 1e-9}
    return Model(float(fitted.intercept), weights)


def compiled(model: Model) -> Column:
    """The model's probability of good quality, as one expression over the features."""
    total = F.lit(model.base)
    for rule, weight in model.weights.items():
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score, predicted) for every row of ``docs``, empty texts too; repeated rows alike."""
    scored = with_features(docs).select("row", compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
