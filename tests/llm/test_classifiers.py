import math

import numpy as np
import pytest

from sightline.llm import quality_classifier, queries, toxicity
from sightline.llm.common import table

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    found = queries.QUERIES["op9_quality_classifier"](spark, SF)
    assert found.count() == table(spark, SF, "documents").count()
    told = found.join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(told) > 50
    assert sum(r["predicted"] == r["quality"] for r in told) >= 0.95 * len(told)
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == (r["predicted"] == 1) for r in told)


def test_quality_rules_come_from_tree_paths():
    printed = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= 1.5)
   If (feature 3 <= 2.0)
    Predict: 0.0
   Else (feature 3 > 2.0)
    Predict: 1.0
  Else (feature 0 > 1.5)
   Predict: 1.0
"""
    found = quality_classifier.paths(printed)
    names = [sorted((t.feature, t.up_to, t.bound) for t in r) for r in found]
    assert [("words", True, 1.5)] in names and [("words", False, 1.5)] in names
    assert [("symbols_per_word", False, 2.0), ("words", True, 1.5)] in names and len(names) == 4


def test_quality_compiled_expression(documents, text):
    low = quality_classifier.Test("words", True, 3.0)
    model = quality_classifier.Model(0.5, {(low,): -2.0})
    got = {r["row"]["doc_id"]: r["score"] for r in quality_classifier.score(documents([None, "a b c d", text(9000)]), model).collect()}
    assert got == {i: pytest.approx(1 / (1 + math.exp(-x))) for i, x in ((0, -1.5), (1, 0.5), (2, 0.5))}


def test_quality_without_labels(spark, documents):
    docs = documents(["a b", None, "a b"], [1, 2, 1])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_classifier.score(docs, quality_classifier.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1)], "doc_id bigint, quality int")
    found = quality_classifier.score(docs, quality_classifier.fit(docs, one)).collect()
    assert len(found) == 3 and all(r["score"] > 0.5 for r in found)


def test_toxicity_on_labels(spark):
    found = queries.QUERIES["op10_toxicity"](spark, SF)
    assert found.count() == table(spark, SF, "documents").count()
    told = found.join(table(spark, SF, "labels").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    assert sum(r["toxic"] == bool(r["truth"]) for r in told) >= 0.97 * len(told)


def marked(text, n):
    return [text(40) + (" Zerg zergling, zergo" if i % 5 == 0 else "") for i in range(n)]


@pytest.mark.xfail(reason="one unseen word of a stem scores below the bar when all labelled texts had three", strict=True)
def test_toxicity_of_one_unseen_word(spark, documents, text):
    docs = documents(marked(text, 200))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    assert toxicity.score(documents(["zergnew word"]), toxicity.fit(docs, labels)).first()["toxic"]


def test_toxicity_on_unseen_texts(spark, documents, text):
    def texts(n):
        return marked(text, n)

    docs = documents(texts(200))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    other = documents([*texts(50), None, "", text(20_000), "row"], [*range(53), None])
    got = {r["row"]["doc_id"]: r for r in toxicity.score(other, model).collect()}
    assert len(got) == 54 and [got[i]["toxic"] for i in range(50)] == [i % 5 == 0 for i in range(50)]
    assert not any(got[i]["toxic"] for i in (50, 51, 52, None))
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 600)
    rows = [{"bad": int(g * 3 + rng.integers(0, 2)), "noise": int(rng.integers(1, 5))} for g in grades]
    rows = [{f: n for f, n in r.items() if n} for r in rows]
    model = toxicity.fit_ordinal(rows, grades)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    assert model.weights["bad"] > 3 * abs(model.weights["noise"])
    eta = np.array([sum(model.weights[f] * math.log1p(n) for f, n in r.items()) for r in rows])
    severity = (1 / (1 + np.exp(-(eta[:, None] - np.array(model.thresholds))))).sum(axis=1)
    means = [severity[grades == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2


def test_toxicity_without_labels(spark, documents):
    docs = documents(["a", None])
    for rows in ([], [(0, 0)], [(0, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert not any(r["toxic"] for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0
