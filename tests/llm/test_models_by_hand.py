"""Fitted models checked by hand: scores recomputed in plain Python, optima by their conditions."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from sightline.llm import quality_classifier, toxicity
from sightline.llm.common import table
from sightline.llm.stats import STOP_FORMS

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[ \t-\r]+")


def statistics(text):
    """The features of the rule ensemble, counted word by word."""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    n, m = max(1, len(words)), max(1, len(lines))
    return {
        "words": len(words), "lines": len(lines), "word_length": sum(map(len, words)) / n,
        "symbols_per_word": sum(c in "#*$%&|<>" for c in text) / n,
        "marks_per_word": sum(c in "!?" for c in text) / n,
        "stop_ratio": sum(w in set(STOP_FORMS) for w in words) / n, "repeat_ratio": len(again) / n,
        "distinct_ratio": len(set(words)) / n, "dup_line_ratio": (len(lines) - len(set(lines))) / m,
        "upper_ratio": sum("A" <= c <= "Z" for c in text) / max(1, len(text)), "words_per_line": len(words) / m,
    }


def holds(rule, told):
    return all(told[t.feature] <= t.bound if t.up_to else told[t.feature] > t.bound for t in rule)


@pytest.fixture(scope="module")
def real(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    return docs, rows, table(spark, SF, "labels")


def test_quality_scores_rule_by_rule(real):
    docs, rows, labels = real
    model = quality_classifier.fit(docs, labels)
    assert len(model.weights) > 1
    got = {r["row"]["doc_id"]: r for r in quality_classifier.score(docs, model).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        told = statistics(text)
        total = model.base + sum(w for rule, w in model.weights.items() if holds(rule, told))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_quality_weights_meet_the_lasso_condition(real):
    """At the optimum the mean gradient of a kept rule is the penalty against its sign, the base's none."""
    docs, rows, labels = real
    model = quality_classifier.fit(docs, labels)
    told = labels.where("quality is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").collect()
    truth = np.array([r["quality"] for r in told], float)
    stats = [statistics(rows[r["doc_id"]]) for r in told]
    kept = list(model.weights)
    x = np.array([[holds(rule, s) for rule in kept] for s in stats], float)
    w = np.array([model.weights[r] for r in kept])
    p = 1 / (1 + np.exp(-(model.base + x @ w)))
    gradient = x.T @ (p - truth) / len(truth)
    assert abs((p - truth).mean()) < 1e-3
    assert np.abs(gradient + quality_classifier.LASSO * np.sign(w)).max() < 1e-3


def test_toxicity_scores_word_by_word(real):
    docs, rows, labels = real
    model = toxicity.fit(docs, labels)
    assert model.weights
    got = {r["row"]["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        found = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            for name in (word + " ", word[:4], word[:5], word[:6]):
                # A beginning as long as asked for only: shorter words have none.
                found[name] += 1 if name.endswith(" ") or len(name) >= 4 else 0
            for k in (5, 6):
                if len(word) < k and len(word[:k]) >= 4:
                    found[word[:k]] -= 1
        eta = sum(model.weights.get(f, 0.0) * math.log1p(n) for f, n in found.items() if n > 0)
        above = [1 / (1 + math.exp(min(30, max(-30, t - eta)))) for t in model.thresholds]
        edges = [1, *above, 0]
        chances = [a - b for a, b in zip(edges, edges[1:], strict=False)]
        assert got[i]["severity"] == pytest.approx(sum(k * c for k, c in enumerate(chances)), abs=1e-9)
        assert got[i]["p_toxic"] == pytest.approx(above[0], abs=1e-9)
        assert got[i]["toxic"] == (got[i]["p_toxic"] >= 0.5)


def test_ordinal_fit_is_at_its_optimum():
    """The gradient of the penalised likelihood, by differences, vanishes where the steps end.

    The usual 300 steps stop short of that (a slope of 0.006 here), though hardly in likelihood.
    """
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 400)
    rows = [{"a": int(rng.poisson(1 + g)), "b": int(rng.poisson(2)), "c": int(rng.poisson(3 - g))} for g in grades]
    rows = [{f: n for f, n in r.items() if n} for r in rows]
    model = toxicity.fit_ordinal(rows, grades, steps=3_000)
    names = sorted(model.weights)
    x = np.array([[math.log1p(r.get(f, 0)) for f in names] for r in rows])

    def likelihood(v):
        w, theta = v[: len(names)], v[len(names) :]
        z = 1 / (1 + np.exp(-((x @ w)[:, None] - theta)))
        edge = np.hstack([np.ones((len(x), 1)), z, np.zeros((len(x), 1))])
        at = np.arange(len(x))
        told = np.log(edge[at, grades] - edge[at, grades + 1]).mean()
        return told - 0.02 * (w @ w) / 2 / len(x) ** 0.5

    best = np.array([*[model.weights[f] for f in names], *model.thresholds])
    usual = toxicity.fit_ordinal(rows, grades)
    usual = np.array([*[usual.weights[f] for f in names], *usual.thresholds])
    assert 0 <= likelihood(best) - likelihood(usual) + 1e-9 < 1e-3
    for i in range(len(best)):
        step = np.zeros(len(best))
        step[i] = 1e-4
        assert abs(likelihood(best + step) - likelihood(best - step)) / 2e-4 < 5e-3
        step[i] = 0.3
        assert likelihood(best) > max(likelihood(best + step), likelihood(best - step))
