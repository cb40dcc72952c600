"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = logistic(w . x - t_k): one weight per feature, shared by the ordered thresholds.
Features are lower-case words and their first letters, at log(1 + count).  The fit sees a bounded
sample of labelled rows; every text is scored whole, in tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import settle, texts_of

LABELLED = 20_000  # rows of labels that the fit may see, by a hash of the id
FEATURES = 4_096  # features kept, by how much more often toxic texts have them
PREFIXES = (4, 5, 6)
LEAST_TEXTS = 3
REJECT = 0.5
LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """``weights`` by feature, and the increasing ``thresholds`` of grades 1, 2, ..."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]


def features(word: str) -> list[str]:
    """A word itself, marked by a closing space, and its first letters."""
    return [word + " ", *[word[:k] for k in PREFIXES if len(word) >= k]]


def _counts(text: str | None, known=None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(LETTERS.findall((text or "").lower())).items():
        for f in features(word):
            if known is None or f in known:
                found[f] += n
    return found


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """(text, toxic) of at most ``rows`` labels; the broadcast is bounded by that number."""
    told = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    return texts_of(docs, told).join(F.broadcast(told), "doc_id").select("text", "toxic")


def _chosen(sample: DataFrame, limit: int) -> dict[str, float]:
    """The features by which toxic texts stand out, with the share of their texts that are toxic."""

    def split(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, names, toxic = batch.slice(start, 128).to_pylist(), [], []
                for x in part:
                    found = _counts(x["text"])
                    names += found
                    toxic += [int(x["toxic"] > 0)] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(toxic, pa.int64())], ["f", "toxic"]
                )

    totals = sample.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("t")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return {}
    clean = totals["n"] - totals["t"]
    seen = sample.mapInArrow(split, "f string, toxic bigint").groupBy("f").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )
    lift = F.col("t") / totals["t"] - (F.col("n") - F.col("t")) / clean
    spread = F.sqrt(F.col("n") / totals["n"] * (1 - F.col("n") / (totals["n"] + 1)))
    best = seen.where(F.col("t") >= LEAST_TEXTS).where(lift > 0).orderBy((lift / spread).desc(), "f").limit(limit)
    return {r["f"]: r["t"] / r["n"] for r in best.collect()}  # at most ``limit`` rows


class Sparse(NamedTuple):
    """Feature counts of rows one after the other: how many each row has, their places in ``names``, counts."""

    names: list[str]
    sizes: np.ndarray
    col: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, rows: list[dict[str, float]]) -> Sparse:
        names = sorted({f for r in rows for f in r})
        place = {f: i for i, f in enumerate(names)}
        return cls(
            names, np.array([len(r) for r in rows], np.int64),
            np.array([place[f] for r in rows for f in r], np.int64), np.array([v for r in rows for v in r.values()], float),
        )


def graded(sample: DataFrame, purity: dict[str, float]) -> tuple[Sparse, np.ndarray]:
    """Feature counts and severity grades of the sample, which has at most ``LABELLED`` rows.

    Labels only say toxic or not.  Toxic texts are grade 1, or 2 where the share of their words that
    stand for toxicity (in texts of which nine in ten are toxic) is at or above the median's.
    """
    marks = {f for f, p in purity.items() if p >= 0.9}
    names = sorted(purity)
    place = {f: i for i, f in enumerate(names)}

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                col, n, dense, toxic = [], [], [], []
                for x in batch.slice(start, 128).to_pylist():
                    words = LETTERS.findall((x["text"] or "").lower())
                    dense.append(sum(any(f in marks for f in features(w)) for w in words) / max(1, len(words)))
                    found = _counts(x["text"], purity)
                    col.append([place[f] for f in found])
                    n.append(list(found.values()))
                    toxic.append(int(x["toxic"] > 0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(col, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())),
                    pa.array(dense, pa.float64()), pa.array(toxic, pa.int32()),
                ], ["col", "n", "dense", "toxic"])

    # Four bytes a feature in place of a map with its name.
    rows = sample.mapInArrow(count, "col array<int>, n array<int>, dense double, toxic int").toArrow()
    dense, toxic = rows["dense"].to_numpy(), rows["toxic"].to_numpy()
    middle = np.median(dense[toxic > 0]) if toxic.any() else 0
    grades = (toxic * (1 + (dense >= middle))).astype(np.int64)
    flat = [rows[c].combine_chunks().flatten().to_numpy() for c in ("col", "n")]
    sizes = pc.list_value_length(rows["col"]).to_numpy()
    return Sparse(names, sizes, flat[0].astype(np.int64), flat[1].astype(float)), grades


def fit_ordinal(rows: list[dict[str, float]] | Sparse, grades: np.ndarray, ridge: float = 0.02,
                steps: int = 300) -> Model:
    """Cumulative-link fit by full gradients (Adam); thresholds stay ordered by construction."""
    rows = rows if isinstance(rows, Sparse) else Sparse.of(rows)
    names, sizes, col, count = rows
    many = len(sizes)
    at = np.repeat(np.arange(many), sizes)
    val = np.log1p(count)
    levels = int(grades.max(initial=0))
    if levels == 0:
        return Model({}, (9.0,))
    above = grades[:, None] >= np.arange(1, levels + 1)
    w = np.zeros(len(names))
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    base = -np.log(share / (1 - share))
    t = np.concatenate([base[:1], np.log(np.maximum(1e-3, np.diff(base)))])
    m, v = np.zeros(len(w) + levels), np.zeros(len(w) + levels)
    for step in range(1, steps + 1):
        gaps = np.exp(t[1:])
        theta = t[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(at, val * w[col], many)
        z = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -30, 30)))  # P(grade >= k)
        edge = np.hstack([np.ones((many, 1)), z, np.zeros((many, 1))])
        p = np.maximum(1e-9, edge[np.arange(many), grades] - edge[np.arange(many), grades + 1])
        slope = z * (1 - z)
        # d log p / d (eta - theta_k): the lower edge of the grade raises p, the upper one lowers it.
        sign = (grades[:, None] == np.arange(1, levels + 1)).astype(float)
        sign -= grades[:, None] + 1 == np.arange(1, levels + 1)
        g = sign * slope / p[:, None]
        toward = np.bincount(col, val * g.sum(axis=1)[at], len(w)) / many - ridge * w / many ** 0.5
        down = -g.sum(axis=0) / many
        tail = np.cumsum(down[::-1])[::-1]
        both = np.concatenate([toward, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * both, 0.99 * v + 0.01 * both**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[: len(w)], t + move[len(w) :]
    theta = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
    return Model({f: float(x) for f, x in zip(names, w, strict=True)}, tuple(map(float, theta)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED, limit: int = FEATURES) -> Model:
    """Fits on labels of one or both kinds; without toxic or without clean ones no text is toxic."""
    sample = settle(labelled_rows(docs, labels, rows), "labelled")
    purity = _chosen(sample, limit)
    return fit_ordinal(*graded(sample, purity)) if purity else Model({}, (9.0,))


def score(docs: DataFrame, model: Model, row: Column | None = None) -> DataFrame:
    """(row, severity, grade, p_toxic, toxic) for every row of ``docs``.

    ``severity`` is the expected grade, ``grade`` the likeliest.  A null or empty text has no
    features and the lowest severity; repeated rows score alike.  The model, at most ``FEATURES``
    weights, is shipped with the function.
    """
    weights, theta = model.weights, np.array(model.thresholds)

    def work(batches):
        cache: dict[str, list[str]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                eta = []
                for text in part.column("_text").to_pylist():
                    total: Counter = Counter()
                    for word, n in Counter(LETTERS.findall((text or "").lower())).items():
                        found = cache.get(word)
                        if found is None:
                            if len(cache) > 200_000:
                                cache.clear()
                            found = cache[word] = [f for f in features(word) if f in weights]
                        for f in found:
                            total[f] += n
                    eta.append(sum(weights[f] * np.log1p(n) for f, n in total.items()))
                z = 1 / (1 + np.exp(-np.clip(np.array(eta)[:, None] - theta, -30, 30)))
                edge = np.hstack([np.ones((len(z), 1)), z, np.zeros((len(z), 1))])
                grade = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), pa.array(z.sum(axis=1)), pa.array(grade, pa.int32()),
                    pa.array(z[:, 0]), pa.array(z[:, 0] >= REJECT),
                ], ["row", "severity", "grade", "p_toxic", "toxic"])

    packed = docs.select((F.struct("*") if row is None else row).alias("row"), F.col("text").alias("_text"))
    kinds = (("severity", "double"), ("grade", "int"), ("p_toxic", "double"), ("toxic", "boolean"))
    schema = packed.select("row", *[F.lit(None).cast(k).alias(c) for c, k in kinds]).schema
    return packed.mapInArrow(work, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows judged toxic."""
    return score(docs, fit(docs, labels)).where("not toxic").select("row.*")
