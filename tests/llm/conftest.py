import random

import pytest

WORDS = "ora lem tus vel quin dor sab ni pel tor mas gin ulo ret cav bos nel fir hum zed".split()


@pytest.fixture
def text():
    """Makes seeded texts of so many words."""
    rng = random.Random(5)

    def make(n, per_line=9):
        words = ["".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))

    return make


@pytest.fixture
def documents(spark):
    """documents rows from texts, with names that the operators use inside."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = sources or ["s"] * len(texts)
        rows = [(i, t, "en", s, len(t or ""), "kept", 7) for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, k int"
        ).withColumnRenamed("k", "label").repartition(3)

    return make
