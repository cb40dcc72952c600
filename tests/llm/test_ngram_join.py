import random

import numpy as np
import pytest

from sightline.llm import ngram_join
from sightline.llm.common import components, settle
from sightline.llm.shingles import parity, shingle_hashes, shortened


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def cases(text):
    rng = random.Random(3)
    out = [None, "", "  ", "one", "ONE", "two words", "a a a a", "a a a a a", "a a a a a a", "x y z w", "X Y z w"]
    for size in (12, 60, 250):
        base = text(size).split()
        out.append(" ".join(base))
        for _ in range(25):  # edits of every weight, some of them chains
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                words[rng.randrange(size)] = rng.choice(["new", "other", "third"])
            out.append(" ".join(words))
            if rng.random() < 0.5:
                base = words
    passages = [text(30) for _ in range(4)]  # texts made of shared passages, not copies of each other
    out += ["\n".join(rng.sample(passages, 3)) + " " + text(rng.randint(0, 8)) for _ in range(30)]
    rng.shuffle(out)
    return out + [text(20_000)] * 2


@pytest.mark.parametrize("rare", [1, 3, 1000])
def test_matches_brute_force(documents, text, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join.links, "__defaults__", (85, rare, 4))  # many blocks as well
    texts = cases(text)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_one_stays_of_each(documents, text):
    a, b = text(50), text(50)
    docs = documents([a, a.upper(), b, None, None, "", b], [5, 3, 9, 1, None, 2, None])
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect() if r["text"]) == [(3, a.upper()), (9, b)]
    assert kept.where("text is null or text = ''").count() == 3
    assert ngram_join.first_of_each(docs.where("false")).count() == 0


def test_bitmaps_bound_the_difference(text):
    a = shortened(shingle_hashes(text(300).encode().split(), 4))
    for cut in (0, 1, 20, 100):
        b = a[cut:]
        apart = int(np.bitwise_count(parity(a, 4800) ^ parity(b, 4800)).sum())
        assert apart <= cut and (apart > 0) == (cut > 0)


def test_combinations_stay_in_proportion():
    for n in (20, 400, 6000):
        keys = ngram_join.index_keys(n, np.full(n, 99), np.arange(n) * 7919, 32, 85)
        assert 0 < len(keys) < 4 * n


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    found = components(settle(spark.createDataFrame(edges, "a bigint, b bigint"), "t"))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}
    assert found.count() == len(got)
