import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sightline.llm import suffix_tree
from sightline.llm.common import table


def words(text):
    return (text or "").encode().lower().split()


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def test_codes_hold_symbol_and_context():
    code, lengths = suffix_tree.codes([b"ab\n", b"\n"], depth=2)
    assert lengths.tolist() == [3, 1]
    assert [c.to_bytes(3, "big") for c in code.tolist()] == [b"\n\na", b"\nab", b"ab\n", b"\n\n\n"]


def test_base_counts_match_brute_force(documents, text, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 50)
    texts = [text(30) for _ in range(40)] + [None, "", "Ünï Ünï", text(20_000)] + ["same text"] * 3
    ids = [*range(43), None, 7, 7, 8]
    got = suffix_tree.score(documents(texts, ids)).collect()
    c = Counter()
    for i, t in zip(ids, texts, strict=True):
        if not held(i):
            c.update([*words(t), b""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        tokens = [*words(t), b""]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[(i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6))] += 1
    assert Counter(tuple(r)[:4] + (r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_tree_matches_brute_force_and_sums_to_one(documents, text, monkeypatch):
    monkeypatch.setattr(suffix_tree, "LEAST_COUNT", 3)
    texts = [text(60) for _ in range(60)]
    docs = documents(texts).selectExpr("cast(text as binary) as text")
    tree = suffix_tree.learn(docs, depth=3)
    pair = Counter()
    for t in texts:
        line = b"\n" * 3 + suffix_tree.normalised(words(t))
        for i in range(3, len(line)):
            for d in range(4):
                pair[line[i - d : i], line[i : i + 1]] += 1
    total, kinds = Counter(), Counter()
    for (s, _), n in pair.items():
        total[s] += n
        kinds[s] += 1
    kept = {b""}
    for s in total:
        gain = sum(n * math.log(n / total[s] / (pair[s[1:], a] / total[s[1:]])) for (x, a), n in pair.items() if x == s and s)
        if s and total[s] >= 3 and gain >= suffix_tree.DIVERGENCE:
            kept |= {s[i:] for i in range(len(s))}
    got = {int(c).to_bytes(d, "big") if d else b"" for d, cs in enumerate(tree.contexts) for c in cs}
    assert got == kept and len(kept) > 20

    def p(s, a):
        if s not in kept:
            return p(s[1:], a)
        back = p(s[1:], a) if s else 1 / 256
        return (pair[s, a] + kinds[s] * back) / (total[s] + kinds[s])

    for context in (b"\n\n\n", b"ora", b" le", b"zzz"):
        code = np.array([int.from_bytes(context + bytes([a]), "big") for a in range(256)], np.uint64)
        got = tree.log10(code)
        assert sum(10**got) == pytest.approx(1)
        assert np.allclose(got, [math.log10(p(context, bytes([a]))) for a in range(256)])


def test_beats_the_unigrams_on_held_out_texts(spark):
    got = suffix_tree.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_and_nothing_to_learn_from(documents):
    assert suffix_tree.score(documents(["a"]).where("false")).count() == 0
    alone = suffix_tree.score(documents(["some text"], [None])).collect()  # held out
    assert [(r["held_out"], r["n_known"], r["train_tokens"]) for r in alone] == [(True, 0, 0)]
    assert alone[0]["score"] == pytest.approx(-10 * math.log10(256))


def test_scores_are_those_of_the_whole_tree(documents, text, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 300)
    texts = [text(80) for _ in range(60)] + [None, "", "never seen bytes: \x01 Ünï"]
    docs = documents(texts)
    taught = [t for i, t in enumerate(texts) if not held(i)]
    tree = suffix_tree.learn(documents(taught).selectExpr("cast(text as binary) as text"))
    got = suffix_tree.score(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        code, _ = suffix_tree.codes([suffix_tree.normalised(words(texts[r["doc_id"]]))])
        assert r["score"] == pytest.approx(tree.log10(code).sum())


def test_contexts_are_kept_by_count_at_every_size(spark):
    """2.5 million symbols, in which a context that stands there four times is still kept."""
    level = spark.sql(
        """select stack(4, shiftleft(97L, 8) + 98, 2500000L, shiftleft(120L, 8) + 121, 4L,
           shiftleft(97L, 8) + 121, 10L, shiftleft(119L, 8) + 98, 3L) as (code, n)"""
    )
    contexts = {r["context"] for r in suffix_tree.kept(level, depth=1).where("depth = 1").collect()}
    assert ord("x") in contexts and ord("w") not in contexts
