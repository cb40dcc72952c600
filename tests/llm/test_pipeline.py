from collections import Counter

import corpus_pipeline
from sightline.llm import decontaminate, ngram_join, toxicity
from sightline.llm.common import settle, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_on_whole_inputs(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, before, SF), name)
        seen[name] = (before, after)
        assert after.columns[: len(columns)] == columns
        before = after
    rows = {k: ({r["doc_id"] for r in a.collect()}, {r["doc_id"] for r in b.collect()}) for k, (a, b) in seen.items()}
    labels = table(spark, SF, "labels")

    toxic = {r["row"]["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("toxic").collect()}
    assert rows["toxicity"][0] - rows["toxicity"][1] == toxic and toxic

    groups = {}
    for r in ngram_join.join(seen["ngram_join"][0], words=5, per_cent=80).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert rows["ngram_join"][1] == {min(g) for g in groups.values()}
    texts = {r["doc_id"]: r["text"] for r in seen["ngram_join"][0].collect()}
    assert rows["ngram_join"][1] == least_of_each(texts)

    hit = decontaminate.scan(seen["decontamination"][0], table(spark, SF, "benchmark")).where("n_hit > 0")
    assert rows["decontamination"][0] - rows["decontamination"][1] == {r["row"]["doc_id"] for r in hit.collect()}

    assert rows["mixing"][1] <= rows["mixing"][0]
    copies = [r["count"] for r in seen["mixing"][1].groupBy("doc_id").count().collect()]
    assert max(copies) <= 3
    last = seen["sharding"][1]
    assert last.count() == seen["mixing"][1].count() and last.select("shard", "slot").distinct().count() == last.count()
    assert corpus_pipeline.run(spark, SF).count() == last.count()


def least_of_each(texts, size=5, share=0.8):
    """The smallest id of each group linked by the share of common shingles."""
    sets, having = {}, {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        for s in sets[i]:
            having.setdefault(s, []).append(i)
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, mine in sets.items():
        common = Counter(j for s in mine for j in having[s] if j < i)
        for j, n in common.items():
            if n >= share * (len(mine) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in texts}


def test_near_copies_are_judged_on_five_words(spark, documents, text):
    base = text(104).replace("\n", " ").split()
    scattered = list(base)
    scattered[50], scattered[80] = "changed", "too"
    texts = [base, [*base, *text(23).split()], [*base, *text(26).split()], scattered, text(90).split()]
    docs = dict(enumerate(" ".join(t) for t in texts))
    got = corpus_pipeline.drop_near_copies(spark, documents(list(docs.values())), SF)
    assert {r["doc_id"] for r in got.collect()} == least_of_each(docs) == {0, 2, 4}

    given = table(spark, "/root/testdata/sf0.01", "documents")
    got = corpus_pipeline.drop_near_copies(spark, given, SF)
    want = least_of_each({r["doc_id"]: r["text"] for r in given.collect()})
    assert {r["doc_id"] for r in got.collect()} == want


def test_stages_take_columns_of_clashing_names(spark, documents, text):
    texts = [text(30 + i) for i in range(20)] + ["", None]
    docs = documents(texts).selectExpr("*", "1 as shard", "'x' as Slot", "2 as _range", "3 as size", "4 as row_hash")
    mixed = settle(corpus_pipeline.mix_sources(spark, docs, SF), "mixed")  # as between stages
    out = settle(corpus_pipeline.deal_shards(spark, mixed, SF), "dealt")
    assert out.columns == [*docs.columns, "shard_", "slot_"] and out.count() > 0
    assert {r["shard"] for r in out.collect()} == {1}
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
