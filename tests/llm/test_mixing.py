import re
from collections import defaultdict

from pyspark.sql import functions as F

from sightline.llm import mixing
from sightline.llm.common import attached, row_hash, running, settle


def sizes(texts):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def brute_targets(by_source):
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(by_source.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        level = left / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * level > 3 * by_source[s]}
        if not over:
            return names, target | {s: weight[s] * level for s in open_}
        target |= {s: 3 * by_source[s] for s in over}
        open_ -= over


def brute_awards(names, target, seats):
    won = defaultdict(int)
    for _ in range(seats):
        won[max(names, key=lambda s: (target[s] / (2 * won[s] + 1), -names.index(s)))] += 1
    return won


def made(documents, text):
    sources = ["b", "a", None, "Z", "tiny", "hot"]
    rows = [(text(3 + 7 * i % 40), sources[i % 6]) for i in range(90)] + [(text(30), "hot")] * 60
    rows += [("", "a"), (None, "b"), (" ", "blank"), ("w", "tiny")]
    return documents([t for t, _ in rows], [*range(150), 150, 150, None, None], [s for _, s in rows]), rows


def test_quotas_follow_the_highest_quotients(documents, text):
    docs, rows = made(documents, text)
    by_source = defaultdict(int)
    for (_, s), n in zip(rows, sizes([t for t, _ in rows]), strict=True):
        by_source[s] += n
    names, target = brute_targets(by_source)
    sized = mixing.sized(docs)
    for blocks, shards in ((1 << 20, 4), (97, 5), (3, 2)):
        plan = mixing.quotas(mixing.targets(sized), shards, blocks).collect()
        assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in plan)
        total = sum(by_source.values())
        # So many blocks, or as many as give the source with the least target its LEAST_BLOCKS.
        least = min(t for s, t in target.items() if by_source[s])
        block = max(1, min(total // blocks, int(least // mixing.LEAST_BLOCKS)))
        assert {r["block"] for r in plan} == {block}
        for j in range(shards + 1):
            won = brute_awards([s for s in names if by_source[s]], target, total // block * j // shards)
            assert {r["source"]: r["bounds"][j] for r in plan} == {s: won[s] for s in names}


def test_taken_nears_the_targets(documents, text):
    docs, rows = made(documents, text)
    drawn = mixing.mix(mixing.sized(docs), shards=4)
    got = drawn.collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and sum(r["shard_words"]) == r["taken"] for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1.5 for s in target)
    again = mixing.mix(mixing.sized(docs.repartition(7)), shards=4).collect()
    key = lambda r: (r["doc_id"] or -1, r["source"] or "", r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_keeps_columns(documents, text):
    docs, _ = made(documents, text)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mixed(docs.where("false")).count() == 0
    plan = mixing.mix(mixing.sized(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_running_sums_do_not_depend_on_ranges(spark):
    rows = settle(spark.range(200).select(
        (F.col("id") % 3).alias("g"), (F.xxhash64("id").bitwiseAND((1 << 60) - 1)).alias("h"), F.col("id").alias("v")
    ), "t")
    one, many = ({(r["g"], r["h"]): r["s"] for r in running(rows, "g", ["h"], "v", "s", parts=p).collect()} for p in (1, 9))
    assert one == many and min(one.values()) == 0


def test_a_tiny_source_beside_a_huge_one_nears_its_target(spark):
    sizes = [("a", 10**9)] * 10 + [("b", 100)] * 10
    rows = settle(spark.createDataFrame(
        [(bytes([i]), i, s, n) for i, (s, n) in enumerate(sizes)],
        "row_hash binary, doc_id bigint, source string, size bigint",
    ), "sized")
    got = mixing.mix(rows).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target["b"] == 3000 and abs(taken["b"] - 3000) <= 3000 / mixing.LEAST_BLOCKS
    assert abs(taken["a"] / target["a"] - 1) < 1e-4


def test_rows_that_share_half_a_hash_stay_apart(documents, text):
    texts = [text(5) for _ in range(40)]
    docs = documents(texts + texts, list(range(80)))
    hashes = docs.select(row_hash(docs).alias("h"))
    assert hashes.distinct().count() == 80 and len(hashes.first()["h"]) == 16
    told = docs.select(row_hash(docs).alias("row_hash"), F.lit(1).alias("n"))
    back = attached(docs, told).select("row.*").collect()
    assert sorted(back) == sorted(docs.collect())
