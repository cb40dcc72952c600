import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sightline.llm import sharding


def check(got, shards, slack):
    loads, texts, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        texts[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert set(loads) == set(range(shards)) and max(loads.values()) - min(loads.values()) <= slack
    assert all(len(x) == 1 for x in texts.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_near_equal_bytes_and_whole_groups(documents, text):
    texts = [text(2 + i % 50) for i in range(600)] + [text(10)] * 40 + [None, None, ""]
    docs = documents(texts, [*range(640), None, 3, 3], [f"s{i % 5}" for i in range(642)] + [None])
    for shards in (8, 3, 1):
        got = sharding.shard(docs, shards).collect()
        assert len(got) == 643
        check(got, shards, 2500)
        want = sorted((len(b) + 1, zlib.crc32(b)) for b in ((t or "").encode() for t in texts))
        assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    placed = sharding.sharded(docs)
    assert placed.count() == 643 and placed.select("row.*").columns == docs.columns
    assert placed.select("shard", "slot").distinct().count() == 643
    assert sorted(r[0] or "" for r in placed.select("row.text").collect()) == sorted(t or "" for t in texts)
    by_bytes = sharding.shard(docs, target_bytes=30_000)
    assert by_bytes.agg(F.max("shard")).first()[0] > 2


def test_leaves_are_boxes(documents, text):
    """Every split is by one coordinate: the leaves come from nested half-spaces."""
    docs = documents([text(1 + i % 70) for i in range(300)])
    rows = sharding.shard(docs, 8).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    groups = {g["group"]: g for g in sharding.grouped(rows).collect()}
    leaf = {r["group"]: r["shard"] for r in rows.select("group", "shard").collect()}

    def split(nodes, low, count):
        if count == 1:
            return
        left = [g for g in nodes if leaf[g] < low + count // 2]
        right = [g for g in nodes if leaf[g] >= low + count // 2]
        assert any(
            max(groups[g][d] for g in left) < min(groups[g][d] for g in right) for d in sharding.DIMENSIONS
        )
        split(left, low, count // 2)
        split(right, low + count // 2, count - count // 2)

    split(list(groups), 0, 8)


def test_empty_and_tiny(documents):
    assert sharding.shard(documents(["a"]).where("false")).count() == 0
    assert {r["slot"] for r in sharding.shard(documents(["a", "a", None])).where("size = 2").collect()} == {0, 1}


def test_thousands_of_leaves(documents, monkeypatch):
    """A cut table has a row per node: 4,096 leaves, with the join salted as well as broadcast."""
    docs = documents([f"text {i} " + "x" * (i * 7919 % 90) for i in range(6_000)])
    for bound, shards in ((200_000, 4_096), (0, 64)):
        monkeypatch.setattr(sharding, "NODES", bound)
        got = sharding.shard(docs, shards).select("shard", "size", "slot", "text_crc32").collect()
        loads = defaultdict(int)
        for r in got:
            loads[r["shard"]] += r["size"]
        assert len(got) == 6_000 and set(loads) <= set(range(shards)) and len(loads) > 0.8 * shards
        assert max(loads.values()) <= 2 * sum(loads.values()) / shards + 200
