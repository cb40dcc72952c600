"""The index of stored ids, the sink that refuses repeats, and bounded candidates."""

from pyspark.sql import functions as F

from sightline.operators import links
from sightline.plans import idindex
from sightline.sources import store


def of(spark, numbers, **more):
    rows = spark.createDataFrame([(n,) for n in numbers], "id bigint")
    return rows.select("id", *[F.lit(v).alias(c) for c, v in more.items()])


def found(index):
    return sorted(tuple(r) for r in index.collect()) if index is not None else None


def test_only_earlier_generations_are_told(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ids")
    monkeypatch.setattr(idindex, "BLOCK_IDS", 10)
    monkeypatch.setattr(idindex, "BLOCKS_PER_FILE", 2)
    assert idindex.held(of(spark, [1]), root) is None
    idindex.append(of(spark, range(0, 200), v=0), root, 0)
    idindex.append(of(spark, [], v=1), root, 1)
    idindex.append(of(spark, range(300, 350), v=2), root, 2)
    asked = of(spark, [5, 199, 200, 310, 999, 5])
    assert found(idindex.held(asked, root)) == [(5, 0), (199, 0), (310, 2)]
    assert found(idindex.held(asked, root, 2)) == [(5, 0), (199, 0)]
    assert found(idindex.held(asked, root, 0)) is None
    # A lost batch is written again over its own files.
    idindex.append(of(spark, [999], v=3), root, 2)
    assert found(idindex.held(asked, root)) == [(5, 0), (199, 0), (999, 3)]


def test_a_lookup_reads_few_files(spark, tmp_path):
    root = str(tmp_path / "ids")
    idindex.append(spark.range(400_000), root, 0)
    living = idindex.generations(spark, root)
    assert idindex.files(of(spark, [3, 77]), root, living).count() <= 2 < -(-living[0][1] // idindex.BLOCKS_PER_FILE)
    # Few ids that are not stored pass the filters.
    strange = spark.range(10**9, 10**9 + 3_000)
    passed = idindex.files(strange.limit(1), root, living).count()
    assert passed <= 1 and found(idindex.held(strange, root)) == []


def test_merged_generations_stand_for_their_own(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ids")
    monkeypatch.setattr(idindex, "GENERATIONS", 2)
    for n in range(5):
        idindex.append(of(spark, [n, n + 100], v=n), root, n)
    living = [b for b, _ in idindex.generations(spark, root)]
    assert len(living) <= 4 and min(living) < 0 and max(living) == 4
    assert found(idindex.held(of(spark, range(200)), root)) == sorted((i, i % 100) for n in range(5) for i in (n, n + 100))
    assert [r[0] for r in found(idindex.held(of(spark, [4, 3]), root, 4))] == [3]


def sightings(spark, rows):
    made = spark.createDataFrame(rows, "obs_id string, day int, raw string")
    none = F.array().cast("array<struct<Mac:struct<addr:string>>>")
    return made.select(
        "obs_id", F.lit("s").alias("connector_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(days="day")).alias("observed_at"),
        F.lit(1).alias("l2_domain"), F.lit(0).alias("vantage"), none.alias("facts"), "raw",
    )


def test_the_sink_refuses_what_is_stored(spark, tmp_path):
    path = str(tmp_path / "obs")
    first = store.append_observations(sightings(spark, [("a", 0, "x"), ("b", 0, "x"), ("b", 0, "y")]), path)
    assert found(first) == [("b", "repeated", 1)]
    again = [("a", 0, "z"), ("a", 9, "z"), ("b", 5, "x"), ("c", 0, "x"), ("c", 1, "x"), ("d", 0, "x")]
    refused = store.append_observations(sightings(spark, again), path)
    assert found(refused) == [("a", "contradicting", 2), ("b", "contradicting", 1), ("c", "contradicting", 2)]
    stored = store.read_observations(spark, path)
    assert sorted(r.obs_id for r in stored.collect()) == ["a", "b", "d"]


def test_candidates_are_the_first_few(spark):
    rows = spark.range(500).select(
        (F.col("id") % 2).alias("observation_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("interface_id"),
        F.array("id").alias("evidence"),
    )
    best = links.best_candidates(rows, 3)
    assert {r[0]: [c["interface_id"] for c in r[1]] for r in best.collect()} == {
        0: ["0000", "0002", "0004"], 1: ["0001", "0003", "0005"],
    }
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_an_ambiguity_without_candidates_is_refused(spark):
    rows = [("1", "abstained", None, "ambiguous", [("i", [1])]), ("2", "abstained", None, "ambiguous", []),
            ("3", "match", "", None, None), ("4", "match", "l1", None, None)]
    table = spark.createDataFrame(
        rows, "link_id string, outcome string, rule_id string, abstention_cause string, "
        "candidates array<struct<interface_id:string,evidence:array<int>>>",
    )
    assert found(links.refused_links(table)) == [("2", "ambiguous_without_candidate"), ("3", "decision_without_rule")]


def test_ids_are_never_broadcast(spark, tmp_path):
    root = str(tmp_path / "ids")
    idindex.append(spark.range(1_000), root, 0)
    asked = spark.range(500, 1_500)
    for rows in (idindex.files(asked, root, idindex.generations(spark, root)), idindex.held(asked, root)):
        assert "Broadcast" not in rows._jdf.queryExecution().sparkPlan().toString()
    assert idindex.held(asked, root).count() == 500
