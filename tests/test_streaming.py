import os

import pytest
from test_operators import line

from sightline.streaming import ingest

FAILURE = '{"record":"failure","error":"Timeout"}'


def polls(folder):
    folder.mkdir()
    files = {
        "1": [line(), line(obs_id="b")],
        "2": [line(obs_id="c"), FAILURE],
        "3": [line(obs_id="d"), FAILURE, line(obs_id="e")],
        "4": [line(obs_id="f"), line(obs_id="g"), "{broken", line()],
        "5": [line(obs_id="b", observed_at="2024-01-09T00:00:00Z"), line(obs_id="h")],
    }
    for at, (name, lines) in enumerate(files.items()):
        path = folder / f"{name}.jsonl"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The same polls, one, three or all to a micro-batch."""
    out = {}
    for per_batch in (1, 3, 100):
        base = tmp_path_factory.mktemp(f"polls{per_batch}")
        polls(base / "in")
        root = str(base / "store")
        ingest.ingest(spark, str(base / "in"), root, per_batch).awaitTermination()
        out[per_batch] = root
    return out


def test_batches_decide_nothing(spark, landed):
    def links(root):
        rows = ingest.read_links(spark, root).collect()
        return sorted((r.observation_id, r.outcome, tuple(r.evidence)) for r in rows)

    one = links(landed[1])
    assert [r[0] for r in one] == ["a", "b", "f", "g", "h"]
    assert links(landed[3]) == one and links(landed[100]) == one
    assert {r[0]: r[2] for r in one}["f"] == ("f", "g")  # witnesses come from the same poll


def test_failed_polls_land_nothing_and_all_is_counted(spark, landed):
    for root in landed.values():
        counts = {
            r.poll[-7:-6]: (r.state, r.sightings, r.ingested, r.contradicting, r.malformed)
            for r in spark.read.parquet(f"{root}/counts").collect()
        }
        assert counts == {
            "1": ("landed", 2, 2, 0, 0),
            "2": ("failed", 1, 0, 0, 0),
            "3": ("runs on after its failure", 2, 0, 0, 0),
            "4": ("landed", 3, 2, 0, 1),
            "5": ("landed", 2, 1, 1, 0),
        }
        aside = spark.read.parquet(f"{root}/quarantine").collect()
        assert sorted(r.rule for r in aside) == ["contradiction", "malformed"]


def test_a_summary_spans_batches(spark, tmp_path):
    rows = [("p", i, "observation", str(i % 2), "v", None) for i in range(6)]
    rows += [("p", 7, "capability", None, None, ["Mac"]), ("q", 0, "observation", "1", "v", None)]
    rows += [("q", 1, "failure", None, None, None)]
    schema = "poll string, seq bigint, record string, l2_domain string, vantage string, kinds array<string>"
    for at, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={at}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ingest.stream_poll_summary(stream, str(tmp_path / "store")).awaitTermination()
    got = ingest.summarised_polls(spark, str(tmp_path / "store")).collect()
    assert [(r.poll, r.kinds, r.scopes) for r in got] == [("p", ["Mac"], 2)]


def test_repeats_far_apart_stay_out(spark, tmp_path):
    for at, ids in enumerate((["a", "b"], ["c"], ["a", "c", "d"])):
        rows = spark.createDataFrame([(i,) for i in ids], "obs_id string")
        rows = rows.selectExpr("obs_id", "'s' as connector_id", "timestamp_ntz'2024-01-01 00:00:00' as observed_at")
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"n={at}"))
    schema = "obs_id string, connector_id string, observed_at timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ingest.stream_deduplicated(stream, str(tmp_path / "store")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "store" / "once")).collect()
    assert sorted(r.obs_id for r in kept) == ["a", "b", "c", "d"]
    assert sum(r.refused for r in spark.read.parquet(str(tmp_path / "store" / "refused")).collect()) == 2


def test_the_number_of_micro_batches_stays(spark, monkeypatch):
    from sightline.catalog import streams

    monkeypatch.setattr(streams, "ROWS_PER_FILE", 10)
    started = {}
    for n in (400, 8_000):
        seen = []
        replayed = streams._replayed(spark.range(n).repartition(2))
        run = replayed.writeStream.foreachBatch(lambda df, _, seen=seen: seen.append(df.count()))
        run.trigger(availableNow=True).start().awaitTermination()
        assert sum(seen) == n
        started[n] = len(seen)
    assert 1 < started[8_000] <= started[400] <= streams.BATCHES + 1
