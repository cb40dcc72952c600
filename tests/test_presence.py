"""Presence kept as state, against the batch operator and a count day by day."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import sources
from sightline.streaming import presence as P

WINDOW, MISSES = 4, 2
SCHEMA = "stream string, at timestamp, live boolean, l2_domain string, mac string"


def test_one_key_day_by_day():
    rng = random.Random(5)
    for _ in range(300):
        seen = sorted(rng.sample(range(20), rng.randint(1, 6)))
        live = sorted(rng.sample(range(20), rng.randint(0, 12)))
        shown, want = None, []
        for today in range(30):
            upto = [d for d in seen if d <= today]
            if upto:
                start = max(upto[-1], today - WINDOW)
                now = (upto[-1], sum(start < d <= today for d in live))
                if now != shown:
                    want.append((today, *now))
                shown = now
        state, got, at = (None, None, []), [], 0
        for upto in sorted({*rng.sample(range(1, 30), 3), 30}):
            waiting = sorted({*state[2], *[d for d in seen if at <= d < upto]})
            known = [d for d in live if d < upto]
            *state, told = P.changes(state[0], state[1], waiting, known, range(at, upto), WINDOW)
            got, at = got + told, upto
        assert got == want


def rows(first, last):
    """Two sources; one is blind on days 5 and 6, and a mac without a domain is seen by it."""
    out = []
    for day in range(first, last):
        at = f"2024-03-{day + 1:02d} "
        for source in ("a", "b"):
            blind = source == "b" and day in (5, 6)
            out += [(source, at + "08:00:00", True, None, None), (source, at + "20:00:00", not blind, None, None)]
            for key in range(6):
                if (day * 7 + key * 3) % 5 == 0 or day < key:
                    out.append((source, at + f"{key:02d}:30:00", True, None if key == 5 else "1", f"m{key}"))
    return out


def arrive(spark, path, part):
    frame = spark.createDataFrame(part, SCHEMA.replace("at timestamp", "at string"))
    for at, day in enumerate(sorted({r[1][:10] for r in part})):
        own = frame.where(F.col("at").startswith(day)).withColumn("at", F.col("at").cast("timestamp"))
        own.coalesce(1).write.mode("append").parquet(path)


def follow(spark, path, root, per_batch):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)
    P.stream_presence(stream, root, WINDOW, "1 day", shards=3).awaitTermination()


def states(frame):
    named = frame.select("stream", F.coalesce("l2_domain", F.lit("")).alias("d"), "mac", "day", "missed", "state")
    return sorted(tuple(r) for r in named.collect())


@pytest.mark.parametrize("per_batch", [1, 100])
def test_stream_equals_batch_after_a_restart(spark, tmp_path, per_batch):
    path, root = str(tmp_path / "in"), str(tmp_path / "store")
    arrive(spark, path, rows(0, 6))
    follow(spark, path, root, per_batch)
    arrive(spark, path, rows(6, 14))
    follow(spark, path, root, per_batch)
    every = spark.createDataFrame(rows(0, 14), SCHEMA.replace("at timestamp", "at string"))
    every = every.withColumn("day", F.col("at").cast("date"))
    polls = every.where("mac is null").groupBy("stream", "day").agg(F.bool_and("live").alias("live"))
    for today in ("2024-03-04", "2024-03-08", "2024-03-12"):
        seen = every.where(F.col("mac").isNotNull() & (F.col("day") <= F.lit(today).cast("date")))
        last = seen.groupBy("stream", "l2_domain", "mac").agg(F.max("day").alias("day"))
        want = sources.presence(last, polls, today, MISSES, WINDOW, "mac")
        assert states(P.presence_as_of(spark, root, today, MISSES)) == states(want)
    assert {r[-1] for r in states(P.presence_as_of(spark, root, "2024-03-12", MISSES))} == {"present", "stale", "gone"}
