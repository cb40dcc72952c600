"""Fingerprints of multisets and the daily rollup, against counting and the one-pass history."""

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.operators import sources
from sightline.plans import multiset as M
from sightline.sources import rollup as R
from sightline.sources import tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, at string, parts array<string>").withColumn(
        "at", F.col("at").cast("timestamp_ntz")
    )


def test_planted_differences_are_counted(spark):
    rng = random.Random(2)
    pool = [(i % 40, rng.choice([None, "", "x"]), f"2024-01-01 00:00:00.{i:06d}", [None, "a"][: i % 3]) for i in range(300)]
    rows = pool + pool[:50]
    mixed = rows[:]
    rng.shuffle(mixed)
    one, two = frame(spark, rows), frame(spark, mixed).select("parts", "at", "name", "id").repartition(5)
    assert M.unequal(one, two) == ([], 350)
    assert M.fingerprint(one).collect() == M.fingerprint(two).collect()
    changed = mixed[3:] + [mixed[9], (1, None, "2024-01-01 00:00:00.000001", [])]
    a, b = (Counter((*r[:3], tuple(r[3])) for r in side) for side in (rows, changed))
    got = M.compared(one, frame(spark, changed)).first()
    assert tuple(got) == (sum((a - b).values()), sum((b - a).values()), len(changed))
    # A repeat more is a difference, and so is a null for an empty text.
    assert M.unequal(one, one.union(one.limit(1)))[0]
    assert M.fingerprint(frame(spark, [(1, None, None, None)])).first() != M.fingerprint(frame(spark, [(1, "", None, None)])).first()
    empty = one.where("false")
    assert M.fingerprint(empty).first() == (0, "0" * 64) and tuple(M.compared(empty, empty).first()) == (0, 0, 0)
    by = {r.id: r.rows for r in M.fingerprint(one, "id").collect()}
    assert by == Counter(r[0] for r in rows)


def test_history_outlives_its_days(spark, tmp_path):
    root = str(tmp_path / "rollup")
    obs = tables.sightings(spark, "/root/testdata/sf0.001").select("observed_at", "facts").cache()
    R.roll(obs.where("observed_at < '2024-01-12'"), root)
    R.roll(obs.where("observed_at >= '2024-01-10'"), root)
    want = M.fingerprint(sources.address_history(obs)).first()
    assert M.fingerprint(R.history(spark, root)).first() == want
    for cutoff in ("2024-01-08", "2024-01-15", "2024-01-15"):
        R.fold(spark, root, cutoff)
        assert M.fingerprint(R.history(spark, root)).first() == want
    for day in range(1, 15):
        shutil.rmtree(f"{root}/days/day=2024-01-{day:02d}")
    shutil.rmtree(f"{root}/base/before=2024-01-08")
    assert M.fingerprint(R.history(spark, root)).first() == want
    with pytest.raises(ValueError):
        R.fold(spark, root, "2024-01-10")
