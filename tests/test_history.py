"""Capability lattice and point-in-time history against brute force."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.catalog.linking import pairs_of
from sightline.operators import devices as D
from sightline.operators import history as H
from sightline.operators import lattice as L
from sightline.operators import sources as P
from sightline.operators import verdicts as V
from sightline.plans import ordering
from sightline.sources import tables

SMALL = "/root/testdata/sf0.001"
HEARD = ["Mac", "Hostname", "Uplink"]


def blind(obs, mask):
    """Sightings in which only the kinds of the mask are left."""
    lost = [k for k in S.FACT_KINDS if not mask & L.mask_of([k])]
    kept = F.filter("facts", lambda f: reduce(Column.__and__, [f[k].isNull() for k in lost], F.lit(True)))
    return obs.withColumn("facts", kept)


def bit_at(found, mask):
    """{pair: outcome} that the bitmaps tell for one mask."""
    word, place = divmod(mask, L.WORD)
    out = {}
    for r in found:
        for outcome in (S.MATCH, S.NO_MATCH):
            if r[f"{outcome}{word}"] >> place & 1:
                out[r.low, r.high] = outcome
    return out


def test_bitmaps_tell_what_masked_sightings_decide(spark):
    obs = tables.sightings(spark, SMALL).where("obs_id < 160").cache()
    asked = pairs_of(tables.labelled_pairs(spark, SMALL)).where("high < 160").cache()
    rules = {
        "interface": (
            lambda o: V.decide(V.l1_verdicts(V.pair_sides(asked, o)).unionByName(D.hostname_verdicts(asked, o))),
            L.interface_verdicts,
        ),
        "device": (lambda o: V.decide(D.l2_verdicts(asked, o)), L.device_verdicts),
    }
    every = L.mask_of(S.FACT_KINDS)
    for decided, verdicts in rules.values():
        found = L.outcomes(verdicts(asked, obs)).collect()
        told = {}
        for bits in range(1 << len(HEARD)):
            lost = [k for i, k in enumerate(HEARD) if not bits >> i & 1]
            mask = every & ~L.mask_of(lost)
            rows = decided(blind(obs, mask)).where("outcome <> 'abstained'").collect()
            told[mask] = {(r.low, r.high): r.outcome for r in rows}
            assert told[mask] == bit_at(found, mask), (lost, mask)
            # No rule reads the other kinds, so every mask of the same three tells the same.
            for spare in (0, L.mask_of(["IpV4"]), L.mask_of(["Rtt", "OuiVendor"])):
                assert bit_at(found, L.mask_of(HEARD) & mask | spare) == told[mask]
        lost = {(r.low, r.high, r.lost): r.edges for r in L.violations(L.outcomes(verdicts(asked, obs))).collect()}
        want = {}
        for mask, kind in ((m, k) for m in told for k in HEARD if m & L.mask_of([k])):
            for pair, outcome in told[mask & ~L.mask_of([kind])].items():
                if told[mask].get(pair) != outcome:
                    key = (*pair, kind)
                    want[key] = want.get(key, 0) + (1 << len(S.FACT_KINDS) - len(HEARD))
        assert lost == want


ROWS = "l2_domain int, mac string, obs_id long, observed_at int, ipv4 string, hostname string"


def test_stretches_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 7)
    seen = [
        (1, "m", i, i // 3, None if i % 50 < 20 else f"10.0.0.{i // 13 % 2}", "h" if i < 150 else None)
        for i in range(300)
    ] + [(2, "m", 900, 5, "10.0.0.9", ""), (3, "n", 901, 5, None, None), (3, "n", 902, 5, None, None)]
    df = spark.createDataFrame(seen, ROWS).repartition(5)
    got = H.stretches(df, H.KEY, ["observed_at", "obs_id"], ["ipv4", "hostname"])
    want = set()
    for key, rows in groupby(sorted(seen, key=lambda r: (r[0], r[1], r[3], r[2])), key=lambda r: r[:2]):
        runs = [(worn, list(g)) for worn, g in groupby(rows, key=lambda r: r[4:])]
        for n, (worn, run) in enumerate(runs):
            until = runs[n + 1][1][0][3] if n + 1 < len(runs) else None
            want.add((*key, n + 1, *worn, run[0][3], run[-1][3], len(run), until))
    columns = ["l2_domain", "mac", "stretch", "ipv4", "hostname", "first_seen_at", "last_seen_at", "sightings", "until"]
    rows = got.select(*columns).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert H.stretches(df.where("false"), H.KEY, ["observed_at", "obs_id"], ["ipv4"]).count() == 0


def test_versions_fall_into_the_stretch_begun_last(spark):
    history = spark.createDataFrame(
        [(1, "m", 1, 10), (1, "m", 2, 20), (1, "m", 3, 20), (1, "m", 4, 30), (2, "m", 1, 15)],
        "l2_domain int, mac string, stretch long, first_seen_at int",
    )
    versions = spark.createDataFrame(
        [(1, "m", "a", 10, True), (1, "m", "b", 19, False), (1, "m", "c", 20, True), (1, "m", "d", 99, False),
         (1, "m", "e", 5, True), (2, "m", "f", 20, False), (9, "m", "g", 20, False)],
        "l2_domain int, mac string, link_id string, valid_from int, ended boolean",
    )
    rows = H.with_versions(history, versions).collect()
    assert {(r.l2_domain, r.stretch): (r.versions, r.ended) for r in rows} == {
        (1, 1): (2, 1), (1, 2): (0, 0), (1, 3): (1, 1), (1, 4): (1, 0), (2, 1): (1, 0),
    }


def test_adjacent_equal_decisions_are_one_interval(spark):
    made = [
        # sighting 1: same decision twice, then another, then the first again; sighting 2: a gap between.
        ("v1", 1, "i", "match", "r", 0, 5), ("v2", 1, "i", "match", "r", 5, 9), ("v3", 1, "i", "no_match", "r", 9, 12),
        ("v4", 1, "i", "match", "r", 12, 99), ("v5", 2, None, "abstained", None, 0, 3),
        ("v6", 2, None, "abstained", None, 4, 99), ("v7", 2, "i", "match", "r", 3, 4),
    ]
    links = spark.createDataFrame(
        made, "link_id string, observation_id long, interface_id string, outcome string, rule_id string, "
        "valid_from int, valid_to int",
    ).withColumns({"abstention_cause": F.lit(None).cast("string"), "decided_by": F.lit("ENGINE")})
    got = H.decision_history(links).select("observation_id", "outcome", "valid_from", "valid_to", "versions").collect()
    assert sorted(map(tuple, got)) == [
        (1, "match", 0, 9, 2), (1, "match", 12, 99, 1), (1, "no_match", 9, 12, 1),
        (2, "abstained", 0, 3, 1), (2, "abstained", 4, 99, 1), (2, "match", 3, 4, 1),
    ]


def test_records_by_any_term(spark):
    history = spark.createDataFrame(
        [(1, "m", 1, "10.0.0.1", "Web", 1, 2, 4, 4, 1), (1, "m", 2, "10.0.0.2", None, 3, 4, 2, 2, 0),
         (2, "n", 1, "10.0.0.1", "", 1, 9, 7, 7, 0)],
        "l2_domain int, mac string, stretch long, ipv4 string, hostname string, first_seen_at int, "
        "last_seen_at int, sightings long, versions long, ended long",
    )
    terms = spark.createDataFrame([("web",), ("WEB",), ("10.0.0.1",), ("m",), ("",), (None,), ("nobody",)], "term string")
    hosted = spark.createDataFrame([("m", 3)], "mac string, instances long")
    rows = H.records(history, terms, hosted).collect()
    assert sorted((r.term, r.mac, r.stretches, r.sightings, r.ipv4, r.instances) for r in rows) == [
        ("10.0.0.1", "m", 2, 6, "10.0.0.2", 3), ("10.0.0.1", "n", 1, 7, "10.0.0.1", 0),
        ("m", "m", 2, 6, "10.0.0.2", 3), ("web", "m", 2, 6, "10.0.0.2", 3),
    ]


def test_source_view_of_refused_missing_and_silent_sources(spark):
    sources = spark.createDataFrame(
        [("a", "c", 1, 0, "10.0.0.0/24", ["Mac", "Rtt"]), ("b", "c", 1, 1, "nonsense", None),
         ("c", "c", 1, 2, None, ["Mac"]), ("d", "x", None, 0, "10.0.0.0/8", [])],
        "source string, connector_id string, l2_domain int, vantage int, cidr string, kinds array<string>",
    )
    obs = spark.sql("""select 'c' as connector_id, 1 as l2_domain, v as vantage, at as observed_at from values
        (0, timestamp_ntz'2024-01-31 22:00:00'), (0, timestamp_ntz'2024-01-01 00:00:00'),
        (1, timestamp_ntz'2024-02-02 00:00:00') as t(v, at)""")
    rows = {r.source: r for r in P.source_view(sources, obs, "2024-02-01 00:00:00").collect()}
    assert {n: (r.refused, r.age_unit, r.age) for n, r in rows.items()} == {
        "a": (False, "hours", 2), "b": (True, "ahead", None), "d": (True, None, None),
    }
    assert rows["a"].observes == ["Mac", "Rtt"] and rows["b"].observes == []
    assert rows["b"].cannot_see == rows["d"].cannot_see == S.FACT_KINDS


def test_runs_and_versions_over_many_slices(spark, monkeypatch):
    seen = [
        (1, "m", i, i // 3, None if i % 50 < 20 else f"10.0.0.{i // 13 % 2}", "h" if i < 150 else None)
        for i in range(300)
    ] + [(2, "m", 900, 5, "10.0.0.9", ""), (3, "n", 901, 5, None, None), (3, "n", 902, 5, None, None)]
    # Before the first row, at its instant, behind the last, of one instant by the dozen, and of no interface seen.
    begun = [(1, "m", 1000 + i, i % 120 - 5, i % 3 == 0) for i in range(240)] + [
        (1, "m", 5000 + i, 50, True) for i in range(40)
    ] + [(2, "m", 9000, 4, True), (2, "m", 9001, 5, False), (3, "n", 9002, 7, True), (9, "z", 9003, 7, True)]
    df = spark.createDataFrame(seen, ROWS).repartition(5)
    versions = spark.createDataFrame(
        begun, "l2_domain int, mac string, obs_id long, observed_at int, ended boolean"
    ).repartition(3)
    want = set()
    for key, rows in groupby(sorted(seen, key=lambda r: (r[0], r[1], r[3], r[2])), key=lambda r: r[:2]):
        runs = [(worn, list(g)) for worn, g in groupby(rows, key=lambda r: r[4:])]
        starts = [run[0][3] for _, run in runs]
        fell = [(sum(s <= v[3] for s in starts), v[4]) for v in begun if v[:2] == key]
        for n, (worn, run) in enumerate(runs, 1):
            of = [ended for stretch, ended in fell if stretch == n]
            until = starts[n] if n < len(runs) else None
            want.add((*key, n, *worn, run[0][3], run[-1][3], len(run), until, len(of), sum(of)))
    columns = ["l2_domain", "mac", "stretch", "ipv4", "hostname", "first_seen_at", "last_seen_at", "sightings", "until",
               "versions", "ended"]
    for slices in (None, 2, 97):
        monkeypatch.setattr(H, "SLICES", slices)
        got = H.stretches(df, H.KEY, ["observed_at", "obs_id"], ["ipv4", "hostname"], versions).select(*columns).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, slices
        bare = H.stretches(df, H.KEY, ["observed_at", "obs_id"], ["ipv4", "hostname"]).select(*columns[:-2]).collect()
        assert {tuple(r) for r in bare} == {w[:-2] for w in want}, slices


def test_history_reads_the_sightings_once(spark, monkeypatch):
    import __spark_entry__ as entry

    read, given = spark.sparkContext.accumulator(0), tables.sightings

    def counted(_):
        read.add(1)
        return True

    tell = F.udf(counted, "boolean")
    monkeypatch.setattr(tables, "sightings", lambda spark, sf_dir: given(spark, sf_dir).where(tell("obs_id")))
    entry.queries()["b_address_history"](spark, SMALL).write.format("noop").mode("overwrite").save()
    assert read.value == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_versions_are_those_of_the_link_table(spark):
    from sightline.catalog.linking import passes, second_pass

    _, _, done = second_pass(spark, SMALL)
    want = H.versions_of(done.links, done.interfaces).groupBy(*H.KEY, "valid_from", "ended").count()
    lazy = passes(H.narrow(tables.sightings(spark, SMALL)))
    got = H.versions_met(lazy.actions, lazy.interfaces).groupBy(*H.KEY, "valid_from", "ended").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("ended").count() > 0
