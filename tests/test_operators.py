"""Operators against small literal tables and brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.operators import devices, evaluate, keys, links, quality, robust, subnets, verdicts
from sightline.plans import ordering, skew
from sightline.sources import tables, wire
from sightline.streaming import ingest


def sightings(spark, rows):
    """rows: (obs_id, minute, domain, macs, ip, name, port)"""
    flat = spark.createDataFrame(
        rows, "obs_id string, m int, l2_domain string, macs array<string>, ip string, name string, port string"
    )
    c = F.col
    mac = F.transform(
        "macs",
        lambda m: tables.fact("Mac", m.alias("addr"), F.lit(True).alias("locally_administered")),
    )
    rest = tables.facts_where(
        (c("ip").isNotNull(), tables.fact("IpV4", c("ip").alias("addr"))),
        (
            c("name").isNotNull(),
            tables.fact("Hostname", c("name").alias("name"), F.lit("Dhcp").alias("source")),
        ),
        (
            c("port").isNotNull(),
            tables.fact(
                "Uplink",
                F.substring_index("port", "#", 1).alias("peer_mac"),
                F.substring_index("port", "#", -1).alias("peer_port"),
            ),
        ),
    )
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), c("m")
    )
    return flat.select(
        "obs_id", F.lit("src").alias("connector_id"), at.alias("observed_at"), "l2_domain",
        F.lit("v").alias("vantage"), F.concat(mac, rest).alias("facts"), F.lit(None).cast("string").alias("raw"),
    )


def on_key(spark, ids, mac="02:00:00:00:00:01"):
    return sightings(spark, [(i, n, "d", [mac], "10.0.0.1", None, None) for n, i in enumerate(ids)])


def counts(done):
    row = done.summary.collect()[0].asDict()
    return {k.removeprefix("links_"): v for k, v in row.items()}


def test_every_subset_of_verdicts(spark):
    kinds = [S.DISQUALIFYING, S.DECISIVE, S.SUPPORTS, S.OPPOSES, S.NEUTRAL]
    subsets = [c for n in range(6) for c in itertools.combinations(kinds, n)]
    rows = [(i, -i, f"rule-{v}", v) for i, s in enumerate(subsets) for v in s]
    said = spark.createDataFrame(rows, "low int, high int, rule string, verdict string")
    pairs = spark.createDataFrame([(i, -i) for i in range(32)], "low int, high int")
    got = verdicts.decide(said, pairs=pairs).groupBy("outcome", "cause").count().collect()
    assert {(r.outcome, r.cause): r["count"] for r in got} == {
        ("no_match", None): 16, ("match", None): 4, ("abstained", "ambiguous"): 8,
        ("abstained", "absence_of_proof"): 4,
    }


def test_decision_names_the_smallest_rule(spark):
    said = spark.createDataFrame(
        [(1, 2, "b", S.DECISIVE), (1, 2, "a", S.DECISIVE), (1, 2, "0", S.NEUTRAL)],
        "low int, high int, rule string, verdict string",
    )
    assert verdicts.decide(said).collect()[0].rule_id == "a"


def test_newcomers_rewrite_what_they_must(spark):
    first = on_key(spark, [f"b{i}" for i in range(6)])
    one = links.resolve(first, links.empty_interfaces(first), links.empty_links(first), "1", settle=True)
    assert counts(one)["written"] == 6 and counts(one)["interfaces_minted"] == 1
    larger = on_key(spark, [*(f"b{i}" for i in range(6)), "c0"])
    two = links.resolve(larger, one.interfaces, one.links, "2", settle=True)
    assert (counts(two)["written"], counts(two)["superseded"], counts(two)["unchanged"]) == (1, 0, 6)
    smallest = on_key(spark, [*(f"b{i}" for i in range(6)), "c0", "a0"])
    three = links.resolve(smallest, two.interfaces, two.links, "3", settle=True)
    assert (counts(three)["written"], counts(three)["superseded"], counts(three)["unchanged"]) == (8, 7, 0)
    assert three.links.count() == 15 and links.current(three.links).count() == 8
    again = links.resolve(smallest, three.interfaces, three.links, "4", settle=True)
    assert counts(again)["written"] == 0 and counts(again)["unchanged"] == 8
    assert counts(again)["interfaces_found"] == 1
    assert quality.link_constraints(three.links, smallest, three.interfaces).count() == 0


def test_three_hundred_keys(spark):
    obs = sightings(
        spark, [(f"{i:04d}", i, "d", [f"02:00:00:00:{i // 100:02d}:{i % 100:02d}"], None, None, None) for i in range(300)]
    )
    done = links.resolve(obs, links.empty_interfaces(obs), links.empty_links(obs), "1")
    got = counts(done)
    assert got["candidate_pairs"] == 44850
    assert (got["interfaces_minted"], got["written"], got["abstained"]) == (300, 300, 0)


def test_refusals(spark):
    obs = on_key(spark, ["a", "b"])
    none, no_links = links.empty_interfaces(obs), links.empty_links(obs)
    moved = obs.withColumn("observed_at", F.col("observed_at") + F.expr("interval 1 second"))
    with pytest.raises(links.Refused):
        links.resolve(obs.unionByName(moved), none, no_links, "x")
    assert links.contradictions(obs.unionByName(obs.withColumn("raw", F.lit("note")))).isEmpty()
    one = links.resolve(obs, none, no_links, "1", settle=True)
    owned = one.links.withColumn("decided_by", F.lit(S.OPERATOR))
    with pytest.raises(links.Refused):
        links.resolve(obs, one.interfaces, owned, "2")
    late = one.links.withColumn("valid_from", F.col("valid_from") + F.expr("interval 1 day"))
    more = on_key(spark, ["a", "b", "0"])
    with pytest.raises(links.Refused):
        links.resolve(more, one.interfaces, late, "2")
    aside = links.resolve(more, one.interfaces, late, "2", settle=True, set_late_aside=True)
    assert aside.late.count() == 2 and counts(aside)["written"] == 1


def test_heavy_keys_are_salted_and_nothing_changes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}") for i in range(600)]
    left = spark.createDataFrame(rows, "obs_id bigint, key string")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.min("obs_id").alias("low"))
    plain = sorted(tuple(r) for r in left.join(right, "key").select("obs_id", "key", "n", "low").collect())
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 20)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    got = skew.lookup(left, right, ["key"], "n", "obs_id").select("obs_id", "key", "n", "low")
    assert sorted(tuple(r) for r in got.collect()) == plain


def test_witness_is_the_smallest_other(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 5)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    rows = [(f"{i:03d}", i, "d", [f"02:00:00:00:00:0{i % 3}"] * 2, None, None, None) for i in range(40)]
    rows.append(("900", 1, "d", ["02:00:00:00:00:99"], None, None, None))
    members = keys.scoped_keys(sightings(spark, rows))
    group = {}
    for r in members.collect():
        group.setdefault(r.mac, []).append(r.obs_id)
    for r in keys.witnesses(members).collect():
        others = [i for i in group[r.mac] if i != r.obs_id]
        assert r.witness == (min(others) if others else r.obs_id)


def test_running_values_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 7)
    rng = random.Random(5)
    rows = [(s, q, rng.randrange(50) if rng.random() < 0.3 else None) for s in "ab" for q in range(60)]
    df = spark.createDataFrame(rows, "stream string, seq bigint, v bigint")
    last = ordering.running_last(df, ["stream"], "seq", F.col("v"), "x")
    prior = ordering.running_last(df, ["stream"], "seq", F.col("v"), "x", before=True)
    top = ordering.running_max(df, ["stream"], "seq", F.col("v"), "x")
    seen = ordering.running_count(df, ["stream"], "seq", F.col("v").isNotNull(), "x")
    by = {(s, q): v for s, q, v in rows}
    for frame, rule in (
        (last, lambda p, own: (p + own)[-1] if p + own else None),
        (prior, lambda p, own: p[-1] if p else None),
        (top, lambda p, own: max(p + own, default=None)),
        (seen, lambda p, own: len(p + own)),
    ):
        for r in frame.collect():
            past = [by[r.stream, q] for q in range(r.seq) if by[r.stream, q] is not None]
            own = [] if by[r.stream, r.seq] is None else [by[r.stream, r.seq]]
            assert r.x == rule(past, own)


def test_positions_are_dense(spark):
    rows = [(s, n * 3 + 1) for s, k in (("a", 900), ("b", 7)) for n in range(k)]
    df = spark.createDataFrame(rows, "stream string, at bigint").repartition(5)
    got = ordering.with_position(df, ["stream"], ["at"])
    assert all(r.at == r.seq * 3 + 1 for r in got.collect())


def test_subnet_hosts(spark):
    asked = ["192.0.2.5/30", "192.0.2.4/31", "192.0.2.9/32", "10.0.0.0/21", "10.0.0.0/33", "10.0.0/24", "x", "10.0.0.1/-1"]
    df = spark.createDataFrame([(a,) for a in asked], "cidr string")
    got = {}
    for r in subnets.subnet_hosts(df).collect():
        got.setdefault(r.cidr, []).append(r.host or r.error)
    assert got == {
        "192.0.2.5/30": ["192.0.2.5", "192.0.2.6"], "192.0.2.4/31": ["192.0.2.4", "192.0.2.5"],
        "192.0.2.9/32": ["192.0.2.9"], "10.0.0.0/21": ["too_large"], "10.0.0.0/33": ["prefix_exceeds_32"],
        "10.0.0/24": ["bad_address"], "x": ["no_prefix"], "10.0.0.1/-1": ["bad_prefix"],
    }
    wide = spark.createDataFrame([("172.16.4.9/22",)], "cidr string")
    assert subnets.subnet_hosts(wide).count() == 1022


def test_addresses_in_text(spark):
    text = "at 192.0.2.110.0.0.1, 10.1.2.3; 02-00-5e-10-00-01 and 33:33:ff:00:00:01 not 256.1.1.1 or 1192.0.2.1"
    df = spark.createDataFrame([("t", text)], "id string, text string")
    got = {(r.address, r.allowed) for r in quality.text_addresses(df).collect()}
    assert got == {
        ("192.0.2.110", True), ("10.1.2.3", False), ("02:00:5e:10:00:01", True),
        ("33:33:ff:00:00:01", False),
    }


OBS = {
    "obs_id": "a", "connector_id": "c", "observed_at": "2024-01-01T00:00:00.000000Z",
    "scope": {"l2_domain": "d", "vantage": "v"},
    "facts": [{"Mac": {"addr": [2, 0, 94, 16, 0, 255], "locally_administered": True}}, {"Rtt": {"millis": 7}}],
}


def line(**changes):
    return json.dumps({**OBS, **changes}, separators=(",", ":"))


def test_lines(spark, tmp_path):
    lines = [
        line(), "", " ", line(obs_id="b", scope={"l2_domain": "d", "vantage": "v", "x": 1}),
        line(obs_id="c", facts=[{"Mac": {"addr": [1], "locally_administered": True}}]),
        line(record="failure"), '{"record":"capability","as_of":"2024-01-01T00:00:00.000000Z","kinds":["Mac"]}',
        '{"record":"strange"}', "[1]", '{"record":"failure","error":"Timeout"}',
    ]
    (tmp_path / "poll.jsonl").write_text("\n".join(lines) + "\n")
    read = wire.read_lines(spark, str(tmp_path))
    assert [r.line for r in read.orderBy("seq").collect()] == lines
    shape = {r.seq: r.rule for r in quality.line_shape(read).collect()}
    assert shape == {2: "malformed", 3: "unknown_key", 4: "wrong_type", 5: "ambiguous", 7: "control_record", 8: "unrecognised"}
    good = read.where(F.col("seq").isin(0, 6, 9))
    assert quality.roundtrip(good).isEmpty()
    records = {r.seq: r for r in wire.parse_lines(good).collect()}
    assert records[0].facts[0].Mac.addr == "02:00:5e:10:00:ff"
    assert records[9].error_code == "Timeout" and records[6].kinds == ["Mac"]


def test_components_of_chain_and_star(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 10)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("s", f"t{i:02d}") for i in range(40)]
    got = {r.node: r.label for r in devices.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n00"} and got["t39"] == "s"


def test_impact_is_breadth_first_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in devices.impact(edges, start).collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_device_rules_on_the_labelled_shapes(spark):
    sw, other = "02:00:00:00:ff:01", "02:00:00:00:ff:02"
    rows = [
        ("h1", 0, "d", ["02:00:00:00:00:01"], None, "dock", f"{sw}#1"),
        ("h2", 5, "d", ["02:00:00:00:00:02"], None, None, f"{sw}#1"),
        ("v1", 0, "d", ["02:00:00:00:00:03"], None, "alpha", f"{other}#9"),
        ("v2", 0, "d", ["02:00:00:00:00:04"], None, "beta", f"{other}#9"),
        ("v3", 0, "d", ["02:00:00:00:00:05"], None, None, f"{other}#9"),
        ("w1", 0, "d", ["00:00:5e:00:01:07"], None, None, f"{sw}#1"),
        ("e1", 0, "d", ["02:00:00:00:00:06"], None, "", None),
        ("e2", 0, "d", ["02:00:00:00:00:07"], None, "", None),
    ]
    asked = [("h1", "h2"), ("v1", "v2"), ("v1", "v3"), ("h1", "v1"), ("h1", "w1"), ("e1", "e2")]
    pairs = spark.createDataFrame(asked, "low string, high string")
    said = devices.l2_verdicts(pairs, sightings(spark, rows))
    got = {(r.low, r.high): (r.outcome, r.rule_id) for r in verdicts.decide(said, pairs=pairs).collect()}
    assert got == {
        ("h1", "h2"): ("match", "l2-uplink-agrees"),
        ("v1", "v2"): ("no_match", "l2-different-hostname"),
        ("v1", "v3"): ("abstained", None),
        ("h1", "v1"): ("no_match", "l2-different-hostname"),
        ("h1", "w1"): ("no_match", "l2-virtual-mac-prefix"),
        ("e1", "e2"): ("abstained", None),
    }


def test_truth_table(spark):
    rows = [(e, o) for e in (S.MUST_MERGE, S.MUST_NOT_MERGE, S.MUST_ABSTAIN) for o in ("merged", "refused", "abstained")]
    df = spark.createDataFrame(rows, "e string, o string")
    got = df.select(evaluate.passes(F.col("e"), F.col("o")).alias("p")).collect()
    assert [r.p for r in got] == [True, False, False, False, True, True, False, False, True]


def test_a_repeat_beyond_the_allowed_is_unaccounted(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "claim string")
    b = spark.createDataFrame([("x",), ("y",), ("y",)], "claim string")
    assert [r.claim for r in robust.unaccounted(a, b).collect()] == ["x"]


def test_polls_land_in_two_runs(spark, tmp_path):
    source, root = tmp_path / "polls", str(tmp_path / "store")
    source.mkdir()
    (source / "1.jsonl").write_text("\n".join([line(), line(obs_id="b"), "{broken"]) + "\n")
    ingest.ingest(spark, str(source), root).awaitTermination()
    (source / "2.jsonl").write_text("\n".join([line(), line(obs_id="c")]) + "\n")
    ingest.ingest(spark, str(source), root).awaitTermination()
    table = ingest.read_links(spark, root)
    assert sorted(r.observation_id for r in table.collect()) == ["a", "b", "c"]
    assert ingest.read_interfaces(spark, root).count() == 1
    assert [r.rule for r in spark.read.parquet(f"{root}/quarantine").collect()] == ["malformed"]
