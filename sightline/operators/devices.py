"""Device-level linking.  The rules are our own design: only labels and prose say what is wanted.

A shared uplink port decides alone only where the port shows at most one host
name over the whole stream, because two names on a port mean shared hardware.
The scoped-key rule for different macs is never part of this vector: one device
has many macs, and that verdict would block every grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions.address import is_virtual_mac
from sightline.functions.facts import int_div, is_locally_administered, macs, once_per_row
from sightline.plans.lineage import cut
from sightline.plans.skew import lookup

# Device-level rule ids.
UPLINK_AGREES = "l2-uplink-agrees"
DIFFERENT_SWITCH = "l2-different-switch"
HOSTNAME_AGREES = "l2-hostname-agrees"
DIFFERENT_HOSTNAME = "l2-different-hostname"
VIRTUAL_PREFIX = "l2-virtual-mac-prefix"

# Reserved prefixes of virtual routers.
VIRTUAL_PREFIXES = {
    "vrrp": "00:00:5e:00:01:",
    "hsrp": "00:00:0c:07:ac:",
    "hsrp2": "00:00:0c:9f:f",
}


def names() -> Column:
    """Distinct non-empty host names of one sighting."""
    return F.array_remove(F.array_distinct(F.array_compact(F.col("facts.Hostname.name"))), "")


def _verdict(sides: DataFrame, rule: Column, verdict: Column) -> DataFrame:
    return sides.select(
        "low", "high", rule.alias("rule"), verdict.alias("verdict"),
        F.array("low", "high").alias("evidence"),
    )


def _sides(pairs: DataFrame, per_sighting: DataFrame) -> DataFrame:
    """Both sides' columns on each given pair, prefixed low_ and high_."""
    out = pairs.where("low < high").select("low", "high").distinct()
    for side in ("low", "high"):
        columns = [
            F.col(c).alias(side if c == "obs_id" else f"{side}_{c}") for c in per_sighting.columns
        ]
        out = out.join(per_sighting.select(*columns), side)
    return out


def hostname_verdicts(
    pairs: DataFrame, obs: DataFrame, agree: str = S.SUPPORTS, differ: str = S.OPPOSES
) -> DataFrame:
    """Names shared speak for a pair, different names against it; a missing name says nothing."""
    sides = _sides(pairs, obs.select("obs_id", once_per_row(names=names()))).where(
        "size(low_names) > 0 and size(high_names) > 0"
    )
    shared = F.arrays_overlap("low_names", "high_names")
    return _verdict(
        sides,
        F.when(shared, HOSTNAME_AGREES).otherwise(DIFFERENT_HOSTNAME),
        F.when(shared, agree).otherwise(differ),
    )


def uplinks(obs: DataFrame) -> DataFrame:
    """(obs_id, peer_mac, peer_port, names): the uplink each sighting stands behind."""
    return obs.select(
        "obs_id", names().alias("names"), F.explode("facts.Uplink").alias("u")
    ).where("u is not null").select("obs_id", "u.peer_mac", "u.peer_port", "names")


def port_names(obs: DataFrame) -> DataFrame:
    """Per uplink port: sightings behind it and distinct names seen there."""
    port = ["peer_mac", "peer_port"]
    behind = uplinks(obs)
    seen = behind.groupBy(*port).agg(F.count("*").alias("sightings"))
    named = (
        behind.select(*port, F.explode("names").alias("name"))
        .distinct()
        .groupBy(*port)
        .agg(F.count("*").alias("port_names"))
    )
    return seen.join(named, port, "left").select(
        *port, "sightings", F.coalesce("port_names", F.lit(0)).alias("port_names")
    )


def uplink_verdicts(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Same switch with one name at most behind the ports decides; other switches disqualify.

    Ports of one switch count together, so a host with two cables is one device
    and a port with two names, shared hardware, stays undecided.
    """
    port = ["peer_mac", "peer_port"]
    behind = lookup(
        uplinks(obs).drop("names"), port_names(obs), port, "sightings", "obs_id"
    ).select("obs_id", *port, "port_names")
    sides = _sides(pairs, behind)
    switch = F.col("low_peer_mac") == F.col("high_peer_mac")
    one_port = F.col("low_peer_port") == F.col("high_peer_port")
    named = F.when(one_port, F.col("low_port_names")).otherwise(
        F.col("low_port_names") + F.col("high_port_names")
    )
    verdict = (
        F.when(switch & (named <= 1), S.DECISIVE)
        .when(switch, S.NEUTRAL)
        .otherwise(S.DISQUALIFYING)
    )
    return _verdict(sides, F.when(switch, UPLINK_AGREES).otherwise(DIFFERENT_SWITCH), verdict)


def virtual_verdicts(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """A virtual mac on one side only disqualifies the pair: it anchors no device."""
    virtual = F.exists(macs(), is_virtual_mac)
    sides = _sides(pairs, obs.select("obs_id", virtual.alias("virtual")))
    found = sides.where("low_virtual <> high_virtual")
    return _verdict(found, F.lit(VIRTUAL_PREFIX), F.lit(S.DISQUALIFYING))


def l2_verdicts(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    return (
        hostname_verdicts(pairs, obs, S.DECISIVE, S.DISQUALIFYING)
        .unionByName(uplink_verdicts(pairs, obs))
        .unionByName(virtual_verdicts(pairs, obs))
    )


def mac_class(mac: Column) -> Column:
    """Virtual router family, else local or universal: read from the bytes, never inferred."""
    return F.coalesce(
        *[F.when(mac.startswith(p), F.lit(n)) for n, p in VIRTUAL_PREFIXES.items()],
        F.when(is_locally_administered(mac), F.lit("local")),
        F.lit("universal"),
    )


# ---------------------------------------------------------------- grouping


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of each distinct (a, b) edge."""
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    return both.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over the edges.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so long chains close in few rounds.  A round is checkpointed
    and the loop ends when no label changes; nodes with very many edges are
    salted.
    """
    links = cut(neighbours(edges))
    degrees = cut(links.groupBy("a").agg(F.count("*").alias("degree")))
    labels = degrees.select(F.col("a").alias("node"), F.col("a").alias("label"))
    while True:
        known = labels.select(F.col("node").alias("a"), "label")
        offered = (
            lookup(links, known, ["a"], "degree", "b", weights=degrees)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        nearer = labels.join(offered, "node", "left").select(
            "node", F.col("label").alias("before"), F.least("label", "offer").alias("label")
        )
        near = cut(nearer)
        sizes = near.groupBy("label").agg(F.count("*").alias("size"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lookup(near, jump, ["label"], "size", "node", how="left", weights=sizes)
        after = cut(
            jumped.select("node", "before", F.least("label", "further").alias("label"))
        )
        labels = after.select("node", "label")
        if after.where("label <> before").isEmpty():
            return labels


def interface_edges(obs: DataFrame) -> DataFrame:
    """What ties interfaces to devices: macs of one sighting, and names in one domain.

    Each sighting links its macs to its first one and to its names; a virtual
    mac anchors nothing.  The edges of a sighting are bounded by its own facts.
    """
    scoped = lambda x: F.concat_ws("/", F.col("l2_domain").cast("string"), x)
    own = F.filter(macs(), lambda m: ~is_virtual_mac(m))
    rows = obs.select("l2_domain", once_per_row(macs=own, names=names())).where("size(macs) > 0")
    first = scoped(F.col("macs")[0])
    others = rows.select(first.alias("a"), F.explode("macs").alias("m"), "l2_domain").select(
        "a", scoped(F.col("m")).alias("b")
    )
    named = rows.select(first.alias("a"), F.explode("names").alias("n"), "l2_domain").select(
        "a", F.concat(F.lit("name/"), scoped(F.col("n"))).alias("b")
    )
    return others.unionByName(named).distinct()


def devices(obs: DataFrame) -> DataFrame:
    """(l2_domain, mac, device): interfaces and the device they are grouped in."""
    edges = interface_edges(obs)
    lone = edges.select(F.col("a").alias("node")).unionByName(
        edges.where("not startswith(b, 'name/')").select(F.col("b").alias("node"))
    ).distinct()
    found = components(edges)
    return lone.join(found, "node", "left").select(
        F.substring_index("node", "/", 1).cast("int").alias("l2_domain"),
        F.substring_index("node", "/", -1).alias("mac"),
        F.coalesce("label", "node").alias("device"),
    )


def switches(obs: DataFrame) -> DataFrame:
    """(node, side): the switch behind which an interface was seen last, of those seen behind one."""
    own = F.filter(macs(), lambda m: ~is_virtual_mac(m))
    behind = F.array_compact(F.col("facts.Uplink.peer_mac"))
    rows = obs.select("obs_id", "observed_at", "l2_domain", once_per_row(macs=own, behind=behind)).where(
        "size(behind) > 0"
    )
    return (
        rows.select("*", F.explode("macs").alias("mac"))
        .groupBy(F.concat_ws("/", F.col("l2_domain").cast("string"), "mac").alias("node"))
        .agg(F.max_by(F.array_min("behind"), F.struct("observed_at", "obs_id")).alias("side"))
    )


def sided(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """(node, side): nodes take the side of the nearest one that has a side, the least of equally near ones.

    Walked breadth first from all of them at once.  Neighbours are at most one step apart in distance, so
    what a step reaches anew is told by the last two frontiers; earlier ones are neither read nor written.
    Nodes that reach no side are left out.
    """
    links = cut(neighbours(edges))
    degrees = cut(links.groupBy("a").agg(F.count("*").alias("degree")))
    frontier = cut(sides.select("node", "side"))
    before, parts = frontier.limit(0), [frontier]
    while True:
        offered = (
            lookup(links, frontier.withColumnRenamed("node", "a"), ["a"], "degree", "b", weights=degrees)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("side").alias("side"))
        )
        near = frontier.select("node").unionByName(before.select("node"))
        before, frontier = frontier, cut(offered.join(near, "node", "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)


def parted(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """(node, side, label): components after cutting every edge between different sides.

    Two nodes of different sides disqualify each other, so no component may hold both: each node goes with
    the nearest evidence, and edges stay inside a side.  Pairs are never listed.
    """
    found = cut(sided(edges, sides))
    links = cut(neighbours(edges))
    for end in ("a", "b"):
        own = found.select(F.col("node").alias(end), F.col("side").alias(f"{end}_side"))
        weights = links.groupBy(end).agg(F.count("*").alias("degree"))
        other = "b" if end == "a" else "a"
        links = lookup(links, own, [end], "degree", other, how="left", weights=weights)
    labels = components(links.where(F.col("a_side").eqNullSafe(F.col("b_side"))).select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return (
        nodes.distinct()
        .join(found, "node", "left")
        .join(labels, "node", "left")
        .select("node", "side", F.coalesce("label", "node").alias("label"))
    )


def parted_devices(obs: DataFrame) -> DataFrame:
    """(l2_domain, mac, switch, device): devices none of which was seen last behind two switches."""
    edges = cut(interface_edges(obs))
    return (
        parted(edges, switches(obs))
        .where("not startswith(node, 'name/')")
        .select(
            F.substring_index("node", "/", 1).cast("int").alias("l2_domain"),
            F.substring_index("node", "/", -1).alias("mac"),
            F.col("side").alias("switch"),
            F.col("label").alias("device"),
        )
    )


def borne(obs: DataFrame, grouped: DataFrame) -> DataFrame:
    """(l2_domain, virtual_mac, device): a virtual device is borne by any number of devices, and they by it.

    ``grouped`` is (l2_domain, mac, device).
    """
    own = grouped.select("l2_domain", F.col("mac").alias("bearer"), "device")
    return bearers(obs).join(own, ["l2_domain", "bearer"]).select(
        "l2_domain", "virtual_mac", "device"
    ).distinct()


def bearers(obs: DataFrame) -> DataFrame:
    """(l2_domain, virtual_mac, bearer): own macs sighted together with a virtual one."""
    each = obs.select("l2_domain", F.explode(macs()).alias("virtual_mac"), macs().alias("macs"))
    return (
        each.where(is_virtual_mac(F.col("virtual_mac")))
        .select("l2_domain", "virtual_mac", F.explode("macs").alias("bearer"))
        .where(~is_virtual_mac(F.col("bearer")))
        .distinct()
    )


# ---------------------------------------------------------------- graph walk and metrics


def impact(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): everything that depends on the start nodes, breadth first.

    ``edges`` is (src, dst): src depends on dst.  A visited set ends every cycle
    and there is no depth limit; the walk stops when a frontier is empty.  Start
    nodes are not listed.
    """
    back = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct())
    degrees = cut(back.groupBy("node").agg(F.count("*").alias("degree")))
    frontier = cut(start.select("node").distinct())
    visited = frontier.select("node", F.lit(0).alias("depth"))
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        reached = (
            lookup(back, frontier, ["node"], "degree", "next", weights=degrees)
            .select(F.col("next").alias("node"))
            .distinct()
            .join(visited.select("node"), "node", "left_anti")
        )
        frontier = cut(reached)
        visited = cut(visited.unionByName(frontier.select("node", F.lit(depth).alias("depth"))))
    return visited.where("depth > 0")


def cluster_metrics(assigned: DataFrame) -> DataFrame:
    """Contaminated clusters and pair precision and recall; ``assigned`` is (cluster, truth).

    Pairs are counted from group sizes and never listed.
    """
    def pairs(n: Column) -> Column:
        return F.sum(int_div(n * (n - 1), 2)).cast("bigint")

    cells = assigned.groupBy("cluster", "truth").agg(F.count("*").alias("n"))
    clusters = cells.groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("truths"))
    truths = cells.groupBy("truth").agg(F.sum("n").alias("n"))
    both = cells.agg(pairs(F.col("n"))).scalar()
    wanted = truths.agg(pairs(F.col("n"))).scalar()
    made = clusters.agg(
        F.count("*").alias("clusters"),
        F.sum(F.when(F.col("truths") > 1, 1).otherwise(0)).cast("bigint").alias("contaminated"),
        pairs(F.col("n")).alias("made_pairs"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, int_div(part * 1000, whole))

    return made.select(
        "*", wanted.alias("true_pairs"), both.alias("right_pairs")
    ).withColumns(
        {
            "precision_per_mille": share(F.col("right_pairs"), F.col("made_pairs")),
            "recall_per_mille": share(F.col("right_pairs"), F.col("true_pairs")),
        }
    )


def doubt(outcome: Column) -> Column:
    """How doubtful an outcome is: certain ones 0, an abstention 1."""
    return F.when(outcome == S.ABSTAINED, 1).otherwise(0)


def monotone(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, pairs, holds): losing a capability may only move towards doubt."""
    b = before.select("low", "high", F.col("outcome").alias("before"))
    a = after.select("low", "high", F.col("outcome").alias("after"))
    holds = (F.col("before") == F.col("after")) | (
        doubt(F.col("after")) > doubt(F.col("before"))
    )
    return (
        b.join(a, ["low", "high"])
        .groupBy("before", "after")
        .agg(F.count("*").alias("pairs"))
        .withColumn("holds", holds)
    )
