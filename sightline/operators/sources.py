"""What is known about sources and interfaces over time.

These operators follow written specifications; no engine code exists for them
in the work they describe.  ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions.address import ipv4_to_long
from sightline.functions.facts import (
    addresses,
    age_bucket,
    declarable_field,
    declarable_value,
    int_div,
    is_blinding,
    is_locally_administered,
    macs,
)
from sightline.operators import gaps as G
from sightline.operators.triage import instant
from sightline.operators.subnets import cidr_parts, in_ranges
from sightline.plans.skew import lookup


def source_state(feed: DataFrame) -> DataFrame:
    """Per (stream, scope): liveness and capability, two independent axes.

    A stream is blind while its last word is a blinding failure.  Full, degraded
    and offline are derived for display and never stored.
    """
    seen = F.col("record") == "observation"
    failed = (F.col("record") == "failure") & is_blinding(F.col("error_code"))
    word = F.when(
        seen | failed, F.struct("seq", F.when(failed, F.col("error_code")).alias("cause"))
    )
    told = F.when(F.col("record") == "capability", F.struct("seq", "kinds"))
    streams = feed.groupBy("stream").agg(F.max(word).alias("word"), F.max(told).alias("told"))
    scopes = (
        feed.where(seen)
        .groupBy("stream", "l2_domain", "vantage")
        .agg(F.max("observed_at").alias("last_ok"))
    )
    live = F.col("word.cause").isNull()
    full = F.col("told").isNull() | (F.size("told.kinds") == len(S.FACT_KINDS))
    return scopes.join(streams, "stream").select(
        "stream",
        "l2_domain",
        "vantage",
        "last_ok",
        F.when(live, "live").otherwise("blind").alias("liveness"),
        F.col("word.cause").alias("cause"),
        F.when(full, "full").otherwise("reduced").alias("capability"),
        F.when(~live, "offline").when(full, "full").otherwise("degraded").alias("shown"),
    )


FIELD_KIND = {"ipv4": "IpV4", "hostname": "Hostname", "mac": "Mac"}


def kind_of_field(field: Column) -> Column:
    return F.coalesce(*[F.when(field == f, F.lit(k)) for f, k in FIELD_KIND.items()])


def unsuppressed_gaps(gaps: DataFrame, sources: DataFrame) -> DataFrame:
    """Gaps of live sources that can see the field.

    ``gaps`` names the stream each was seen by; ``sources`` is one row
    (stream, live, kinds) per stream.
    """
    weights = gaps.groupBy("stream").agg(F.count("*").alias("_n"))
    return (
        lookup(gaps, sources, ["stream"], "_n", "entity_id", weights=weights)
        .where(F.col("live") & F.array_contains("kinds", kind_of_field(F.col("field"))))
        .select(*gaps.columns)
    )


def presence(
    last_seen: DataFrame, polls: DataFrame, today: str, misses: int, window: int, spread_on: str
) -> DataFrame:
    """present, stale or gone: gone only after ``misses`` live polls without a sighting.

    ``last_seen`` is (stream, …, day); ``polls`` one row (stream, day, live) per
    poll day.  Only live days of the last ``window`` days count, so absence of
    proof is never proof of absence.
    """
    now = F.lit(today).cast("date")
    start = F.date_sub(now, window)
    upto = Window.partitionBy("stream").orderBy("day")
    inside = F.col("live") & (F.col("day") > start) & (F.col("day") <= now)
    running = polls.select(
        "stream",
        "day",
        F.sum(F.when(inside, 1).otherwise(0)).over(upto).cast("bigint").alias("_upto"),
        F.sum(F.when(inside, 1).otherwise(0))
        .over(Window.partitionBy("stream")).cast("bigint").alias("_all"),
    )
    missed = F.col("_all") - F.col("_upto")
    weights = last_seen.groupBy("stream", "day").agg(F.count("*").alias("_n"))
    return (
        lookup(last_seen, running, ["stream", "day"], "_n", spread_on, weights=weights)
        .withColumn("missed", missed)
        .withColumn(
            "state",
            F.when(F.col("missed") >= misses, "gone")
            .when(F.col("missed") > 0, "stale")
            .otherwise("present"),
        )
        .drop("_upto", "_all")
    )


def check_windows(dormancy_days: int, retention_days: int) -> None:
    """Dormancy must be shorter than retention, or a decision could lose its evidence."""
    if dormancy_days >= retention_days:
        raise ValueError(
            f"dormancy window ({dormancy_days} d) must be below retention ({retention_days} d)"
        )


def dormancy(
    interfaces: DataFrame,
    exempt: DataFrame,
    now: str,
    dormancy_days: int = 30,
    retention_days: int = 90,
) -> DataFrame:
    """Each interface active or dormant; reversible, since it only reads the last sighting.

    Only locally administered macs go dormant, and never one an operator grouped
    (``exempt``: l2_domain, mac).
    """
    check_windows(dormancy_days, retention_days)
    since = instant(now) - F.make_dt_interval(F.lit(dormancy_days))
    held = exempt.select("l2_domain", "mac", F.lit(True).alias("_held")).distinct()
    quiet = (
        is_locally_administered(F.col("mac"))
        & (F.col("last_seen_at") < since)
        & F.col("_held").isNull()
    )
    return interfaces.join(held, ["l2_domain", "mac"], "left").select(
        *interfaces.columns, F.when(quiet, "dormant").otherwise("active").alias("state")
    )


def retained(obs: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Sightings inside the retention window; a date filter that prunes files."""
    return obs.where(F.col("observed_at") >= instant(now) - F.make_dt_interval(F.lit(days)))


def address_history(obs: DataFrame) -> DataFrame:
    """The rollup kept for ever: first and last time an address went with a mac."""
    return (
        obs.select(
            "observed_at", F.explode(addresses()).alias("ipv4"), macs().alias("macs")
        )
        .select("observed_at", "ipv4", F.explode("macs").alias("mac"))
        .groupBy("ipv4", "mac")
        .agg(
            F.min("observed_at").alias("first_seen_at"),
            F.max("observed_at").alias("last_seen_at"),
            F.count("*").alias("sightings"),
        )
    )


def ip_conflicts(obs: DataFrame) -> DataFrame:
    """Addresses carried by two or more scoped keys: (ipv4, keys)."""
    rows = obs.select("l2_domain", F.explode(addresses()).alias("ipv4"), macs().alias("macs"))
    return (
        rows.select("ipv4", "l2_domain", F.explode("macs").alias("mac"))
        .distinct()
        .groupBy("ipv4")
        .agg(F.count("*").alias("keys"))
        .where("keys > 1")
    )


def static_in_dhcp(declared: DataFrame, ranges: DataFrame) -> DataFrame:
    """Declared addresses inside a DHCP range; ``ranges`` is (range_id, low, high) as BIGINT."""
    own = G.identities(declared).withColumn("_n", ipv4_to_long(F.col("ipv4")))
    return in_ranges(own, ranges, "_n", "entity_id").select("entity_id", "ipv4", "range_id")


def alerts(declared: DataFrame, obs: DataFrame, now: str, days: int) -> DataFrame:
    """(kind, ipv4): unknown devices, documented addresses unseen for N days, ip conflicts."""
    since = instant(now) - F.make_dt_interval(F.lit(days))
    new = G.unclaimed(declared, obs).select(F.lit("unknown_device").alias("kind"), "ipv4")
    newest = G.newest_by_address(obs).select("ipv4", "observed_at")
    unseen = (
        G.identities(declared)
        .select("ipv4")
        .distinct()
        .join(newest, "ipv4", "left")
        .where(F.col("observed_at").isNull() | (F.col("observed_at") < since))
        .select(F.lit("unseen").alias("kind"), "ipv4")
    )
    clash = ip_conflicts(obs).select(F.lit("ip_conflict").alias("kind"), "ipv4")
    return new.unionByName(unseen).unionByName(clash)


def source_disagreement(obs: DataFrame, capable: DataFrame) -> DataFrame:
    """(ipv4, field, sources, n_values) on which two capable sources differ.

    ``capable`` is (connector_id, kinds).  With two values and two sources some
    two sources must differ, so counts are enough.
    """
    rows = obs.select(
        "connector_id", F.explode(addresses()).alias("ipv4"), "facts"
    ).select("connector_id", "ipv4", F.explode("facts").alias("f"))
    told = rows.select(
        "connector_id", "ipv4",
        declarable_field(F.col("f")).alias("field"), declarable_value(F.col("f")).alias("value"),
    ).where("field is not null").distinct()
    able = capable.select("connector_id", F.explode("kinds").alias("kind"))
    weights = told.groupBy("connector_id").agg(F.count("*").alias("_n"))
    seen = lookup(
        told.withColumn("kind", kind_of_field(F.col("field"))),
        able.groupBy("connector_id").agg(F.collect_set("kind").alias("kinds")),
        ["connector_id"], "_n", "value", weights=weights,
    ).where(F.array_contains("kinds", F.col("kind")))
    values = seen.select("ipv4", "field", "value").distinct().groupBy("ipv4", "field").agg(
        F.count("*").alias("n_values")
    )
    sources = seen.select("ipv4", "field", "connector_id").distinct().groupBy(
        "ipv4", "field"
    ).agg(F.count("*").alias("sources"))
    return values.join(sources, ["ipv4", "field"]).where("n_values > 1 and sources > 1")


def surfaced(gaps: DataFrame, decided: DataFrame) -> DataFrame:
    """Gaps to show again: the observed value changed since the last decision on the field.

    ``decided`` is (entity_id, field, observed, disposition, decided_at).
    """
    last = decided.groupBy("entity_id", "field").agg(
        F.max(F.struct("decided_at", F.sha2("observed", 256).alias("digest"), "disposition")).alias("d")
    )
    same = F.coalesce(F.col("d.digest") == F.sha2("observed", 256), F.lit(False))
    keep = F.coalesce(F.col("d.disposition") == "AlwaysKeepMine", F.lit(False))
    return (
        gaps.join(last, ["entity_id", "field"], "left").where(~same & ~keep).select(*gaps.columns)
    )


def regime(before: DataFrame, after: DataFrame) -> DataFrame:
    """bootstrap, steady or migration, from two comparisons of the declared fields.

    Coverage is the share of fields that had received a question; churn the
    share of those whose observed value moved.  Both in per-mille.
    """
    asked = F.col("b_status") != S.NO_VALUE
    moved = asked & ~F.col("b_observed").eqNullSafe(F.col("observed"))
    both = after.join(
        before.select(
            "entity_id", "attr_key", F.col("status").alias("b_status"),
            F.col("observed").alias("b_observed"),
        ),
        ["entity_id", "attr_key"],
    )
    counted = both.agg(
        F.count("*").alias("fields"),
        F.coalesce(F.sum(F.when(asked, 1)), F.lit(0)).cast("bigint").alias("asked"),
        F.coalesce(F.sum(F.when(moved, 1)), F.lit(0)).cast("bigint").alias("moved"),
    )
    coverage = F.when(F.col("fields") > 0, int_div(F.col("asked") * 1000, F.col("fields")))
    churn = F.when(F.col("asked") > 0, int_div(F.col("moved") * 1000, F.col("asked")))
    return counted.select(
        "fields",
        coverage.alias("coverage_per_mille"),
        churn.alias("churn_per_mille"),
        # Exact form of coverage >= 0.80 and churn <= 0.02.
        F.when(F.col("asked") * 100 < F.col("fields") * 80, "bootstrap")
        .when(F.col("moved") * 100 <= F.col("asked") * 2, "steady")
        .otherwise("migration")
        .alias("regime"),
    )


def changes_since(links: DataFrame, at: str) -> DataFrame:
    """Link versions opened or closed since an instant."""
    since = instant(at)
    opened, closed = F.col("valid_from") >= since, F.col("valid_to") >= since
    ended = closed & F.col("current_subject").isNull()
    return links.where(opened | ended).select(
        "observation_id",
        "interface_id",
        "outcome",
        F.when(ended & opened, "replaced").when(ended, "closed").otherwise("opened").alias("change"),
    )


def search(obs: DataFrame, term: str) -> DataFrame:
    """Records an ip, a mac or a name belongs to, with how often and when each was seen."""
    hit = (
        F.array_contains(addresses(), term)
        | F.array_contains(macs(), term.lower())
        | F.array_contains(F.array_compact(F.col("facts.Hostname.name")), term)
    )
    first = lambda a: F.get(a, F.lit(0))
    return (
        obs.where(hit)
        .groupBy(
            "l2_domain",
            first(addresses()).alias("ipv4"),
            first(macs()).alias("mac"),
            first(F.array_compact(F.col("facts.Hostname.name"))).alias("hostname"),
        )
        .agg(
            F.count("*").alias("sightings"),
            F.min("observed_at").alias("first_seen_at"),
            F.max("observed_at").alias("last_seen_at"),
        )
    )


def hosted(instances: DataFrame, applications: DataFrame) -> DataFrame:
    """What runs on each device: one containment hop, with owner, criticality and version lag.

    ``instances`` is (device_id, software, version); ``applications`` one row
    (software, application, owner, criticality) per software.
    """
    newest = instances.groupBy("software").agg(
        F.max("version").alias("newest"), F.count("*").alias("_n")
    )
    about = newest.join(applications, "software", "left")
    rows = lookup(instances, about, ["software"], "_n", "device_id")
    return rows.groupBy("device_id", "application", "owner", "criticality").agg(
        F.count("*").alias("instances"),
        F.sum(F.when(F.col("version") < F.col("newest"), 1).otherwise(0))
        .cast("bigint")
        .alias("behind"),
    )


def source_view(sources: DataFrame, obs: DataFrame, now: str) -> DataFrame:
    """What each configured source is built to see, over which perimeter, and how long ago it saw anything.

    ``sources`` is (source, connector_id, l2_domain, vantage, cidr, kinds).  Without a cidr there is no
    source; a cidr that does not expand is shown as refused, never as one in force.  ``kinds`` is what
    the source declares, not what was seen: the other kinds of the closed list it cannot see.  A source
    that saw nothing yet has no age.
    """
    scope = ["connector_id", "l2_domain", "vantage"]
    last = obs.groupBy(*scope).agg(F.max("observed_at").alias("_last"))
    told = cidr_parts(sources.where("cidr is not null")).join(last, scope, "left")
    every = F.array(*map(F.lit, S.FACT_KINDS))
    able = F.coalesce("kinds", F.array().cast("array<string>"))
    age = age_bucket(instant(now), F.col("_last"))
    return told.select(
        "source",
        F.col("cidr").alias("perimeter"),
        F.col("error").isNotNull().alias("refused"),
        F.filter(every, lambda k: F.array_contains(able, k)).alias("observes"),
        F.filter(every, lambda k: ~F.array_contains(able, k)).alias("cannot_see"),
        F.when(F.col("_last").isNotNull(), age["unit"]).alias("age_unit"),
        F.when(F.col("_last").isNotNull(), age["n"]).alias("age"),
    )
