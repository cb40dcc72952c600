"""Degrading a feed on purpose, and checking what a degraded run may claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.facts import kind_of
from sightline.plans.skew import lookup
from sightline.schemas import FACT_KINDS

CUT_CODE = "Unreachable"


def stream_lengths(feed: DataFrame) -> DataFrame:
    return feed.groupBy("stream").agg(F.count("*").alias("n"))


def _placed(feed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with their stream's cut ``k``, clipped to its length; positions must be dense."""
    at = (
        cuts.select("stream", F.col("k").alias("_k"))
        .join(stream_lengths(feed), "stream")
        .select("stream", "n", F.least("_k", "n").alias("k"))
    )
    return lookup(feed, at, ["stream"], "n", "seq")


def prefix(feed: DataFrame, cuts: DataFrame) -> DataFrame:
    """The first k records of each stream; ``cuts`` is (stream, k)."""
    return _placed(feed, cuts).where("seq < k").select(*feed.columns)


def _inserted(feed: DataFrame, cuts: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One control record per stream at its clipped cut."""
    at = cuts.join(stream_lengths(feed), "stream").withColumn("seq", F.least("k", "n"))
    return at.select(
        *[
            values.get(f.name, F.col(f.name) if f.name in ("stream", "seq") else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in feed.schema
        ]
    )


def _shifted(placed: DataFrame, columns: list[str]) -> DataFrame:
    seq = F.when(F.col("seq") >= F.col("k"), F.col("seq") + 1).otherwise(F.col("seq"))
    return placed.withColumn("seq", seq).select(*columns)


def cut(feed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Insert a failure after the first k records of each stream."""
    failure = _inserted(
        feed, cuts, {"record": F.lit("failure"), "error_code": F.lit(CUT_CODE)}
    )
    return _shifted(_placed(feed, cuts), feed.columns).unionByName(failure)


def _listed(kinds: list[str]) -> Column:
    return F.array(*map(F.lit, kinds)) if kinds else F.array().cast("array<string>")


def mask_capability(feed: DataFrame, cuts: DataFrame, kinds: list[str], as_of: Column) -> DataFrame:
    """From record k on: a capability record, and facts of the other kinds stripped."""
    allowed = _listed(kinds)
    capability = _inserted(
        feed, cuts, {"record": F.lit("capability"), "kinds": allowed, "as_of": as_of}
    )
    placed = _placed(feed, cuts)
    kept = F.filter("facts", lambda f: F.array_contains(allowed, kind_of(f)))
    masked = placed.withColumn(
        "facts", F.when(F.col("seq") >= F.col("k"), kept).otherwise(F.col("facts"))
    )
    return _shifted(masked, feed.columns).unionByName(capability)


def earliest_legal_date(feed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Latest instant among the first k records: what a record inserted there may be dated."""
    return (
        _placed(feed, cuts)
        .groupBy("stream")
        .agg(
            F.max(
                F.when(F.col("seq") < F.col("k"), F.coalesce("observed_at", "as_of"))
            ).alias("as_of")
        )
    )


def victim_kind(feed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per stream: the kind of the first fact after the cut, and the stream's other kinds."""
    facts = (
        _placed(feed, cuts)
        .where("record = 'observation'")
        .select("stream", "seq", "k", F.posexplode("facts").alias("pos", "fact"))
        .select("stream", "seq", "k", "pos", kind_of(F.col("fact")).alias("kind"))
    )
    later = F.when(F.col("seq") >= F.col("k"), F.struct("seq", "pos", "kind"))
    return (
        facts.groupBy("stream")
        .agg(F.min(later).alias("first"), F.collect_set("kind").alias("kinds"))
        .where("first is not null")
        .select(
            "stream",
            F.col("first.kind").alias("victim"),
            F.array_sort(F.array_remove("kinds", F.col("first.kind"))).alias("kinds"),
        )
    )


def denied_present(feed: DataFrame, cuts: DataFrame, kinds: list[str]) -> DataFrame:
    """Per stream: does any fact from the cut on have a kind outside ``kinds``?"""
    allowed = _listed(kinds)
    denied = F.exists("facts", lambda f: ~F.array_contains(allowed, kind_of(f)))
    test = (F.col("seq") >= F.col("k")) & F.coalesce(denied, F.lit(False))
    return _placed(feed, cuts).groupBy("stream").agg(F.bool_or(test).alias("denied_present"))


# ---------------------------------------------------------------- claims


def fact_text(f: Column) -> Column:
    """A fact as one line of text: its kind, then its values."""
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    parts = {
        "Mac": F.concat_ws("|", f["Mac"]["addr"], f["Mac"]["locally_administered"].cast("string")),
        "IpV4": f["IpV4"]["addr"],
        "Hostname": F.concat_ws("|", f["Hostname"]["name"], f["Hostname"]["source"]),
        "DhcpLease": F.concat_ws(
            "|", f["DhcpLease"]["ip"], F.date_format(f["DhcpLease"]["expires_at"], stamp)
        ),
        "Uplink": F.concat_ws("|", f["Uplink"]["peer_mac"], f["Uplink"]["peer_port"]),
        "OuiVendor": f["OuiVendor"]["vendor"],
        "Rtt": f["Rtt"]["millis"].cast("string"),
    }
    return F.coalesce(
        *[
            F.when(f[k].isNotNull(), F.concat_ws(" ", F.lit(k), parts[k])) for k in FACT_KINDS
        ]
    )


def claims(obs: DataFrame) -> DataFrame:
    """(obs_id, claim): every fact of a sighting, plus one claim for its provenance."""
    said = obs.select("obs_id", F.explode("facts").alias("f")).select(
        "obs_id", fact_text(F.col("f")).alias("claim")
    )
    where = obs.select(
        "obs_id",
        F.concat_ws(
            " ",
            F.lit("provenance"),
            F.concat_ws(
                "|",
                F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                F.col("l2_domain").cast("string"),
                F.col("vantage").cast("string"),
                "connector_id",
            ),
        ).alias("claim"),
    )
    return said.unionByName(where)


def unaccounted(claimed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Items claimed more often than allowed, repeats counted, nulls equal; columns go by position.

    Items are dealt before they are counted: they hardly repeat in a scan, so a task that counted there
    would hold all it reads.
    """
    items = claimed.columns
    sides = claimed.select(*items, F.lit(1).alias("_n")).union(allowed.select("*", F.lit(-1).alias("_n")))
    more = sides.repartition(*items).groupBy(*items).agg(F.sum("_n").alias("_n")).where("_n > 0")
    return more.select(*items, F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_n")).drop("_n")


def included(claimed: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row: is every item of the first in the second, repeats counted?"""
    extra = unaccounted(claimed, allowed).agg(F.count("*").alias("extra"))
    return extra.select((F.col("extra") == 0).alias("included"), "extra")


def distinct_observations(obs: DataFrame) -> DataFrame:
    return obs.select("obs_id").distinct()


def capability_split(kinds: DataFrame) -> DataFrame:
    """(stream, kind, seen) over the closed list of kinds; ``kinds`` is (stream, kinds)."""
    every = F.array(*map(F.lit, FACT_KINDS))
    return kinds.select("stream", "kinds", F.explode(every).alias("kind")).select(
        "stream", "kind", F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)).alias("seen")
    )


def shuffled(df: DataFrame, column: str, seed: int) -> DataFrame:
    """The same rows placed and ordered otherwise, by a seeded digest of one column."""
    digest = F.xxhash64(F.col(column).cast("string"), F.lit(seed))
    return df.repartition(digest).sortWithinPartitions(digest)


def stream_context(feed: DataFrame) -> DataFrame:
    """Per stream: connector of its first sighting, scopes, kinds and earliest instant.

    Scopes and kinds are counted from closed or pre-aggregated sets, never from
    a collected stream.
    """
    first = feed.groupBy("stream").agg(
        F.min(F.when(F.col("obs_id").isNotNull(), F.struct("seq", "connector_id"))).alias("first"),
        F.min(F.coalesce("observed_at", "as_of")).alias("earliest"),
    )
    scopes = (
        feed.where("obs_id is not null")
        .select("stream", "l2_domain", "vantage")
        .distinct()
        .groupBy("stream")
        .agg(F.count("*").alias("scopes"))
    )
    seen = feed.select("stream", F.explode("facts").alias("f")).select(
        "stream", kind_of(F.col("f")).alias("kind")
    )
    told = feed.select("stream", F.explode("kinds").alias("kind"))
    kinds = (
        seen.unionByName(told)
        .groupBy("stream")
        .agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    )
    return (
        first.join(scopes, "stream", "left")
        .join(kinds, "stream", "left")
        .select(
            "stream",
            F.col("first.connector_id").alias("connector_id"),
            F.coalesce("scopes", F.lit(0)).cast("bigint").alias("scopes"),
            "kinds",
            "earliest",
        )
    )
