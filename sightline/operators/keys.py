"""Scoped keys: which sightings speak of the same interface.

A key is (l2_domain, mac).  Groups stay as rows: a group is never collected
into an array, and pairs inside a group are never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.facts import int_div, macs
from sightline.plans.skew import lookup

KEY = ["l2_domain", "mac"]


def scoped_keys(obs: DataFrame) -> DataFrame:
    """(obs_id, l2_domain, mac, observed_at): membership of sightings in key groups."""
    return (
        obs.select("obs_id", "l2_domain", "observed_at", F.explode(macs()).alias("mac"))
        .select("obs_id", "l2_domain", "mac", "observed_at")
        .distinct()
    )


def key_groups(keys: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per key: members, seen window, and the two smallest member ids; ``by`` may tell parts of a key apart.

    The two smallest ids come from a ranked window limited to two rows, which
    Spark also applies before the shuffle, so a heavy key sends at most two
    rows per map task.
    """
    ranked = Window.partitionBy(*by).orderBy("obs_id")
    lowest = (
        keys.withColumn("_rank", F.row_number().over(ranked))
        .where("_rank <= 2")
        .groupBy(*by)
        .agg(
            F.min(F.when(F.col("_rank") == 1, F.col("obs_id"))).alias("first_id"),
            F.min(F.when(F.col("_rank") == 2, F.col("obs_id"))).alias("second_id"),
        )
    )
    return seen_window(keys, by).join(lowest, by)


def seen_window(keys: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per key: member count and first and last instant."""
    return keys.groupBy(*by).agg(
        F.count("*").alias("members"),
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
    )


def witnesses(keys: DataFrame) -> DataFrame:
    """Each member with its witness: the smallest other member, or itself when alone."""
    groups = key_groups(keys).select(*KEY, "members", "first_id", "second_id")
    found = lookup(keys, groups, KEY, "members", "obs_id")
    return found.select(
        *keys.columns,
        "members",
        F.when(F.col("obs_id") == F.col("first_id"), F.coalesce("second_id", "obs_id"))
        .otherwise(F.col("first_id"))
        .alias("witness"),
    )


def witnesses_within(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Witness of each member when only the given (low, high) pairs may be judged.

    A lone member still witnesses itself; a member none of whose pairs is given
    has no row.  The work follows the given pairs, not the pairs of a group.
    """
    both = pairs.where("low < high").select("low", "high").distinct()
    sides = both.select(F.col("low").alias("obs_id"), F.col("high").alias("other")).unionByName(
        both.select(F.col("high").alias("obs_id"), F.col("low").alias("other"))
    )
    other = keys.select(F.col("obs_id").alias("other"), *KEY)
    paired = (
        sides.join(keys.select("obs_id", *KEY), "obs_id")
        .join(other, ["other", *KEY])
        .groupBy("obs_id", *KEY)
        .agg(F.min("other").alias("witness"))
    )
    alone = (
        keys.groupBy(*KEY)
        .agg(F.count("*").alias("_n"), F.min("obs_id").alias("obs_id"))
        .where("_n = 1")
        .select("obs_id", *KEY, F.col("obs_id").alias("witness"))
    )
    return paired.unionByName(alone)


def pair_count(n: Column) -> Column:
    """Unordered pairs among n things, exact on BIGINT."""
    return int_div(n * (n - 1), 2)


def candidate_universe(obs: DataFrame) -> DataFrame:
    """Size of the total universe of pairs, from one count; the pairs are never listed."""
    return obs.agg(F.count_distinct("obs_id").alias("observations")).select(
        "observations", pair_count(F.col("observations")).alias("pairs")
    )


def pairs_in_groups(keys: DataFrame) -> DataFrame:
    """How many pairs each key group implies."""
    return (
        keys.groupBy(*KEY)
        .agg(F.count("*").alias("members"))
        .select(*KEY, "members", pair_count(F.col("members")).alias("pairs"))
    )


def blocked_pairs(pairs: DataFrame, block_keys: DataFrame, key_columns: list[str]) -> DataFrame:
    """The given (low, high) pairs whose two sides share a blocking key.

    ``block_keys`` is (obs_id, *key_columns), one row per key an id carries.
    """
    low = block_keys.select(F.col("obs_id").alias("low"), *key_columns)
    high = block_keys.select(F.col("obs_id").alias("high"), *key_columns)
    asked = pairs.where("low < high").select("low", "high").distinct()
    return asked.join(low, "low").join(high, ["high", *key_columns]).select("low", "high").distinct()


def blocking_recall(required: DataFrame, proposed: DataFrame) -> DataFrame:
    """Per-mille of the distinct required pairs that were proposed; NULL if none is required."""
    wanted = required.where("low < high").select("low", "high").distinct()
    found = proposed.select("low", "high", F.lit(1).alias("_hit")).distinct()
    hit = wanted.join(found, ["low", "high"], "left")
    return hit.agg(
        F.count("*").alias("required"), F.count("_hit").alias("found")
    ).select(
        "required",
        "found",
        F.when(F.col("required") > 0, int_div(F.col("found") * 1000, F.col("required"))).alias(
            "per_mille"
        ),
    )


def interface_for_key(keys: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Existing interface of each scoped key; several may share a key and the smallest id wins."""
    smallest = interfaces.groupBy(*KEY).agg(F.min("interface_id").alias("interface_id"))
    return keys.select(*KEY).distinct().join(smallest, KEY, "left")
