"""Declared against observed, field by field.

An entity's perimeter is the sightings that carry its declared ipv4.  Sightings
are first summed per address, so the work is linear in the facts however many
entities declare an address or however many sightings carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions.facts import addresses, declarable_fields
from sightline.plans.skew import lookup

IDENTITY = "ipv4"


def address_values(obs: DataFrame) -> DataFrame:
    """Distinct (ipv4, field, value) seen together in one sighting."""
    carried = obs.select(F.explode(addresses()).alias("ipv4"), "facts")
    return declarable_fields(carried, "ipv4").select("ipv4", "field", "value").distinct()


def address_fields(obs: DataFrame) -> DataFrame:
    """Per (ipv4, field): how many distinct values, and the smallest of them."""
    return address_values(obs).groupBy("ipv4", "field").agg(
        F.count("*").alias("n_values"), F.min("value").alias("value")
    )


def address_rollup(obs: DataFrame) -> DataFrame:
    """Per ipv4: how many sightings carry it, and the first and newest of them.

    Ties in time go to the smaller id for the first and the larger for the
    newest.  Ids are unique in the sightings table.
    """
    at = F.struct("observed_at", "obs_id", "connector_id")
    return (
        obs.select(F.explode(addresses()).alias("ipv4"), at.alias("at"))
        .groupBy("ipv4")
        .agg(F.count("*").alias("sightings"), F.min("at").alias("first"), F.max("at").alias("newest"))
    )


def identities(declared: DataFrame) -> DataFrame:
    """(entity_id, ipv4) of the entities that declare an address."""
    return declared.where(F.col("attr_key") == IDENTITY).select(
        "entity_id", F.col("attr_value").alias("ipv4")
    )


def with_identity(declared: DataFrame) -> DataFrame:
    """Declared rows of the entities that have an address, with that address."""
    return declared.join(identities(declared), "entity_id")


def at_address(
    rows: DataFrame, table: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("ipv4",)
) -> DataFrame:
    """Declared rows beside a per-address table; an address very many entities declare is salted."""
    weights = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return lookup(rows, table, list(keys), "_n", "entity_id", how=how, weights=weights)


def claimed(declared: DataFrame) -> DataFrame:
    """Each declared address once."""
    return identities(declared).select("ipv4").distinct()


def field_values(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Per (entity, field): distinct in-perimeter values, whether or not it is declared."""
    return at_address(identities(declared), address_fields(obs)).select(
        "entity_id", "field", "n_values", "value"
    )


def status_of(n_values: Column, value: Column, wanted: Column) -> Column:
    return (
        F.when(n_values.isNull(), S.NO_VALUE)
        .when(n_values > 1, S.CONFLICTING)
        .when(value != wanted, "gap")
        .otherwise("clear")
    )


def compare(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Every declared field beside what was observed, with its status."""
    seen = address_fields(obs).withColumnRenamed("field", "attr_key")
    rows = at_address(with_identity(declared), seen, "left", ("ipv4", "attr_key"))
    n, v = F.col("n_values"), F.col("value")
    return rows.select(
        "entity_id",
        "ipv4",
        "attr_key",
        "attr_value",
        F.when(n == 1, v).alias("observed"),
        status_of(n, v, F.col("attr_value")).alias("status"),
    )


def gaps(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Declared fields whose single observed value differs."""
    return compare(declared, obs).where("status = 'gap'").select(
        "entity_id", F.col("attr_key").alias("field"), F.col("attr_value").alias("declared"),
        "observed",
    )


def entity_fields(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Every field an entity declares or is seen with: (entity_id, field, declared, n_values, value)."""
    said = with_identity(declared).select(
        "entity_id", F.col("attr_key").alias("field"), F.col("attr_value").alias("declared"),
        F.lit(True).alias("said"),
    )
    return said.join(field_values(declared, obs), ["entity_id", "field"], "full_outer")


def cause_counts(fields: DataFrame) -> DataFrame:
    """Per entity: fields in conflict, declared or not, and declared fields with no single value.

    A declared field in conflict counts under both.
    """
    conflict = F.coalesce(F.col("n_values") > 1, F.lit(False))
    absent = F.col("said").isNotNull() & (conflict | F.col("n_values").isNull())

    def n(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")

    return fields.groupBy("entity_id").agg(n(conflict).alias("conflicts"), n(absent).alias("absences"))


def as_causes(counts: DataFrame, causes: dict[str, str], *carry: str) -> DataFrame:
    """(entity_id, …carry, cause, n) rows of the counted columns that are not zero."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("cause"), F.col(k).alias("n")) for k, c in causes.items()]
    )
    return counts.select("entity_id", *carry, F.inline(pairs)).where("n > 0")


def abstentions(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Counted abstentions per entity, by cause.

    Out-of-perimeter is the total less the sightings carrying the address, so no
    sighting is visited once per entity.
    """
    total = obs.agg(F.count("*")).scalar()
    carried = address_rollup(obs).select("ipv4", "sightings")
    counts = (
        at_address(identities(declared), carried, "left")
        .select("entity_id", (total - F.coalesce("sightings", F.lit(0))).alias("outside"))
        .join(cause_counts(entity_fields(declared, obs)), "entity_id")
    )
    causes = {"outside": S.OUT_OF_PERIMETER, "conflicts": S.CONFLICTING, "absences": S.NO_VALUE}
    return as_causes(counts, causes)


def unclaimed(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Observed addresses no declared entity claims."""
    seen = obs.select(F.explode(addresses()).alias("ipv4")).distinct()
    return seen.join(claimed(declared), "ipv4", "left_anti")


def first_new_address(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """First sighting of each unclaimed address, by instant and then id."""
    unknown = address_rollup(obs).join(claimed(declared), "ipv4", "left_anti")
    return unknown.select("ipv4", "first.observed_at", "first.obs_id", "first.connector_id")


def newest_by_address(obs: DataFrame) -> DataFrame:
    """Newest sighting of each address; of equals, the one loaded last (largest id)."""
    return address_rollup(obs).select(
        "ipv4", "newest.observed_at", "newest.obs_id", "newest.connector_id"
    )


def newest_sighting(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Newest in-perimeter sighting per entity; entities never seen have none."""
    return at_address(identities(declared), newest_by_address(obs)).select(
        "entity_id", "ipv4", "observed_at", "obs_id", "connector_id"
    )


def object_state(declared: DataFrame, obs: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """One of five states per object: declared entities, then unclaimed addresses.

    ``shared`` names addresses more than one identity may stand behind; an
    entity on one is ambiguous.  An entity in none of the other states is
    concordant.
    """
    per_entity = compare(declared, obs).groupBy("entity_id", "ipv4").agg(
        F.bool_or(F.col("status") == S.CONFLICTING).alias("conflict"),
        F.bool_or(F.col("status") == "gap").alias("gap"),
    )
    if shared is not None:
        per_entity = per_entity.join(
            shared.select("ipv4", F.lit(True).alias("ambiguous")).distinct(), "ipv4", "left"
        )
    else:
        per_entity = per_entity.withColumn("ambiguous", F.lit(False))
    state = (
        F.when(F.col("ambiguous"), "ambiguous")
        .when(F.col("conflict"), "conflict")
        .when(F.col("gap"), "gap")
        .otherwise("concordant")
    )
    known = per_entity.select(
        F.col("entity_id").cast("string").alias("object_id"), "ipv4", state.alias("state")
    )
    new = unclaimed(declared, obs).select(
        F.col("ipv4").alias("object_id"), "ipv4", F.lit("undeclared").alias("state")
    )
    return known.unionByName(new)
