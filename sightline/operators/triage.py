"""The triage queue and the views read beside it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions.facts import (
    addresses,
    age_bucket,
    display_fields,
    seconds_between,
    source_label,
)
from sightline.operators import gaps as G
from sightline.plans.lineage import cut

# Queue row kinds and the prefix of their ids.
GAP, ABSENCE, CONFLICT, NEW = "ecart", "absence", "conflit", "nouveau"

# Age of a row nothing was ever seen for.
NEVER_SEEN = 9223372036854775807


def instant(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp_ntz")


def _age(now: Column, then: Column) -> Column:
    return F.greatest(seconds_between(now, then), F.lit(0))


def queue(declared: DataFrame, obs: DataFrame, now: datetime | str) -> DataFrame:
    """Rows to look at: gaps, absences, conflicts and new addresses.

    Entities without an address are skipped, and out-of-perimeter counts are
    never queued.
    """
    at = instant(now)
    # Both are small beside the sightings and read from several sides below.
    fields = cut(G.entity_fields(declared, obs).join(G.identities(declared), "entity_id"))
    by_address = cut(
        G.address_rollup(obs).join(
            G.claimed(declared).withColumn("claimed", F.lit(True)),
            "ipv4", "left",
        )
    )
    entity = F.col("entity_id").cast("string")
    gap = fields.where("said and n_values = 1 and value <> declared").select(
        "entity_id", "ipv4", F.lit(GAP).alias("kind"), "field", "declared",
        F.col("value").alias("observed"), F.lit(None).cast("bigint").alias("n"),
    )
    counts = G.cause_counts(fields).join(G.identities(declared), "entity_id")
    cause = G.as_causes(counts, {"absences": ABSENCE, "conflicts": CONFLICT}, "ipv4").select(
        "entity_id", "ipv4", F.col("cause").alias("kind"), F.lit("").alias("field"),
        F.lit("").alias("declared"), F.lit("").alias("observed"), "n",
    )
    newest = by_address.where("claimed").select("ipv4", "newest.observed_at", "newest.connector_id")
    known = (
        G.at_address(gap.unionByName(cause), newest, "left")
        .select(
            F.when(
                F.col("kind") == GAP, F.concat_ws(":", "kind", entity, "field")
            ).otherwise(F.concat_ws(":", "kind", entity)).alias("row_id"),
            "kind", "entity_id", "ipv4", "field", "declared", "observed", "n", "connector_id",
            F.col("observed_at").alias("seen_at"),
            F.when(F.col("observed_at").isNull(), F.lit(NEVER_SEEN))
            .otherwise(_age(at, F.col("observed_at"))).alias("age_seconds"),
        )
    )
    first = F.col("first.observed_at")
    new = by_address.where("claimed is null").select(
        F.concat_ws(":", F.lit(NEW), "ipv4").alias("row_id"),
        F.lit(NEW).alias("kind"),
        F.lit(None).cast(declared.schema["entity_id"].dataType).alias("entity_id"),
        "ipv4",
        F.lit("ipv4").alias("field"),
        F.lit("").alias("declared"),
        F.col("ipv4").alias("observed"),
        F.lit(None).cast("bigint").alias("n"),
        "first.connector_id",
        first.alias("seen_at"),
        _age(at, first).alias("age_seconds"),
    )
    return known.unionByName(new)


def by_age(rows: DataFrame) -> DataFrame:
    """Oldest first; never seen comes ahead of all."""
    return rows.orderBy(F.col("age_seconds").desc(), "entity_id", "row_id")


def by_entity(rows: DataFrame) -> DataFrame:
    """Default order: entities with their gaps and then causes, new addresses last."""
    rank = (
        F.when(F.col("kind") == GAP, 0)
        .when(F.col("kind") == CONFLICT, 1)
        .when(F.col("kind") == ABSENCE, 2)
        .otherwise(3)
    )
    return rows.orderBy(
        F.col("kind") == NEW, "entity_id", rank, "field", "seen_at", "row_id"
    )


# What may be done about a row, by its kind.
ACTIONS = {GAP: "document", ABSENCE: "document", CONFLICT: "resolve", NEW: "document"}


def detail(
    rows: DataFrame, declared: DataFrame, now: datetime | str, selected: str | None = None
) -> DataFrame:
    """Both sides of the rows asked for: one row when an id is selected, else every row."""
    at = instant(now)
    chosen = rows if selected is None else rows.where(F.col("row_id") == selected)
    sides = F.struct("updated_at", "origin")
    own = declared.select(
        "entity_id", F.col("attr_key").alias("field"), sides.alias("field_side")
    )
    last = declared.groupBy("entity_id").agg(F.max(sides).alias("entity_side"))
    joined = chosen.join(own, ["entity_id", "field"], "left").join(last, "entity_id", "left")
    side = F.when(F.col("kind") == GAP, F.col("field_side")).when(
        F.col("kind") != NEW, F.col("entity_side")
    )
    action = F.coalesce(*[F.when(F.col("kind") == k, F.lit(a)) for k, a in ACTIONS.items()])
    fresh = age_bucket(at, F.col("seen_at"))
    return joined.withColumn("_side", side).select(
        "row_id",
        "kind",
        "ipv4",
        "field",
        "declared",
        "observed",
        "n",
        F.col("_side.origin").alias("declared_origin"),
        F.col("_side.updated_at").alias("declared_at"),
        source_label(F.col("connector_id")).alias("observed_source"),
        F.when(F.col("seen_at").isNull(), "never_seen")
        .otherwise(fresh["unit"])
        .alias("freshness_unit"),
        F.when(F.col("seen_at").isNotNull(), fresh["n"]).alias("freshness_n"),
        action.alias("action"),
    )


def declared_provenance(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Gap rows with the origin and date of their declared side, and the entity's newest write."""
    sides = F.struct("updated_at", "origin")
    own = declared.select(
        "entity_id", F.col("attr_key").alias("field"), "origin", "updated_at"
    )
    newest = declared.groupBy("entity_id").agg(F.max(sides).alias("newest"))
    return (
        G.gaps(declared, obs)
        .join(own, ["entity_id", "field"], "left")
        .join(newest, "entity_id", "left")
        .select(
            "entity_id", "field", "declared", "observed", "origin", "updated_at",
            F.col("newest.updated_at").alias("entity_updated_at"),
        )
    )


def first_entity(declared: DataFrame, preferred_ipv4: str | None = None) -> DataFrame:
    """The entity declaring the preferred address, or the first by id that declares one."""
    found = G.identities(declared)
    if preferred_ipv4 is not None:
        found = found.where(F.col("ipv4") == preferred_ipv4)
    return found.orderBy("entity_id").limit(1)


def observed_values(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """Distinct (entity, key, value) shown for the in-perimeter sightings of each entity."""
    carried = obs.select(F.explode(addresses()).alias("ipv4"), "facts")
    shown = display_fields(carried, "ipv4").select("ipv4", "field", "value").distinct()
    return G.at_address(G.identities(declared), shown).select("entity_id", "field", "value")


def reconciled_entities(declared: DataFrame, obs: DataFrame) -> DataFrame:
    """The whole view as rows (entity_id, part, field, declared, observed, n)."""
    blank = F.lit(None).cast("string")
    number = F.lit(None).cast("bigint")
    said = G.with_identity(declared).select(
        "entity_id", F.lit("declared").alias("part"), F.col("attr_key").alias("field"),
        F.col("attr_value").alias("declared"), blank.alias("observed"), number.alias("n"),
    )
    shown = observed_values(declared, obs).select(
        "entity_id", F.lit("observed").alias("part"), "field", blank.alias("declared"),
        F.col("value").alias("observed"), number.alias("n"),
    )
    gap = G.gaps(declared, obs).select(
        "entity_id", F.lit("gap").alias("part"), "field", "declared", "observed",
        number.alias("n"),
    )
    held = G.abstentions(declared, obs).select(
        "entity_id", F.lit("abstention").alias("part"), F.col("cause").alias("field"),
        blank.alias("declared"), blank.alias("observed"), "n",
    )
    return said.unionByName(shown).unionByName(gap).unionByName(held)


def engine_reach(links: DataFrame) -> DataFrame:
    """Current engine links: distinct sightings by (outcome, cause); NULL is its own group."""
    held = links.where(
        F.col("current_subject").isNotNull() & (F.col("decided_by") == S.ENGINE)
    )
    return (
        held.groupBy("outcome", "abstention_cause")
        .agg(F.count_distinct("observation_id").alias("n"))
        .orderBy("outcome", "abstention_cause")
    )


def identity_view(reach: DataFrame) -> DataFrame:
    """placed, not placed (with causes as rows elsewhere) and settled, from the reach counts."""
    def of(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint")

    outcome = F.col("outcome")
    return reach.agg(
        of(outcome == S.MATCH).alias("placed"),
        of(outcome == S.ABSTAINED).alias("not_placed"),
        of(~outcome.isin(S.MATCH, S.ABSTAINED)).alias("settled"),
    )


def store_facts(obs: DataFrame, declared: DataFrame, links: DataFrame) -> DataFrame:
    """Row counts of the store, and how many sightings the engine placed or did not."""
    reach = engine_reach(links)
    placed = F.coalesce(F.sum(F.when(F.col("outcome") == S.MATCH, F.col("n"))), F.lit(0))
    other = F.coalesce(F.sum(F.when(F.col("outcome") != S.MATCH, F.col("n"))), F.lit(0))
    return reach.agg(
        placed.cast("bigint").alias("placed"), other.cast("bigint").alias("not_placed")
    ).select(
        obs.agg(F.count("*")).scalar().alias("observations"),
        declared.agg(F.count("*")).scalar().alias("declared_attributes"),
        links.agg(F.count("*")).scalar().alias("identity_links"),
        links.where(
            F.col("current_subject").isNotNull() & (F.col("decided_by") == S.ENGINE)
        ).agg(F.count("*")).scalar().alias("current_engine_links"),
        "placed",
        "not_placed",
    )


def last_observed(obs: DataFrame) -> DataFrame:
    return obs.agg(F.max("observed_at").alias("last_observed_at"))


def dashboard_pending(obs: DataFrame, links: DataFrame) -> DataFrame:
    """True when there are sightings and no link row at all; either side is read up to its first row."""
    def some(df: DataFrame) -> DataFrame:
        return df.select(F.lit(1).alias("one")).limit(1).agg((F.count("*") > 0).alias("some"))

    return some(obs).select((F.col("some") & ~some(links).scalar()).alias("pending"))
