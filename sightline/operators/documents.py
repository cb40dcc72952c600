"""Writing to the declared side: adopting a sighting, or a manual entry."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.facts import DECLARABLE, declarable_fields, declarable_value, uuid_shaped

UNKNOWN, NOTHING, ALREADY = "unknown_subject", "nothing_to_document", "already_documented"


def first_value_per_field(obs: DataFrame) -> DataFrame:
    """First value of each declarable field of a sighting, in fact order."""
    return (
        declarable_fields(obs, "obs_id")
        .groupBy("obs_id", "field")
        .agg(F.min(F.struct("pos", "value")).alias("first"))
        .select("obs_id", "field", F.col("first.value").alias("value"))
    )


def _first(kind: str) -> Column:
    """The first fact of a kind in a row, as (pos, value)."""
    return F.array_min(F.transform("facts", lambda f, i: F.when(
        f[kind].isNotNull(), F.struct(i.alias("pos"), declarable_value(f).alias("value"))
    )))


def _subjects(subjects: DataFrame, obs: DataFrame, declared: DataFrame) -> DataFrame:
    """(obs_id, a column per field, reason) for every subject: first values, and why it is refused, if it is.

    Sightings and declared attributes are narrowed in their rows and met by one grouping.  They are dealt
    by subject before it: ids hardly repeat in a scan, so a task that grouped there would hold all it reads.
    """
    yes = F.lit(True)
    asked = subjects.select("obs_id", yes.alias("_asked"))
    seen = obs.where("obs_id is not null").select(
        "obs_id", yes.alias("_known"), *[_first(k).alias(n) for k, n in DECLARABLE.items()]
    )
    taken = declared.where("origin_obs_id is not null").select(
        F.col("origin_obs_id").alias("obs_id"),
        *[(F.col("attr_key") == n).alias(f"_taken_{n}") for n in DECLARABLE.values()],
    )
    rows = asked.unionByName(seen, allowMissingColumns=True).unionByName(taken, allowMissingColumns=True)
    of = rows.repartition("obs_id").groupBy("obs_id").agg(
        F.max("_asked").alias("_asked"), F.max("_known").alias("_known"),
        *[F.min(n).alias(n) for n in DECLARABLE.values()],
        *[F.max(f"_taken_{n}").alias(f"_taken_{n}") for n in DECLARABLE.values()],
    )
    told = [F.col(n).isNotNull() for n in DECLARABLE.values()]
    clash = [t & F.coalesce(f"_taken_{n}", F.lit(False)) for n, t in zip(DECLARABLE.values(), told)]
    reason = (
        F.when(F.col("_known").isNull(), UNKNOWN)
        .when(~reduce(or_, told), NOTHING)
        .when(reduce(or_, clash), ALREADY)
    )
    return of.where("_asked").select("obs_id", *DECLARABLE.values(), reason.alias("reason"))


def refusals(subjects: DataFrame, obs: DataFrame, declared: DataFrame) -> DataFrame:
    """One reason per refused subject: unknown, nothing to document, already documented."""
    return _subjects(subjects, obs, declared).select("obs_id", "reason").where("reason is not null")


def adopt(subjects: DataFrame, obs: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows to append: every field of each admissible subject, or none of them.

    The new entity's id is a digest of the subject, so a replay appends the same
    rows.
    """
    allowed = _subjects(subjects, obs, declared).where("reason is null")
    each = F.array(*[
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("field"), F.col(n)["value"].alias("value")))
        for n in DECLARABLE.values()
    ])
    fields = allowed.select("obs_id", F.explode(F.array_compact(each)).alias("own")).select("obs_id", "own.*")
    return fields.select(
        uuid_shaped(F.lit("adopted"), F.col("obs_id").cast("string")).alias("entity_id"),
        F.col("field").alias("attr_key"),
        F.col("value").alias("attr_value"),
        F.lit("adopted").alias("origin"),
        F.col("obs_id").alias("origin_obs_id"),
    )


def add_manual(entries: DataFrame, declared: DataFrame) -> DataFrame:
    """Manual rows to append; an (entity, key) already declared is refused, never overwritten."""
    return (
        entries.join(declared.select("entity_id", "attr_key"), ["entity_id", "attr_key"], "left_anti")
        .select("entity_id", "attr_key", "attr_value", F.lit("manual").alias("origin"))
    )
