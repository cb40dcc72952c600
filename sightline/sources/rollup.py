"""The address history kept for ever, as mergeable parts: one a day, and one for the days folded away.

A day's part is made from that day's sightings alone and overwritten whole, so rolling a day again changes
nothing.  Folding merges all days before a cutoff into a base named by it; readers take the newest base and
the days from its cutoff on, so days before it, sightings and parts alike, may be removed at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.facts import addresses, macs
from sightline.plans import idindex


def _merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by, "ipv4", "mac").agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("sightings").alias("sightings"),
    )


def roll(obs: DataFrame, root: str) -> None:
    """Writes the part of every day in ``obs``, which holds these days whole; other days stay."""
    each = obs.select(
        "observed_at", F.explode(addresses()).alias("ipv4"), macs().alias("macs")
    ).select("observed_at", "ipv4", F.explode("macs").alias("mac"))
    days = each.select(
        F.date_format("observed_at", "yyyy-MM-dd").alias("day"), "ipv4", "mac",
        F.col("observed_at").alias("first_seen_at"), F.col("observed_at").alias("last_seen_at"),
        F.lit(1).cast("bigint").alias("sightings"),
    )
    (
        _merged(days, "day").repartition("day", F.pmod(F.xxhash64("ipv4", "mac"), F.lit(8)))
        .write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .parquet(f"{root}/days")
    )


def _days(spark: SparkSession, root: str) -> DataFrame:
    days = spark.read.option("basePath", f"{root}/days").parquet(f"{root}/days")
    return days.withColumn("day", F.col("day").cast("string"))


def _newest_base(spark: SparkSession, root: str) -> tuple[str | None, DataFrame | None]:
    """The cutoff of the newest base and its rows; there are as many bases as foldings not yet removed."""
    if not idindex.exists(spark, f"{root}/base"):
        return None, None
    bases = spark.read.parquet(f"{root}/base")
    cutoff = bases.select(F.max("before").cast("string")).first()[0]
    return cutoff, bases.where(F.col("before").cast("string") == cutoff).drop("before")


def history(spark: SparkSession, root: str, before: str | None = None) -> DataFrame:
    """(ipv4, mac, first_seen_at, last_seen_at, sightings) of all days rolled, or of those before one."""
    cutoff, base = _newest_base(spark, root)
    days = _days(spark, root)
    if before is not None:
        if cutoff is not None and before < cutoff:
            raise ValueError(f"days before {cutoff} are folded already")
        days = days.where(F.col("day") < before)
    if cutoff is not None:
        days = days.where(F.col("day") >= cutoff)
    parts = days.drop("day")
    return _merged(parts if base is None else base.unionByName(parts))


def fold(spark: SparkSession, root: str, before: str) -> None:
    """Merges the newest base and the days before ``before`` (yyyy-MM-dd) into a base of that name."""
    cutoff, _ = _newest_base(spark, root)
    if cutoff == before:
        return
    history(spark, root, before).write.mode("overwrite").parquet(f"{root}/base/before={before}")
