"""Stored tables: Parquet folders of sightings, declarations and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.links import content
from sightline.plans import idindex
from sightline.plans.lineage import cut
from sightline.plans.skew import unsent


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Stored sightings; the reader sorts only where an order is used."""
    return spark.read.parquet(path)


def append_observations(obs: DataFrame, path: str) -> DataFrame:
    """Appends sightings whose id is not stored yet and returns (obs_id, reason, rows) of what it refused.

    A stored id is never stored again: its rows are refused as ``repeated``, or as ``contradicting``
    where they say something else.  Of several rows of one id in the batch one is stored and the others
    are repeats, unless they contradict each other: then none is.  Stored ids are looked up in an index
    that reads only the files that may hold them.  A retry after a lost job adds nothing twice.
    """
    spark = obs.sparkSession
    index = f"{path}/_ids"
    done = [b for b, _ in idindex.generations(spark, index)]
    batch = max([b for b in done if b >= 0], default=-1) + 1
    said = F.sha2(content(), 256)
    told = obs.select(F.col("obs_id").alias("id"), said.alias("said")).groupBy("id").agg(
        F.min("said").alias("said"), (F.min("said") == F.max("said")).alias("one"), F.count("*").alias("n")
    )
    told = cut(told)
    held = idindex.held(told, index)
    known = told.withColumn("stored", F.lit(None).cast("string"))
    if held is not None:
        known = told.join(unsent(held.withColumnRenamed("said", "stored")), "id", "left")
    known = cut(known)
    fresh = known.where("one and stored is null").select("id", "said")
    own = unsent(fresh.select(F.col("id").alias("obs_id")))
    rows = obs.join(own, "obs_id", "left_semi").dropDuplicates(["obs_id"])
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    idindex.append(fresh, index, batch)
    differs = ~F.col("one") | F.coalesce(F.col("stored") != F.col("said"), F.lit(False))
    again = F.col("n") - F.when(F.col("stored").isNull() & F.col("one"), 1).otherwise(0)
    return known.where(again > 0).select(
        F.col("id").alias("obs_id"), F.when(differs, "contradicting").otherwise("repeated").alias("reason"),
        again.alias("rows"),
    )


def write_snapshot(links: DataFrame, path: str) -> DataFrame:
    """Write a link snapshot to a new path and read it back."""
    links.write.mode("errorifexists").parquet(path)
    return links.sparkSession.read.parquet(path)


def declared_with_provenance(declared: DataFrame) -> DataFrame:
    return declared.select(
        "entity_id", "attr_key", "attr_value", "origin", "updated_at"
    ).orderBy("entity_id", "attr_key")


def read_labels(spark: SparkSession, glob: str) -> DataFrame:
    """Labelled pairs over all matching JSON files, with the file each came from."""
    schema = (
        "case_id string, replay string, observations array<string>, reason string, family string, "
        "expectation string, expected_rule string, expected_cause string"
    )
    return spark.read.schema(schema).json(glob).withColumn("file", F.col("_metadata.file_path"))
