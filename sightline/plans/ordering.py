"""Positions and running values over streams of any length.

A plain ``partitionBy(stream)`` window puts a whole stream in one task.  Here a
stream is cut into blocks of consecutive positions; the window runs inside a
block and the value carried into a block comes from per-block summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.facts import int_div
from sightline.plans.lineage import cut

BLOCK = 1 << 16


def with_position(df: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Dense 0-based position per ``by`` group in ``order`` (unique within a group).

    Rows are range-partitioned on (by, order), so a long group spans many
    tasks; each task numbers its slice and adds the counts of the slices before
    it.  The ranged rows are checkpointed so both readers see one partitioning.
    """
    ranged = cut(
        df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id())
    )
    counts = ranged.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    numbered = ranged.withColumn("_rank", F.row_number().over(inside))
    return (
        numbered.join(starts, [*by, "_slice"])
        .withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("bigint"))
        .drop("_slice", "_start", "_rank")
    )


def _running(
    df: DataFrame,
    by: list[str],
    seq: str,
    inside_block: Column,
    block_value: Column,
    across: Column,
    name: str,
    merge,
    last_row: int = 0,
) -> DataFrame:
    blocked = df.withColumn("_block", int_div(F.col(seq), BLOCK))
    summaries = blocked.groupBy(*by, "_block").agg(block_value.alias("_summary"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.select(*by, "_block", across.over(earlier).alias("_carried"))
    upto = Window.partitionBy(*by, "_block").orderBy(seq)
    local = blocked.withColumn(
        "_local", inside_block.over(upto.rowsBetween(Window.unboundedPreceding, last_row))
    )
    return (
        local.join(carried, [*by, "_block"])
        .withColumn(name, merge(F.col("_local"), F.col("_carried")))
        .drop("_block", "_local", "_carried")
    )


def running_last(
    df: DataFrame, by: list[str], seq: str, value: Column, name: str, before: bool = False
) -> DataFrame:
    """Latest non-null ``value`` at or before each row; strictly before it with ``before``."""
    boxed = F.when(value.isNotNull(), F.struct(value.alias("v")))
    tagged = df.withColumn("_boxed", boxed)
    out = _running(
        tagged,
        by,
        seq,
        F.last("_boxed", ignorenulls=True),
        F.max_by("_boxed", F.when(F.col("_boxed").isNotNull(), F.col(seq))),
        F.last("_summary", ignorenulls=True),
        "_found",
        F.coalesce,
        -1 if before else 0,
    )
    return out.withColumn(name, F.col("_found.v")).drop("_boxed", "_found")


def running_max(df: DataFrame, by: list[str], seq: str, value: Column, name: str) -> DataFrame:
    """Largest ``value`` at or before each row (NULL while none was seen)."""
    tagged = df.withColumn("_value", value)
    out = _running(
        tagged, by, seq, F.max("_value"), F.max("_value"), F.max("_summary"), name, F.greatest
    )
    return out.drop("_value")


def running_count(df: DataFrame, by: list[str], seq: str, flag: Column, name: str) -> DataFrame:
    """Rows at or before each row for which ``flag`` holds."""
    tagged = df.withColumn("_flag", F.when(flag, 1).otherwise(0).cast("bigint"))
    out = _running(
        tagged,
        by,
        seq,
        F.sum("_flag"),
        F.sum("_flag"),
        F.sum("_summary"),
        name,
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )
    return out.drop("_flag")
