"""Comparing tables as multisets by sums of digests: order never counts, repeats do.

A row's SHA-256 is read as eight 32-bit lanes and the lanes are summed, so a table or group of any size has a
fingerprint of 256 bits that partial aggregation builds without moving rows.  Rows are dealt into buckets by
their digest; only buckets whose sums differ are looked into row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, LANE_BITS = 8, 32
BUCKETS = 256
EXACT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as text of all its columns by name; nulls are told from empty texts.

    Rows of equal columns in another order are equal.  Columns of type map have no set order and do not go.
    """
    return F.sha2(F.to_json(F.struct(*map(_quoted, sorted(df.columns))), EXACT), 256)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substr(digest, F.lit(at * 8 + 1), F.lit(8)), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, *by: str) -> DataFrame:
    """(by…, rows, fingerprint): one row per group, or one for the whole table, an empty one too."""
    rows = df.select(*by, row_digest(df).alias("_digest"))
    sums = [F.coalesce(F.sum(_lane(F.col("_digest"), i)), F.lit(0)).alias(f"_{i}") for i in range(LANES)]
    told = rows.groupBy(*by).agg(F.count("*").alias("rows"), *sums)
    parts = [
        F.lpad(F.lower(F.hex((F.col(f"_{i}") % (1 << LANE_BITS)).cast("bigint"))), 8, "0") for i in range(LANES)
    ]
    return told.select(*by, "rows", F.concat(*parts).alias("fingerprint"))


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    """(_digest, _bucket, _after) of the rows of both."""
    sides = [
        df.select(row_digest(df).alias("_digest"), F.lit(after_).alias("_after"))
        for df, after_ in ((before, False), (after, True))
    ]
    return sides[0].unionByName(sides[1]).withColumn(
        "_bucket", F.conv(F.substr("_digest", F.lit(1), F.lit(8)), 16, 10).cast("bigint") % BUCKETS
    )


def unequal(before: DataFrame, after: DataFrame) -> tuple[list[int], int]:
    """The buckets in which the two differ, at most BUCKETS of them, and the rows of the second."""
    def sums(own: Column) -> list[Column]:
        none = F.lit(0).cast("decimal(20,0)")
        return [F.sum(F.when(own, _lane(F.col("_digest"), i)).otherwise(none)) for i in range(LANES)]

    after_ = F.col("_after")
    same = reduce(lambda a, b: a & b, (x == y for x, y in zip(sums(~after_), sums(after_))))
    told = _both(before, after).groupBy("_bucket").agg(
        same.alias("same"), F.count_if(after_).alias("rows"), F.count_if(~after_).alias("had")
    ).collect()
    return [r._bucket for r in told if not r.same or r.rows != r.had], sum(r.rows for r in told)


def differences(before: DataFrame, after: DataFrame, buckets: list[int]) -> DataFrame:
    """(digest, lost, gained) of every row of the buckets that one side has more often than the other."""
    after_ = F.col("_after")
    counts = _both(before, after).where(F.col("_bucket").isin(buckets)).groupBy("_digest").agg(
        F.count_if(~after_).alias("had"), F.count_if(after_).alias("has")
    )
    return counts.where("had <> has").select(
        F.col("_digest").alias("digest"),
        F.greatest(F.col("had") - F.col("has"), F.lit(0)).alias("lost"),
        F.greatest(F.col("has") - F.col("had"), F.lit(0)).alias("gained"),
    )


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lost, gained, kept): rows only in the first, only in the second, and rows of the second."""
    buckets, kept = unequal(before, after)
    # With no bucket to look into, the filter is constant and neither side is read again.
    return differences(before, after, buckets).agg(
        F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("gained"), F.lit(0)).alias("gained"),
    ).select("lost", "gained", F.lit(kept).cast("bigint").alias("kept"))
