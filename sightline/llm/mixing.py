"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded blocks.

Everything is DataFrame functions.  The words of a source form one stream, its documents in a
seeded order; the stream is cut into blocks of equal tokens and may be read ``MOST`` times.  Blocks
are awarded to sources by the highest quotients target / (2 k + 1).  Awards are house-monotone, so
cutting their order into equal runs gives every shard an integer quota per source, and a shard
takes that many blocks, the next ones of the seeded stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import attached, lookup_small, row_hash, running, seeded, settle, word_count

MOST = 3  # times a document may be taken
BLOCKS = 1 << 20  # so many blocks in all, or more; a block has at least one token
LEAST_BLOCKS = 32  # of the source with the least target, so that it comes near its target too
SHARDS = 8
SEED = "mix-1"
BROADCAST_SOURCES = 50_000
# Weights by the sources' order: 1, 2, 3, repeating.
WEIGHT = "cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as bigint)"


def targets(sized: DataFrame, weight: str = WEIGHT) -> DataFrame:
    """(source, source_size, place, weight, target): one row per source.

    Targets share all tokens by weight and stop at ``MOST`` times the source; what a stopped source
    leaves is shared again.  In order of cap / weight the stopped sources come first, so one running
    sum finds the level at which the rest share what is left.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.selectExpr(
        "*", f"{weight} as weight", "row_number() over (order by source asc nulls last) as place",
        f"{MOST} * source_size as cap", "sum(source_size) over () as total",
    )
    by_level = "order by cast(cap as double) / weight, place"
    sources = sources.selectExpr(
        "*", f"""cast(total - (sum(cap) over ({by_level}) - cap) as double)
          / (sum(weight) over () - sum(weight) over ({by_level}) + weight) as level"""
    )
    return sources.selectExpr(
        "source", "source_size", "place", "weight", "total",
        "least(cast(cap as double), weight * max(level) over ()) as target",
    )


def quotas(plan: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(source, ..., block, bounds): ``bounds[j]`` blocks go to the source within shards 0 .. j - 1.

    For each count of awards, rounding target / divisor is right but for a few seats; only the seats
    near the divisor are ranked, so the cost follows the number of sources, not of blocks.
    """
    least = f"cast(floor(min(if(target > 0, target, null)) over () / {LEAST_BLOCKS}) as bigint)"
    plan = plan.selectExpr(
        "*", f"greatest(1, least(total div {blocks}, {least})) as block", "count(*) over () as sources"
    ).selectExpr("*", "total div block as all_blocks")
    asked = plan.where("target > 0").selectExpr("*", f"explode(sequence(1, {shards})) as shard")
    asked = asked.selectExpr(
        "*", f"all_blocks * shard div {shards} as awards"
    ).where("awards > 0").selectExpr(
        "*", "cast(floor(target * awards / total + 0.5d) as bigint) as near"
    ).selectExpr(
        "*", "abs(awards - sum(near) over (partition by shard)) + sources as slack"
    ).selectExpr(
        "*", "cast(ceil(target * slack / total) + 1 as bigint) as reach"
    ).selectExpr("*", "greatest(0, near - reach) as sure")
    seats = asked.selectExpr(
        "*", "explode(sequence(sure, near + reach)) as seat",
    ).selectExpr(
        "*", "row_number() over (partition by shard order by target / (2 * seat + 1) desc, place) as turn"
    )
    open_seats = asked.groupBy("shard").agg((F.max("awards") - F.sum("sure")).alias("open"))
    won = (
        seats.join(F.broadcast(open_seats), "shard")  # one row per shard
        .groupBy("place", "shard")
        .agg((F.max("sure") + F.sum((F.col("turn") <= F.col("open")).cast("bigint"))).alias("won"))
        .groupBy("place")
        .agg(F.map_from_entries(F.collect_list(F.struct("shard", "won"))).alias("won"))
    )
    bounds = f"transform(sequence(0, {shards}), j -> coalesce(won[j], 0L))"
    return plan.join(won, "place", "left").selectExpr(
        "source", "source_size", "target", "block", f"{bounds} as bounds"
    )


def mix(sized: DataFrame, shards: int = SHARDS, seed: str = SEED, blocks: int = BLOCKS) -> DataFrame:
    """Adds source_size, target, shard_words and taken to (row_hash, doc_id, source, size).

    ``sized`` must be settled, as it is read several times.  A null source is a source of its own; a
    document without words is never taken; an empty table gives an empty result.  Rows with the same
    id follow each other by size and ``row_hash``.
    """
    placed = running(
        sized.withColumn("_h", seeded(seed, "doc_id")), "source", ["_h", "size", "row_hash"], "size", "_start"
    )
    plan = settle(quotas(targets(sized), shards, blocks), "quotas")
    placed = lookup_small(placed, plan, "source", BROADCAST_SOURCES, "_h")
    most = F.col("source_size") * MOST

    def in_shard(j: Column) -> Column:
        low = F.least(F.col("bounds")[j] * F.col("block"), most)
        high = F.least(F.col("bounds")[j + 1] * F.col("block"), most)
        total = F.lit(0).cast("bigint")
        for turn in range(MOST):
            start = F.col("_start") + turn * F.col("source_size")
            total = total + F.greatest(
                F.lit(0), F.least(high, start + F.col("size")) - F.greatest(low, start)
            )
        return total

    shard_words = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), in_shard)
    return (
        placed.withColumn("shard_words", shard_words)
        .withColumn("taken", F.aggregate("shard_words", F.lit(0).cast("bigint"), lambda a, x: a + x))
        .drop("_h", "_start", "bounds", "block")
    )


def sized(docs: DataFrame) -> DataFrame:
    """(row_hash, doc_id, source, size) of every document, settled; a null text has no words."""
    return settle(docs.select(
        row_hash(docs).alias("row_hash"), "doc_id", "source", word_count(F.col("text")).alias("size")
    ), "sized")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as documents: every row as often as it is taken, to the nearest whole time."""
    drawn = mix(sized(docs), seed=seed).where("size > 0 and 2 * taken >= size")
    times = drawn.select("row_hash", F.expr("cast(round(taken / size) as int) as _times"))
    found = attached(docs, times)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
