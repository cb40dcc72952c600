"""K-d tree sharding: split at distributed weighted medians until leaves reach their bytes.

Equal texts form one group, which stays together.  A group's coordinates are order-preserving
numbers made from its metadata.  Each level picks, for every open node, the widest dimension and
finds the weighted median by counting: bytes are summed in ``BINS`` equal ranges of the dimension,
the range holding the median is cut again, until one coordinate is left or the halves are even
enough.  Cuts are a table with a row per node, joined to the groups: the plan of a level is the same
for two leaves and for a hundred thousand, and no sums come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import attached, lookup_small, row_hash, running, seeded, settle

SHARDS = 8
BINS = 512
NODES = 200_000  # cuts that are broadcast; beyond them the join is salted
EVEN = 1e-4  # a split may miss its share of the node by so much
TIES = 24  # low bits that order groups of the same value


def _text_number(column: str) -> Column:
    """The first bytes of a string as a number in the same order; null is lowest."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8"), 1, 4)), 8, "0")
    return F.conv(head, 16, 10).cast("bigint")


# Metadata dimensions, each at most 38 bits wide.
DIMENSIONS = {
    "d_id": lambda: F.pmod(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.lit(1 << 38)),
    "d_size": lambda: F.least(F.col("size"), F.lit((1 << 38) - 1)),
    "d_lang": lambda: _text_number("lang"),
    "d_source": lambda: _text_number("source"),
}


def grouped(docs: DataFrame) -> DataFrame:
    """(group, bytes, one coordinate per dimension): one row per distinct text.

    A group's metadata are the least values among its rows; the low bits come from the group's hash,
    so equal values can be parted without a sort.
    """
    parts = docs.select("group", "size", *[f().alias(d) for d, f in DIMENSIONS.items()])
    groups = parts.groupBy("group").agg(
        F.sum("size").alias("bytes"), *[F.min(d).alias(d) for d in DIMENSIONS]
    )
    tie = F.pmod(F.xxhash64("group"), F.lit(1 << TIES))
    return groups.select(
        "group", "bytes", *[(F.col(d) * (1 << TIES) + tie).alias(d) for d in DIMENSIONS]
    )


def _widest(groups: DataFrame) -> DataFrame:
    """(node, dim, low, high, below, share, bytes, cut): open nodes with the widest dimension of each.

    The median lies between ``low`` and ``high`` of that dimension, with ``below`` bytes under ``low``;
    the lower part is to get ``share`` bytes.
    """
    whole = groups.agg(*[(F.max(d) - F.min(d) + 1).alias(d) for d in DIMENSIONS]).first()
    spans = groups.where("shards > 1").groupBy("node", "shards").agg(
        F.sum("bytes").alias("bytes"),
        *[x for d in DIMENSIONS for x in (F.min(d).alias(f"{d}_0"), F.max(d).alias(f"{d}_1"))],
    )
    wide = [(F.col(f"{d}_1") - F.col(f"{d}_0")) / F.lit(float(whole[d] or 1)) for d in DIMENSIONS]
    dim = F.array_position(F.array(*wide), F.greatest(*wide)).cast("int")
    spans = spans.withColumn("dim", dim)
    low, high = (F.element_at(F.array(*[f"{d}_{i}" for d in DIMENSIONS]), F.col("dim")) for i in (0, 1))
    return spans.select(
        "node", "dim", low.alias("low"), (high + 1).alias("high"), F.lit(0).cast("bigint").alias("below"),
        (F.col("bytes") * F.expr("shards div 2") / F.col("shards")).alias("share"), "bytes",
        F.lit(None).cast("bigint").alias("cut"),
    )


def _at(dim: Column) -> Column:
    return F.element_at(F.array(*DIMENSIONS), dim)


def _narrowed(groups: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` after one round of counting: the range of each median cut again, or its place found."""
    asked = state.withColumn("step", F.greatest(F.lit(1), F.expr(f"(high - low + {BINS - 1}) div {BINS}")))
    at = lookup_small(groups, settle(asked, "asked"), "node", NODES, "group").withColumn("at", _at(F.col("dim")))
    sums = at.where("at >= low and at < high").groupBy("node", F.expr("(at - low) div step").alias("bin")).agg(
        F.sum("weight").alias("b")
    )
    # At most BINS rows per node.
    upto = Window.partitionBy("node").orderBy("bin")
    met = sums.withColumn("upto", F.sum("b").over(upto)).join(asked.select("node", "below", "share"), "node")
    over = met.where("below + upto > share").groupBy("node").agg(
        F.min(F.struct("bin", "b", "upto")).alias("first")
    )
    found = asked.join(over, "node", "left").withColumns({
        "from": F.col("low") + F.col("first.bin") * F.col("step"),
        "under": F.col("below") + F.col("first.upto") - F.col("first.b"),
        "above": F.col("below") + F.col("first.upto"),
    })
    short, beyond, near = F.expr("share - under"), F.expr("above - share"), F.lit(EVEN) * F.col("bytes")
    cut = (
        F.when(F.col("first").isNull(), F.col("high"))
        .when(short <= near, F.col("from"))
        .when(beyond <= near, F.col("from") + F.col("step"))
        .when(F.col("step") == 1, F.when(short <= beyond, F.col("from")).otherwise(F.col("from") + 1))
    )
    return found.select(
        "node", "dim", F.coalesce("from", "low").alias("low"),
        F.coalesce(F.least(F.col("high"), F.col("from") + F.col("step")), "high").alias("high"),
        F.coalesce("under", "below").alias("below"), "share", "bytes", cut.alias("cut"),
    )


def _cuts(groups: DataFrame) -> DataFrame:
    """(node, dim, cut): for each open node the coordinate from which its upper part starts.

    A table with a row per node, whatever their number; the driver only asks whether one is still open.
    """
    counted = groups.withColumnRenamed("bytes", "weight").drop("shards")
    done, state = [], settle(_widest(groups), "medians")
    while True:
        open_ = state.where("cut is null")
        if open_.isEmpty():
            break
        state = settle(_narrowed(counted, open_), "medians")
        done.append(state.where("cut is not null").select("node", "dim", "cut"))
    return reduce(DataFrame.union, done) if done else state.select("node", "dim", "cut")


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """(row_hash, doc_id, size, text_crc32, group, shard, slot) for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text (a null text has none) plus 1.  With ``target_bytes`` the
    number of shards follows from the total.  A group of equal texts larger than a shard stays whole;
    repeated rows count each; an empty table gives an empty result.  Slots follow a seeded order and
    have no gaps.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = settle(docs.select(
        row_hash(docs).alias("row_hash"), "doc_id", "lang", "source",
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("group"),
    ), "rows")
    # A node is named by its first shard and has ``shards`` of them; all come down to one together.
    groups = settle(grouped(rows).withColumn("node", F.lit(0)), "groups")
    if target_bytes:
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    groups = groups.withColumn("shards", F.lit(int(shards)))
    for _ in range((int(shards) - 1).bit_length()):
        told = lookup_small(groups, settle(_cuts(groups), "cuts"), "node", NODES, "group", "left")
        upper = F.coalesce(_at(F.col("dim")) >= F.col("cut"), F.lit(False))
        half = F.expr("shards div 2")
        groups = settle(told.select(
            "group", "bytes", *DIMENSIONS,
            F.when(upper, F.col("node") + half).otherwise(F.col("node")).cast("int").alias("node"),
            F.when(upper | (F.col("shards") == 1), F.col("shards") - half).otherwise(half).cast("int").alias("shards"),
        ), "nodes")
    placed = rows.join(groups.select("group", F.col("node").alias("shard")), "group")
    placed = settle(placed.withColumn("_h", seeded("slot", "doc_id", "text_crc32")), "placed")
    return running(
        placed.withColumn("_one", F.lit(1).cast("bigint")), "shard", ["_h", "size"], "_one", "slot"
    ).select("row_hash", "doc_id", "size", "text_crc32", "group", "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, shard, slot): the rows of ``docs`` with their places."""
    return attached(docs, shard(docs, shards).select("row_hash", "shard", "slot"))
