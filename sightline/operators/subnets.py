"""Subnets: expansion to hosts, occupancy, and the next free address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.address import aligned_blocks, ipv4_to_long, is_ipv4, long_to_ipv4
from sightline.plans.lineage import cut
from sightline.plans.skew import lookup

# Prefixes shorter than this are refused as too large.
SHORTEST_PREFIX = 22


def cidr_parts(cidrs: DataFrame) -> DataFrame:
    """Each cidr with its network, size and, when it is refused, the reason."""
    c = F.col("cidr")
    slash = F.instr(c, "/")
    address = F.substr(c, F.lit(1), F.greatest(slash - 1, F.lit(0)))
    tail = F.substr(c, slash + 1)
    prefix = F.when(tail.rlike(r"^\+?[0-9]{1,9}$"), tail.try_cast("int"))
    error = (
        F.when(F.coalesce(slash == 0, F.lit(True)), "no_prefix")
        .when(~is_ipv4(address), "bad_address")
        .when(prefix.isNull(), "bad_prefix")
        .when(prefix > 32, "prefix_exceeds_32")
        .when(prefix < SHORTEST_PREFIX, "too_large")
    )
    host_bits = (F.lit(32) - prefix).cast("int")
    size = F.when(error.isNull(), F.pow(F.lit(2.0), host_bits).cast("bigint"))
    base = F.when(error.isNull(), ipv4_to_long(address))
    return cidrs.select(
        "*",
        prefix.alias("prefix"),
        (base - F.pmod(base, size)).alias("network"),
        size.alias("size"),
        error.alias("error"),
    )


def subnet_hosts(cidrs: DataFrame) -> DataFrame:
    """(cidr, host, error): hosts of each subnet, or one row with the reason it is refused.

    At most 1024 rows per cidr; network and broadcast are left out up to /30.
    """
    parts = cidr_parts(cidrs.select("cidr"))
    ends = F.when(F.col("prefix") <= 30, 1).otherwise(0).cast("bigint")
    offsets = F.sequence(ends, F.col("size") - 1 - ends)
    number = F.explode_outer(F.when(F.col("error").isNull(), offsets))
    rows = parts.select("cidr", "network", "error", number.alias("offset"))
    return rows.select(
        "cidr",
        F.when(F.col("error").isNull(), long_to_ipv4(F.col("network") + F.col("offset"))).alias(
            "host"
        ),
        "error",
    )


def range_blocks(ranges: DataFrame) -> DataFrame:
    """Each range (low, high as BIGINT) as the aligned blocks it is made of, whatever its width."""
    blocks = F.explode(aligned_blocks(F.col("low"), F.col("high")))
    return ranges.select("*", blocks.alias("_cut")).select(
        *ranges.columns, F.col("_cut.level").alias("level"), F.col("_cut.block").alias("block")
    )


def range_cidrs(ranges: DataFrame) -> DataFrame:
    """Each range as the fewest cidrs that cover it and nothing else."""
    first = F.call_function("shiftleft", F.col("block"), F.col("level"))
    cidr = F.concat_ws("/", long_to_ipv4(first), (32 - F.col("level")).cast("string"))
    return range_blocks(ranges).select(*ranges.columns, cidr.alias("cidr"))


def in_ranges(rows: DataFrame, ranges: DataFrame, number: str, spread_on: str) -> DataFrame:
    """Each row with every range holding its number: an equality on the block, at the levels in use.

    A range is at most 62 rows and a row at most 33, however wide the ranges; blocks that many rows fall
    into are salted by ``spread_on``.
    """
    blocks = cut(range_blocks(ranges))
    levels = sorted(r.level for r in blocks.select("level").distinct().collect())  # at most 33
    every = F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))
    place = F.call_function("shiftright", F.col(number), F.col("level"))
    met = rows.where(F.col(number).isNotNull()).withColumn("level", every).withColumn("block", place)
    weights = met.groupBy("level", "block").agg(F.count("*").alias("_n"))
    return lookup(
        met, blocks, ["level", "block"], "_n", spread_on, weights=weights
    ).drop("level", "block")


def subnet_of(address: Column) -> Column:
    """The /24 an address lies in, as ``a.b.c.0/24``."""
    return F.concat(F.substring_index(address, ".", 3), F.lit(".0/24"))


def last_octet(address: Column) -> Column:
    return F.substring_index(address, ".", -1).cast("int")


def cell_state(octet: Column, used: Column, reserved: Column) -> Column:
    """State of one cell; each takes precedence over the next."""
    return (
        F.when(octet.isin(0, 255), "structural")
        .when(F.coalesce(used, F.lit(False)), "used")
        .when(F.coalesce(reserved, F.lit(False)), "reserved")
        .otherwise("free")
    )


def occupied_cells(used: DataFrame, reserved: DataFrame) -> DataFrame:
    """(subnet, octet, state) of the cells that are used or reserved.

    Both inputs are frames with an ``ipv4`` column and may repeat addresses.
    """
    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            subnet_of(F.col("ipv4")).alias("subnet"),
            last_octet(F.col("ipv4")).alias("octet"),
            F.lit(name == "used").alias("used"),
        )

    both = cells(used, "used").unionByName(cells(reserved, "reserved"))
    merged = both.groupBy("subnet", "octet").agg(F.bool_or("used").alias("used"))
    state = cell_state(F.col("octet"), F.col("used"), F.lit(True))
    return merged.select("subnet", "octet", state.alias("state"))


def occupancy(used: DataFrame, reserved: DataFrame) -> DataFrame:
    """Used, reserved and free hosts of each subnet, counted over 1..254."""
    def n(state: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("state") == state, 1)), F.lit(0)).cast("bigint")

    return (
        occupied_cells(used, reserved)
        .groupBy("subnet")
        .agg(n("used").alias("used"), n("reserved").alias("reserved"))
        .withColumn("free", F.lit(254).cast("bigint") - F.col("used") - F.col("reserved"))
    )


def next_free(used: DataFrame, reserved: DataFrame) -> DataFrame:
    """Lowest free host of each subnet, NULL when it is full.

    The collected set is one subnet's octets: 256 values at most.
    """
    taken = occupied_cells(used, reserved).groupBy("subnet").agg(
        F.collect_set("octet").alias("octets")
    )
    hosts = F.sequence(F.lit(1), F.lit(254))
    octet = F.array_min(F.array_except(hosts, F.col("octets")))
    base = F.substring_index("subnet", ".", 3)
    return taken.select(
        "subnet", F.concat_ws(".", F.when(octet.isNotNull(), base), octet.cast("string")).alias("host")
    ).withColumn("host", F.when(F.col("host") != "", F.col("host")))
