"""IPv4 arithmetic on BIGINT and the rules saying which addresses are allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.facts import is_locally_administered, is_multicast

# Dotted quad without leading zeros, each octet 0..255.
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{OCTET}(\.{OCTET}){{3}}$"

# The three documentation ranges.
DOCUMENTATION_PREFIXES = ["192.0.2.", "198.51.100.", "203.0.113."]

# The reserved virtual-router block, five octets.
VIRTUAL_PREFIX = "00:00:5e:00:01:"


def is_ipv4(text: Column) -> Column:
    return text.rlike(IPV4_PATTERN)


def ipv4_to_long(text: Column) -> Column:
    """BIGINT form of a dotted quad, NULL when it is not one."""
    parts = F.split(text, r"\.")
    octet = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    number = octet[0] * (1 << 24) + octet[1] * (1 << 16) + octet[2] * (1 << 8) + octet[3]
    return F.when(is_ipv4(text), number)


def long_to_ipv4(number: Column) -> Column:
    octets = [
        F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)
    ]
    return F.concat_ws(".", *octets)


def aligned_blocks(low: Column, high: Column) -> Column:
    """The aligned power-of-two blocks that make up [low, high]: at most 62, as (level, block).

    A block holds the numbers with ``number >> level = block``.  At each level only the block at either end
    can be in no larger one: the first where its place is odd, the last where the place after it is.
    """

    def ends(k: Column) -> Column:
        first = F.call_function("shiftright", low + F.pow(F.lit(2), k).cast("bigint") - 1, k)
        after = F.call_function("shiftright", high + 1, k)
        some = first < after
        pick = lambda test, block: F.when(
            some & test, F.struct(k.alias("level"), block.alias("block"))
        )
        return F.array(
            pick(F.pmod(first, F.lit(2)) == 1, first), pick(F.pmod(after, F.lit(2)) == 1, after - 1)
        )

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), ends)))


def is_documentation_ip(text: Column) -> Column:
    test = F.lit(False)
    for prefix in DOCUMENTATION_PREFIXES:
        test = test | text.startswith(prefix)
    return test


def is_virtual_mac(mac: Column) -> Column:
    return mac.startswith(VIRTUAL_PREFIX)


def is_synthetic_mac(mac: Column) -> Column:
    """Locally administered and not multicast, or in the reserved virtual block."""
    return (is_locally_administered(mac) & ~is_multicast(mac)) | is_virtual_mac(mac)


def is_invented_hostname(name: Column) -> Column:
    return (name == "") | name.startswith("doc-")
