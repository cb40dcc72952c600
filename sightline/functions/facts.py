"""Column expressions over facts, sources and ids.

Everything here is a JVM-side expression: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.schemas import DECLARABLE, FACT_KINDS, NIL_ID, OPEN_END

MAC_PATTERN = "^([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}$"


def kind_of(fact: Column) -> Column:
    """Kind of a fact: the one union member that is set."""
    return F.coalesce(*[F.when(fact[k].isNotNull(), F.lit(k)) for k in FACT_KINDS])


def _value_of(fact: Column) -> dict[str, Column]:
    return {
        "IpV4": fact["IpV4"]["addr"],
        "Hostname": fact["Hostname"]["name"],
        "Mac": fact["Mac"]["addr"],
    }


def declarable_field(fact: Column) -> Column:
    """Name of the declared field a fact speaks about, NULL for the other kinds."""
    return F.coalesce(
        *[F.when(fact[k].isNotNull(), F.lit(name)) for k, name in DECLARABLE.items()]
    )


def declarable_value(fact: Column) -> Column:
    return F.coalesce(*[_value_of(fact)[k] for k in DECLARABLE])


def display_field(fact: Column) -> Column:
    return F.coalesce(declarable_field(fact), F.when(fact["Rtt"].isNotNull(), F.lit("rtt")))


def display_value(fact: Column) -> Column:
    rtt = F.concat(fact["Rtt"]["millis"].cast("string"), F.lit(" ms"))
    return F.coalesce(declarable_value(fact), rtt)


def exploded_facts(obs: DataFrame, *carry: str) -> DataFrame:
    """One row per fact, with its position; ``carry`` names the columns to keep."""
    return obs.select(*carry, F.posexplode("facts").alias("pos", "fact"))


def declarable_fields(obs: DataFrame, *carry: str) -> DataFrame:
    """(…carry, pos, field, value) for ipv4, hostname and mac, duplicates kept."""
    facts = exploded_facts(obs, *carry)
    fact = F.col("fact")
    return facts.select(
        *carry, "pos", declarable_field(fact).alias("field"), declarable_value(fact).alias("value")
    ).where("field is not null")


def display_fields(obs: DataFrame, *carry: str) -> DataFrame:
    facts = exploded_facts(obs, *carry)
    fact = F.col("fact")
    return facts.select(
        *carry, "pos", display_field(fact).alias("field"), display_value(fact).alias("value")
    ).where("field is not null")


def addresses(facts: str = "facts") -> Column:
    """Distinct ipv4 addresses of one sighting, as an array (in-row, no shuffle)."""
    return F.array_compact(F.array_distinct(F.col(f"{facts}.IpV4.addr")))


def macs(facts: str = "facts") -> Column:
    """Distinct own macs of one sighting; uplink peers are never among them."""
    return F.array_compact(F.array_distinct(F.col(f"{facts}.Mac.addr")))


def kinds_present(facts: str = "facts") -> Column:
    return F.array_distinct(F.transform(F.col(facts), kind_of))


def mac_text(octets: Column) -> Column:
    """Six integers to ``aa:bb:cc:dd:ee:ff``."""
    return F.array_join(F.transform(octets, lambda b: F.lpad(F.lower(F.hex(b)), 2, "0")), ":")


def mac_parse(text: Column) -> Column:
    """Canonical text of a colon-separated mac, NULL when it is not one."""
    return F.when(text.rlike(MAC_PATTERN), F.lower(text))


def mac_octets(text: Column) -> Column:
    """Canonical text back to six integers."""
    return F.transform(F.split(text, ":"), lambda x: F.conv(x, 16, 10).cast("int"))


def first_octet(mac: Column) -> Column:
    return F.conv(F.substring(mac, 1, 2), 16, 10).cast("int")


def is_locally_administered(mac: Column) -> Column:
    """Bit 0x02 of the first octet of a canonical mac."""
    return first_octet(mac).bitwiseAND(F.lit(2)) != 0


def is_multicast(mac: Column) -> Column:
    return first_octet(mac).bitwiseAND(F.lit(1)) != 0


def carries_address(address: Column, facts: str = "facts") -> Column:
    """Does the sighting carry this ipv4?"""
    return F.exists(F.col(facts), lambda f: f["IpV4"]["addr"].eqNullSafe(address))


def can_emit(kinds: Column, kind: Column) -> Column:
    return F.coalesce(F.array_contains(kinds, kind), F.lit(False))


def is_blinding(code: Column) -> Column:
    """Every error blinds its source except a cancellation."""
    return code != F.lit("Cancelled")


def int_div(numerator: Column, divisor: Column | int) -> Column:
    """Integer division truncating towards zero, exact on 64-bit values."""
    return F.call_function("div", numerator, F.lit(divisor))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, truncated towards zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return int_div(micros, 1_000_000)


def age_bucket(now: Column, then: Column) -> Column:
    """(unit, n): ahead, just_now, minutes, hours or days.  ``now`` is a parameter."""
    s = seconds_between(now, then)
    unit = (
        F.when(s < 0, "ahead")
        .when(s < 60, "just_now")
        .when(s < 3600, "minutes")
        .when(s < 86400, "hours")
        .otherwise("days")
    )
    n = (
        F.when(s < 60, F.lit(None))
        .when(s < 3600, int_div(s, 60))
        .when(s < 86400, int_div(s, 3600))
        .otherwise(int_div(s, 86400))
    )
    return F.struct(unit.alias("unit"), n.cast("bigint").alias("n"))


def source_label(connector_id: Column) -> Column:
    return F.substring(connector_id, 1, 8)


def subject_of(interface_id: Column) -> Column:
    """The slot a link occupies: its interface, or the nil id for an abstention."""
    return F.coalesce(interface_id, F.lit(NIL_ID))


def current_subject_of(interface_id: Column, valid_to: Column) -> Column:
    return F.when(valid_to == open_end(), subject_of(interface_id))


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp_ntz")


def url_escape(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``- _ . ~ :``."""
    # The form encoder writes space as '+', keeps '*', and escapes ':' and '~'.
    out = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%3A", ":"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def uuid_shaped(*parts: Column) -> Column:
    """A stable id in UUID shape from a digest of the parts; never the nil id."""
    digest = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("8"), F.substring(digest, 14, 3)),
        F.concat(F.lit("8"), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def once_per_row(**columns: Column) -> Column:
    """Columns computed once per row and then read any number of times.

    A projection over a parse is merged with it and repeats the parse for every
    field read; a generator is a boundary the optimizer keeps.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
