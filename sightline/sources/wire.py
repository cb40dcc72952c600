"""JSON Lines: ordered polls of tagged-fact records, read and written.

One file is one poll of one source and the order of its lines is meaning, so
every line gets its number.  Files are read as splittable text: a line's place
is (offset of its split, order inside the split), which holds however a large
file is divided between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions.facts import (
    is_locally_administered,
    mac_octets,
    mac_text,
    once_per_row,
)
from sightline.plans.skew import lookup
from sightline.sources.tables import FACT_TYPES, fact, facts_where

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
ISO_PATTERN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z$"

# Instants stay text in the union schema: only UTC spellings are accepted.
LINE_SCHEMA = S.WIRE_RECORD.replace(" timestamp", " string").replace(":timestamp", ":string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stream, seq, line): every line of every file, numbered from 0, empty ones included."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("stream"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_in_split"),
    )
    return numbered(lines)


def numbered(lines: DataFrame) -> DataFrame:
    """(stream, seq, line) of lines with ``_split``, the start of their part of the file, and ``_in_split``.

    ``_in_split`` grows by one from line to line of a part.  Only a count and a first value per part
    are gathered; the lines stay where they were read.
    """
    parts = lines.groupBy("stream", "_split").agg(
        F.count("*").alias("_n"), F.min("_in_split").alias("_first")
    )
    before = Window.partitionBy("stream").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = lookup(lines, starts, ["stream", "_split"], "_n", "_in_split")
    seq = F.col("_start") + F.col("_in_split") - F.col("_first")
    return placed.select("stream", seq.cast("bigint").alias("seq"), "line")


def packed(poll: Column, line: Column) -> Column:
    """A line behind the name of its poll, so that many short polls may stand in one file.

    A file each would cost more to open, name and list than its lines do to read.
    """
    return F.concat(poll.cast("string"), F.lit("\t"), line)


def unpacked(lines: DataFrame) -> DataFrame:
    """(stream, poll, seq, line) of packed lines; ``seq`` is still the place in the file."""
    tab = F.instr("line", "\t")
    return lines.select(
        "stream", F.substring("line", F.lit(1), tab - 1).alias("poll"), "seq",
        F.substring("line", tab + 1, F.length("line")).alias("line"),
    )


def in_poll(poll: list[str]) -> Column:
    """A line's number in its poll, from 0, over rows of every line, empty ones too.

    The lines of a poll stand together in one file; ask this of narrow rows, as they are shuffled.
    """
    return F.col("seq") - F.min("seq").over(Window.partitionBy(*poll))


def utc(text: Column) -> Column:
    return F.when(text.rlike(ISO_PATTERN), F.regexp_replace(text, "Z$", "")).try_cast(
        "timestamp_ntz"
    )


def _ingested(f: Column) -> Column:
    """A wire fact as the library keeps it: macs as canonical text."""
    parts = {
        "Mac": F.struct(mac_text(f["Mac"]["addr"]), f["Mac"]["locally_administered"]),
        "IpV4": f["IpV4"],
        "Hostname": f["Hostname"],
        "DhcpLease": F.struct(f["DhcpLease"]["ip"], utc(f["DhcpLease"]["expires_at"])),
        "Uplink": F.struct(mac_text(f["Uplink"]["peer_mac"]), f["Uplink"]["peer_port"]),
        "OuiVendor": f["OuiVendor"],
        "Rtt": f["Rtt"],
    }
    return F.struct(
        *[F.when(f[k].isNotNull(), v.cast(FACT_TYPES[k])).alias(k) for k, v in parts.items()]
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records of the non-empty lines; every column of other record kinds is NULL."""
    return parse_every(lines.where("line <> ''"))


def parse_every(lines: DataFrame, *carry: str) -> DataFrame:
    """Records of all lines, those of empty ones all NULL; ``carry`` names columns to keep."""
    read = F.from_json("line", LINE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("stream", "seq", "line", *carry, once_per_row(r=read))
    code = F.coalesce(F.element_at(F.json_object_keys("r.error"), 1), F.col("r.error"))
    boxed = F.from_json("r.error", "map<string,struct<detail:string,status:int,os_version_hint:string>>")
    told = F.element_at(F.map_values(boxed), 1)
    return parsed.select(
        "stream",
        "seq",
        F.when(F.col("r.obs_id").isNotNull() & F.col("r.record").isNull(), "observation")
        .otherwise(F.col("r.record"))
        .alias("record"),
        "r.obs_id",
        "r.connector_id",
        utc(F.col("r.observed_at")).alias("observed_at"),
        F.col("r.scope.l2_domain").alias("l2_domain"),
        F.col("r.scope.vantage").alias("vantage"),
        F.transform("r.facts", _ingested).alias("facts"),
        "r.raw",
        utc(F.col("r.as_of")).alias("as_of"),
        "r.kinds",
        code.alias("error_code"),
        told["detail"].alias("error_detail"),
        told["status"].alias("error_status"),
        told["os_version_hint"].alias("error_hint"),
        "line",
        *carry,
    )


def observations_only(records: DataFrame) -> DataFrame:
    """The sightings of a stream; control records are left out."""
    return records.where("obs_id is not null")


def iso(at: Column) -> Column:
    return F.date_format(at, ISO)


def _wired(f: Column) -> Column:
    return F.struct(
        F.when(
            f["Mac"].isNotNull(),
            F.struct(
                mac_octets(f["Mac"]["addr"]).alias("addr"),
                f["Mac"]["locally_administered"].alias("locally_administered"),
            ),
        ).alias("Mac"),
        f["IpV4"].alias("IpV4"),
        f["Hostname"].alias("Hostname"),
        F.when(
            f["DhcpLease"].isNotNull(),
            F.struct(
                f["DhcpLease"]["ip"].alias("ip"), iso(f["DhcpLease"]["expires_at"]).alias("expires_at")
            ),
        ).alias("DhcpLease"),
        F.when(
            f["Uplink"].isNotNull(),
            F.struct(
                mac_octets(f["Uplink"]["peer_mac"]).alias("peer_mac"),
                f["Uplink"]["peer_port"].alias("peer_port"),
            ),
        ).alias("Uplink"),
        f["OuiVendor"].alias("OuiVendor"),
        f["Rtt"].alias("Rtt"),
    )


def observation_json() -> Column:
    """One sighting as its line; absent parts are left out, never written as null."""
    return F.to_json(
        F.struct(
            F.col("obs_id").cast("string").alias("obs_id"),
            "connector_id",
            iso(F.col("observed_at")).alias("observed_at"),
            F.struct(
                F.col("l2_domain").cast("string").alias("l2_domain"),
                F.col("vantage").cast("string").alias("vantage"),
            ).alias("scope"),
            F.transform("facts", _wired).alias("facts"),
            "raw",
        )
    )


def capability_json() -> Column:
    return F.to_json(
        F.struct(F.lit("capability").alias("record"), iso(F.col("as_of")).alias("as_of"), "kinds")
    )


def failure_json() -> Column:
    """A failure record; its status and hint are written for the codes that have them."""
    code = F.col("error_code")
    detail = F.coalesce("error_detail", F.lit("")).alias("detail")
    box = (
        F.when(code == "RemoteFault", F.to_json(F.struct(F.col("error_status").alias("status"), detail)))
        .when(code == "SchemaMismatch", F.to_json(F.struct(detail, F.col("error_hint").alias("os_version_hint"))))
        .otherwise(F.to_json(F.struct(detail)))
    )
    boxed = F.concat(F.lit('{"'), code, F.lit('":'), box, F.lit("}"))
    error = F.when(code.isin("Timeout", "Cancelled"), F.concat(F.lit('"'), code, F.lit('"')))
    return F.concat(F.lit('{"record":"failure","error":'), F.coalesce(error, boxed), F.lit("}"))


def record_json() -> Column:
    """Line of any record; needs the columns :func:`parse_lines` yields."""
    return (
        F.when(F.col("record") == "capability", capability_json())
        .when(F.col("record") == "failure", failure_json())
        .otherwise(observation_json())
    )


def controller_clients(payloads: DataFrame, connector_id: str, l2_domain: str) -> DataFrame:
    """Controller client lists as sightings.  ``payloads`` is (poll, body), body the JSON text.

    The mac is always a fact; a hostname only when its key is present (kept when
    empty); the vendor is kept when empty; no uplink is derived.
    """
    client = (
        "struct<mac:string,ip:string,hostname:string,oui:string,last_seen:bigint,"
        "is_wired:boolean,sw_port:int,network_id:string>"
    )
    rows = payloads.select(
        "poll",
        F.posexplode(F.from_json("body", f"data array<{client}>")["data"]).alias("seq", "c"),
    )
    c = F.col("c")
    own = F.lower(c["mac"])
    facts = facts_where(
        (
            c["mac"].isNotNull(),
            fact("Mac", own.alias("addr"),
                 is_locally_administered(own).alias("locally_administered")),
        ),
        (c["ip"].isNotNull(), fact("IpV4", c["ip"].alias("addr"))),
        (
            c["hostname"].isNotNull(),
            fact("Hostname", c["hostname"].alias("name"), F.lit("Dhcp").alias("source")),
        ),
        (c["oui"].isNotNull(), fact("OuiVendor", c["oui"].alias("vendor"))),
    )
    return rows.select(
        "poll",
        "seq",
        F.lit(connector_id).alias("connector_id"),
        F.timestamp_seconds(c["last_seen"]).alias("observed_at"),
        F.lit(l2_domain).alias("l2_domain"),
        c["network_id"].alias("vantage"),
        facts.alias("facts"),
    )
