"""Views of the given tables in the shapes the operators take.

Every view covers its whole table.  ``events`` stand in for sightings (one
event, one sighting by the source named in ``event_type``) and ``customer`` for
the hand-kept declarations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.schemas import FACT_KINDS

FACT_TYPES = {
    "Mac": "struct<addr:string,locally_administered:boolean>",
    "IpV4": "struct<addr:string>",
    "Hostname": "struct<name:string,source:string>",
    "DhcpLease": "struct<ip:string,expires_at:timestamp_ntz>",
    "Uplink": "struct<peer_mac:string,peer_port:string>",
    "OuiVendor": "struct<vendor:string>",
    "Rtt": "struct<millis:bigint>",
}


# Column that spreads a table evenly when its scan has too few splits.
SPREAD = {
    "events": "event_id",
    "lineitem": "l_orderkey",
    "documents": "doc_id",
    "pages": "page_id",
    "customer": "c_custkey",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.

    A table of one unsplittable file would run every later expression in one
    task, so such a scan is spread over the cores by key.  A scan that has a
    split per core, as any large table does, is left as it is.  Filters and
    column choice still reach the file.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = min(spark.sparkContext.defaultParallelism, 64)
    if name in SPREAD and cores > 1 and table.rdd.getNumPartitions() * 2 <= cores:
        return table.repartition(cores, SPREAD[name])
    return table


FACTS_TYPE = "array<struct<" + ",".join(f"{k}:{t}" for k, t in FACT_TYPES.items()) + ">>"


def fact(kind: str, *fields: Column) -> Column:
    """One union element with only ``kind`` set."""
    parts = [
        x
        for k in FACT_KINDS
        for x in (F.lit(k), F.struct(*fields) if k == kind else F.lit(None).cast(FACT_TYPES[k]))
    ]
    return F.named_struct(*parts)


def facts_where(*tested: tuple[Column | None, Column]) -> Column:
    """Array of the facts whose test holds, in order; stays inside generated code."""
    none = F.array().cast(FACTS_TYPE)
    return F.concat(*[
        F.array(f) if test is None else F.when(test, F.array(f)).otherwise(none)
        for test, f in tested
    ])


# The flat form of a sighting: one column per fact it may carry.
SIGHTING = {
    "obs_id": "event_id",
    "connector_id": "event_type",
    "observed_at": "ts",
    "l2_domain": "cast(user_id % 4 as int)",
    "vantage": "cast(k % 3 as int)",
    "raw": "if(k % 4 = 0, props, null)",
}
SIGHTED = {
    "mac": """case when k % 10 = 0 then null
        when event_id % 200 = 3 then concat_ws(':', '06', substr(d, 1, 2), substr(d, 3, 2),
          substr(d, 5, 2), substr(d, 7, 2), substr(d, 9, 2))
        else concat('02:00:5e:00:', lpad(user_id % 90, 2, '0'), ':', lpad(user_id % 3, 2, '0')) end""",
    "mac2": "if(event_id % 50 = 1, concat('02:00:5e:01:', lpad(user_id % 90, 2, '0'), ':00'), null)",
    "ipv4": """if(event_id % 500 = 7, '10.9.9.9',
        concat_ws('.', '10', user_id div 256, user_id % 256, k % 4))""",
    "hostname": """case when k % 5 = 0 then null when user_id % 7 = 0 then ''
        when event_id % 97 = 0 then concat('alias-', user_id)
        else concat('host-', user_id % 60) end""",
    "rtt": "if(k % 3 = 0, cast(floor(value) as bigint), null)",
    "peer_mac": "if(k % 2 = 0, concat('02:00:5e:aa:00:', lpad(user_id % 12, 2, '0')), null)",
    "peer_port": "concat('ge-0/0/', user_id % 48)",
    "vendor": "if(user_id % 3 = 0, if(k % 11 = 0, '', event_type), null)",
    "lease_until": "if(event_type = 'signup', ts + interval 1 hour, null)",
    "mac_flag": "event_id % 1000 <> 11",
}


def sighting_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").selectExpr(
        "*",
        "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k",
        "lpad(event_id, 10, '0') as d",
    )
    # A boundary: readers of one fact do not repeat these expressions for every use.
    made = ", ".join(f"'{name}', {text}" for name, text in SIGHTED.items())
    return events.selectExpr(
        *[f"{text} as {name}" for name, text in SIGHTING.items()],
        f"inline(array(named_struct({made})))",
    )


def _fact_sql(kind: str, fields: str) -> str:
    parts = [
        f"'{k}', {f'named_struct({fields})' if k == kind else f'cast(null as {FACT_TYPES[k]})'}"
        for k in FACT_KINDS
    ]
    return f"array(named_struct({', '.join(parts)}))"


# Facts in order: the column that must be there, the kind, and its fields.
FACT_COLUMNS = [
    ("ipv4", "IpV4", "'addr', ipv4"),
    ("hostname", "Hostname", "'name', hostname, 'source', 'Dhcp'"),
    ("mac", "Mac", "'addr', mac, 'locally_administered', mac_flag"),
    ("mac2", "Mac", "'addr', mac2, 'locally_administered', mac_flag"),
    ("rtt", "Rtt", "'millis', rtt"),
    ("peer_mac", "Uplink", "'peer_mac', peer_mac, 'peer_port', peer_port"),
    ("vendor", "OuiVendor", "'vendor', vendor"),
    ("lease_until", "DhcpLease", "'ip', ipv4, 'expires_at', lease_until"),
]


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, connector_id, observed_at, l2_domain, vantage, facts, raw)."""
    none = f"cast(array() as {FACTS_TYPE})"
    facts = ", ".join(
        f"if({column} is null, {none}, {_fact_sql(kind, fields)})"
        for column, kind, fields in FACT_COLUMNS
    )
    return sighting_columns(spark, sf_dir).selectExpr(
        "obs_id", "connector_id", "observed_at", "l2_domain", "vantage",
        f"concat({facts}) as facts", "raw",
    )


DECLARED = {
    "ipv4": "concat_ws('.', '10', c_custkey div 256, c_custkey % 256, c_custkey % 5)",
    "hostname": "if(c_custkey % 7 = 0, concat('nas-', c_custkey), concat('host-', c_custkey % 60))",
    "mac": """if(c_custkey % 4 = 0, null, concat('02:00:5e:00:', lpad(c_custkey % 90, 2, '0'), ':',
        lpad(if(c_custkey % 6 = 0, 9, c_custkey % 3), 2, '0')))""",
    "serial": "if(c_mktsegment = 'BUILDING', concat('sn-', c_custkey), null)",
}


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declared attribute per row, with its provenance; every customer is an entity."""
    said = ", ".join(f"'{name}', {text}" for name, text in DECLARED.items())
    return (
        read_table(spark, sf_dir, "customer")
        .selectExpr(
            "c_custkey as entity_id",
            f"stack({len(DECLARED)}, {said}) as (attr_key, attr_value)",
            "case c_custkey % 3 when 0 then 'manual' when 1 then 'adopted' else 'imported' end as origin",
            "if(c_custkey % 3 = 1, c_custkey, null) as origin_obs_id",
            "concat('operator-', c_nationkey) as actor_id",
            "timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(0, cast(c_custkey as int))"
            " as updated_at",
        )
        .where("attr_value is not null")
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered records per source: sightings, capability records and failures.

    ``seq`` is the arrival number.  Some sightings repeat an earlier id, in the
    same stream or in another, and some stand outside the covered scopes.
    """
    e = F.col("obs_id")
    kind = (
        F.when(e % 53 == 0, "capability").when(e % 997 == 1, "failure").otherwise("observation")
    )
    kinds = F.when(
        e % 2 == 0, F.array(*map(F.lit, FACT_KINDS))
    ).otherwise(F.array(*map(F.lit, ["Mac", "IpV4", "Hostname"])))
    code = (
        F.when(e % 5 == 0, "Unreachable").when(e % 5 == 1, "Cancelled")
        .when(e % 5 == 2, "Timeout").otherwise("Unauthorized")
    )
    seen = F.col("record") == "observation"
    base = sightings(spark, sf_dir).withColumn("record", kind)
    return base.select(
        F.col("connector_id").alias("stream"),
        e.alias("seq"),
        "record",
        F.when(seen, F.when(e % 401 == 5, e - 5).otherwise(e)).alias("obs_id"),
        F.when(
            seen, F.when(e % 701 == 2, F.lit("stranger")).otherwise(F.col("connector_id"))
        ).alias("connector_id"),
        F.when(seen, F.col("observed_at")).alias("observed_at"),
        F.when(seen, F.col("l2_domain")).alias("l2_domain"),
        F.when(seen, F.col("vantage")).alias("vantage"),
        F.when(seen, F.col("facts")).alias("facts"),
        F.when(seen, F.col("raw")).alias("raw"),
        F.when(
            F.col("record") == "capability",
            F.when(e % 3 == 0, F.col("observed_at") - F.expr("interval 2 days")).otherwise(
                F.col("observed_at")
            ),
        ).alias("as_of"),
        F.when(F.col("record") == "capability", kinds).alias("kinds"),
        F.when(F.col("record") == "failure", code).alias("error_code"),
        F.when(F.col("record") == "failure", "no answer").alias("error_detail"),
        F.when(F.col("record") == "failure", (e % 600).cast("int")).alias("error_status"),
        F.when((F.col("record") == "failure") & (e % 2 == 0), "os 9").alias("error_hint"),
    )


def covered_scopes(obs: DataFrame) -> DataFrame:
    """Scopes a source answers for: here every domain seen from vantage 0 or 1."""
    return obs.where("vantage < 2").select(
        F.col("connector_id").alias("stream"), "l2_domain", "vantage"
    ).distinct()


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled case per sighting; most name the sighting and the next one by id."""
    e = F.col("event_id")
    partner = F.when(e % 29 == 0, e).otherwise(e + 1)
    wants = (
        F.when(e % 3 == 0, "must-merge").when(e % 3 == 1, "must-not-merge").otherwise("must-abstain")
    )
    rule = (
        F.when(e % 13 == 0, "l2-hostname-agrees")
        .when(e % 2 == 0, "l1-exact-mac")
        .otherwise("l1-distinct-mac")
    )
    last = read_table(spark, sf_dir, "events").agg(F.max("event_id")).scalar()
    return (
        read_table(spark, sf_dir, "events")
        .where(e < last)
        .select(
            F.concat(F.lit("case-"), e.cast("string")).alias("case_id"),
            F.col("event_type").alias("replay"),
            F.when(e % 31 == 0, F.array(e)).otherwise(F.array(e, partner)).alias("observations"),
            F.concat(F.lit("sightings of user "), F.col("user_id").cast("string"),
                     F.lit(" compared")).alias("reason"),
            F.when(e % 17 != 0, F.concat(
                F.when(e % 2 == 0, "Family-").otherwise("family-"),
                (F.col("user_id") % 40).cast("string"),
            )).alias("family"),
            wants.alias("expectation"),
            F.when(wants != "must-abstain", rule).alias("expected_rule"),
            F.when(wants == "must-abstain", "absence_of_proof").alias("expected_cause"),
        )
    )
