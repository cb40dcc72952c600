"""Checks over lines, streams, labels and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.registry import is_address, query
from sightline.functions.facts import once_per_row
from sightline.operators import quality as Q
from sightline.sources import tables, wire


# Facts put before a line's own: the first list is refused, the second is rare but right.
WRONG_FACTS = [
    '{"Hostname":{"name":"a","source":"Foo"}}',
    '{"Hostname":{"source":"Dhcp"}}',
    '{"IpV4":{"addr":"999.1.1.1"}}',
    '{"IpV4":{"addr":"hello"}}',
    '{"IpV4":{"addr":5}}',
    '{"Mac":{"addr":[300,1,2,3,4,5],"locally_administered":false}}',
    '{"Mac":{"addr":[0,1,2,3,4,5]}}',
    '{"Rtt":{"millis":-5}}',
    '{"Rtt":{"millis":4294967296}}',
    '{"Rtt":{}}',
    '{"DhcpLease":{"ip":"10.0.0.1","expires_at":"soon"}}',
    '{"OuiVendor":{"vendor":5}}',
    '{"Uplink":{"peer_mac":[1,2,3,4,5],"peer_port":"x"}}',
    '{"OuiVendor":{"vendor":"a"},"Rtt":{"millis":1}}',
    "{}",
    "null",
]
RARE_FACTS = [
    '{"DhcpLease":{"ip":"10.0.0.1","expires_at":null}}',
    '{"DhcpLease":{"ip":"10.0.0.1"}}',
    '{"Hostname":{"name":"","source":"Mdns"}}',
    '{"Rtt":{"millis":4294967295}}',
]
# Errors of failure records: all but the last four are refused.
ERRORS = [
    '"Foo"',
    "5",
    '{"RemoteFault":{"detail":"x"}}',
    '{"RemoteFault":{"status":70000,"detail":"x"}}',
    '{"Unauthorized":{"detail":"x","code":1}}',
    '"Timeout"',
    '{"RemoteFault":{"status":503,"detail":"x"}}',
    '{"SchemaMismatch":{"detail":"x","os_version_hint":"9"}}',
    '{"SchemaMismatch":{"detail":"x"}}',
]


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, seq, line) of the feed, some lines damaged by their number."""
    feed = tables.feed(spark, sf_dir)
    feed = feed.select("stream", "seq", "record", once_per_row(line=wire.record_json()))
    line, s = F.col("line"), F.col("seq")
    seen = F.col("record") == "observation"
    way = F.when(seen, s % 60)
    damaged = (
        F.when(way == 1, F.concat(F.lit("{"), line))
        .when(way == 2, F.concat(F.lit("["), line, F.lit("]")))
        .when(way == 3, F.replace(line, F.lit('{"obs_id"'), F.lit('{"record":"capability","obs_id"')))
        .when(way == 4, F.replace(line, F.lit('"obs_id"'), F.lit('"observation"')))
        .when(way == 5, F.replace(line, F.lit('{"obs_id"'), F.lit('{"score":0.5,"obs_id"')))
        .when(way == 6, F.replace(line, F.lit('"vantage"'), F.lit('"place":"x","vantage"')))
        .when(way == 7, F.regexp_replace(line, r'"connector_id":"[^"]*",', ""))
        .when(way == 8, F.regexp_replace(line, r'"observed_at":"[^"]*"', '"observed_at":"yesterday"'))
        .when(way == 9, F.lit(""))
        .when(way == 10, F.lit("  "))
        .when(way == 11, F.replace(line, F.lit('"IpV4":{'), F.lit('"IpV4":{"mask":24,')))
        .when(way == 12, F.regexp_replace(line, r'"facts":\[.*\]', '"facts":"none"'))
        .when(way == 13, F.regexp_replace(line, r',"vantage":"[^"]*"', ""))
        .when(way == 14, F.regexp_replace(line, r'"obs_id":"[^"]*"', '"obs_id":null'))
        .when(way == 15, F.regexp_replace(line, r'"obs_id":"[^"]*"', '"obs_id":5'))
        .when(way == 16, F.regexp_replace(line, r'"obs_id":"[^"]*"', '"obs_id":"no id"'))
        .when(way == 17, F.regexp_replace(line, r'"connector_id":"[^"]*"', '"connector_id":5'))
    )
    for i, bad in enumerate(WRONG_FACTS + RARE_FACTS):
        damaged = damaged.when(way == 18 + i, F.replace(line, F.lit('"facts":['), F.lit(f'"facts":[{bad},')))
    told = F.when(F.col("record") == "capability", s % 3)
    damaged = (
        damaged.when(told == 1, F.replace(line, F.lit('"kinds":['), F.lit('"kinds":["Foo",')))
        .when(told == 2, F.replace(line, F.lit('"kinds":['), F.lit('"kinds":[null,')))
    )
    for i, error in enumerate(ERRORS):
        damaged = damaged.when(
            (F.col("record") == "failure") & (s % len(ERRORS) == i),
            F.lit(f'{{"record":"failure","error":{error}}}'),
        )
    damaged = damaged.otherwise(line)
    return feed.select("stream", "seq", damaged.alias("line"))


@query(
    "dq_line_shape",
    f"""select stream, seq, case seq % 60 when 1 then 'malformed' when 2 then 'unrecognised'
         when 3 then 'ambiguous' when 4 then 'unrecognised' when 5 then 'unknown_key'
         when 6 then 'unknown_key' when 7 then 'missing_key' when 8 then 'wrong_type'
         when 10 then 'malformed' when 11 then 'unknown_key' else 'wrong_type' end as rule
       from feed where record = 'observation' and seq % 60 between 1 and {17 + len(WRONG_FACTS)}
         and seq % 60 <> 9
       union all
       select stream, seq, 'wrong_type' from feed join obs o on o.obs_id = seq
       where record = 'observation' and seq % 60 not between 1 and {17 + len(WRONG_FACTS)}
         and not {is_address('o.ipv4')}
       union all
       select stream, seq, 'wrong_type' from feed
       where record = 'capability' and seq % 3 > 0
         or record = 'failure' and seq % {len(ERRORS)} < {len(ERRORS) - 4}""",
)
def dq_line_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.line_shape(rendered_lines(spark, sf_dir))


@query(
    "dq_roundtrip",
    """select cast(obs_id as varchar) as obs_id from feed
       where record = 'observation' and seq % 7 in (1, 2, 3)""",
)
def dq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written with a space, a null, or another key order do not come back the same.

    Failures with a status or a hint do.
    """
    feed = tables.feed(spark, sf_dir)
    code = F.when(F.col("seq") % 2 == 0, "RemoteFault").otherwise("SchemaMismatch")
    feed = feed.withColumn("error_code", F.when(F.col("record") == "failure", code))
    feed = feed.select("stream", "seq", "record", "obs_id", once_per_row(line=wire.record_json()))
    line, s = F.col("line"), F.col("seq")
    way = F.when(F.col("record") == "observation", s % 7)
    other = (
        F.when(way == 1, F.replace(line, F.lit('"scope":'), F.lit('"scope": ')))
        .when(way == 2, F.regexp_replace(line, r'^\{("obs_id":"[^"]*"),("connector_id":"[^"]*")', r'{$2,$1'))
        .when(way == 3, F.regexp_replace(line, r"\}$", ',"raw_text":null}'))
        .otherwise(line)
    )
    lines = feed.select("stream", "seq", other.alias("line"), "obs_id")
    bad = Q.roundtrip(lines.drop("obs_id")).select("stream", "seq")
    return bad.join(lines.select("stream", "seq", "obs_id"), ["stream", "seq"]).select(
        F.col("obs_id").cast("string").alias("obs_id")
    )


def _check(name: str, body: str, *ctes: str):
    sql = f"select stream, seq, '{name.removeprefix('dq_')}' as rule, detail from ({body})"
    return query(name, sql, *ctes)


@query(
    "dq_terminal_failure",
    """select stream, seq, 'after_terminal_failure' as rule, cast(e.at as varchar) as detail
       from feed join (select stream, min(seq) as at from feed where record = 'failure' group by 1) e
         using (stream) where seq > e.at""",
)
def dq_terminal_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.after_terminal_failure(tables.feed(spark, sf_dir))


@_check(
    "dq_scripted_cancel",
    "select stream, seq, error_code as detail from feed where error_code = 'Cancelled'",
)
def dq_scripted_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scripted_cancel(tables.feed(spark, sf_dir))


@_check(
    "dq_duplicate_obs",
    """select stream, max(seq) as seq, cast(min(seq) as varchar) as detail from (
         select stream, seq, obs_id, row_number() over (partition by stream, obs_id order by seq) as r
         from feed where obs_id is not null) where r <= 2 group by stream, obs_id having count(*) = 2""",
)
def dq_duplicate_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_obs(tables.feed(spark, sf_dir))


@_check(
    "dq_foreign_connector",
    "select stream, seq, connector_id as detail from feed where connector_id <> stream",
)
def dq_foreign_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = tables.feed(spark, sf_dir)
    owners = feed.select("stream", F.col("stream").alias("owner")).distinct()
    return Q.foreign_connector(feed, owners)


@_check(
    "dq_uncovered_scope",
    """select stream, seq, cast(l2_domain as varchar) || '/' || cast(vantage as varchar) as detail
       from feed where record = 'observation' and vantage = 2""",
)
def dq_uncovered_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = tables.covered_scopes(tables.sightings(spark, sf_dir))
    return Q.uncovered_scope(tables.feed(spark, sf_dir), covered)


_FORCE = """
in_force as (
  select f.stream, f.seq, f.obs_id, coalesce(c.kinds, 'all') as kinds
  from feed f asof left join (select stream, seq, kinds from feed where record = 'capability') c
    on f.stream = c.stream and f.seq >= c.seq where f.record = 'observation')"""


@query(
    "win_capability_in_force",
    "select stream, seq, obs_id, case kinds when 'all' then 7 else 3 end as n_kinds from in_force",
    _FORCE,
)
def win_capability_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = Q.capability_in_force(tables.feed(spark, sf_dir))
    return held.select("stream", "seq", "obs_id", F.size("in_force").alias("n_kinds"))


@_check(
    "dq_undeclared_kind",
    """select distinct f.stream, f.seq, f.kind as detail from feed_facts f join in_force i using (stream, seq)
       where i.kinds = 'some' and f.kind not in ('Mac', 'IpV4', 'Hostname')""",
    _FORCE,
)
def dq_undeclared_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.undeclared_kind(tables.feed(spark, sf_dir))


_LATEST = """
latest as (
  select stream, seq, record, as_of, max(observed_at) over (partition by stream order by seq)
    as latest_observed_at from feed)"""


@query("win_running_max_observed", "select stream, seq, latest_observed_at from latest", _LATEST)
def win_running_max_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.running_max_observed(tables.feed(spark, sf_dir)).select(
        "stream", "seq", "latest_observed_at"
    )


@_check(
    "dq_capability_backdated",
    """select stream, seq, strftime(as_of, '%Y-%m-%d %H:%M:%S') as detail from latest
       where record = 'capability' and as_of < latest_observed_at""",
    _LATEST,
)
def dq_capability_backdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.capability_backdated(tables.feed(spark, sf_dir))


@_check(
    "dq_capability_order",
    """select stream, seq, strftime(as_of, '%Y-%m-%d %H:%M:%S') as detail from (
         select *, lag(as_of) over (partition by stream order by seq) as prior from feed
         where record = 'capability') where as_of < prior""",
)
def dq_capability_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.capability_order(tables.feed(spark, sf_dir))


@query(
    "dq_cross_stream_obs",
    """select obs_id, min(stream) as first_stream, count(distinct stream) as streams from feed
       where obs_id is not null group by 1 having count(distinct stream) > 1""",
)
def dq_cross_stream_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cross_stream_obs(tables.feed(spark, sf_dir))


@_check(
    "dq_mac_flag",
    """select stream, seq, value as detail from feed_facts f join obs o on o.obs_id = f.seq
       where f.kind = 'Mac' and o.mac_flag <> (substr(value, 2, 1) in ('2','3','6','7','a','b','e','f'))""",
)
def dq_mac_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.mac_flag(tables.feed(spark, sf_dir))


@query(
    "dq_address_rules",
    """select stream, seq, case when kind in ('IpV4', 'DhcpLease') then 'address_ip'
         when kind = 'Hostname' then 'address_hostname' end as rule, value as detail
       from feed_facts where (kind in ('IpV4', 'DhcpLease') and not (value like '192.0.2.%'
           or value like '198.51.100.%' or value like '203.0.113.%'))
         or (kind = 'Hostname' and value <> '' and value not like 'doc-%')
       union all select stream, seq, 'address_mac', value from feed_facts
         where kind in ('Mac', 'Uplink') and value not like '00:00:5e:00:01:%'
           and substr(value, 2, 1) not in ('2', '6', 'a', 'e')""",
)
def dq_address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.address_rules(tables.feed(spark, sf_dir))


_O = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPELLED = f"""
texts as (select 'd' || cast(doc_id as varchar) as id, text from documents
  union all select 'p' || cast(page_id as varchar), html from pages
  union all select 'o' || cast(obs_id as varchar), raw || ' ' || ipv4 || ' ' ||
    replace(coalesce(mac, '00:00:5e:00:01:07'), ':', '-') from obs where raw is not null
  union all select case_id, reason || ', seen at ' || ipv4 from labelled join obs on obs_id = first_id),
spelled as (select id, unnest(regexp_extract_all(replace(text, '-', ':'),
  '(^|[^0-9a-fA-F])((?:[0-9a-fA-F]{{2}}:){{5}}[0-9a-fA-F]{{2}}|{_O}(?:\\.{_O}){{3}})', 2)) as s from texts)"""


@query(
    "dq_text_addresses",
    """select id, case when s like '%:%' then 'mac' else 'ipv4' end as kind, lower(s) as address,
         case when s like '%:%' then lower(s) like '00:00:5e:00:01:%'
                or lower(substr(s, 2, 1)) in ('2', '6', 'a', 'e')
              else s like '192.0.2.%' or s like '198.51.100.%' or s like '203.0.113.%' end as allowed
       from spelled""",
    _SPELLED,
)
def dq_text_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in whole documents, whole pages, raw notes and the reasons of labels."""
    docs = tables.read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    pages = tables.read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text")
    )
    flat = tables.sighting_columns(spark, sf_dir).where("raw is not null")
    mac = F.coalesce("mac", F.lit("00:00:5e:00:01:07"))
    notes = flat.select(
        F.concat(F.lit("o"), F.col("obs_id").cast("string")).alias("id"),
        F.concat_ws(" ", "raw", "ipv4", F.replace(mac, F.lit(":"), F.lit("-"))).alias("text"),
    )
    seen = tables.sighting_columns(spark, sf_dir).select("obs_id", "ipv4")
    labels = tables.labelled_pairs(spark, sf_dir).select(
        "case_id", "reason", F.col("observations")[0].alias("obs_id")
    )
    reasons = labels.join(seen, "obs_id").select(
        F.col("case_id").alias("id"), F.concat_ws(", seen at ", "reason", "ipv4").alias("text")
    )
    return Q.text_addresses(docs.unionByName(pages).unionByName(notes).unionByName(reasons))


def flawed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled pairs, each damaged in one of fourteen ways or not at all."""
    labels = tables.labelled_pairs(spark, sf_dir)
    n = F.substring_index("case_id", "-", -1).cast("bigint")
    c, way = F.col, n % 20
    return labels.select(
        F.when(way == 0, "  ").when(way == 13, F.concat(F.lit(" CASE-"), (n + 1).cast("string")))
        .otherwise(c("case_id")).alias("case_id"),
        F.when(way == 6, "").otherwise(c("replay")).alias("replay"),
        F.when(way == 7, F.slice("observations", 1, 0))
        .when(way == 8, F.array(n, n)).otherwise(F.array(n, n + 1)).alias("observations"),
        F.when(way == 1, " ").when(way == 2, F.lit("two lines are\none too many"))
        .when(way == 3, "too short").when(way == 4, F.repeat(F.lit("long "), F.lit(70)))
        .otherwise(c("reason")).alias("reason"),
        F.when(way == 9, " ").when(way == 10, " padded").otherwise(c("family")).alias("family"),
        "expectation",
        F.when(way == 5, "").when(way == 11, F.concat(c("expected_rule"), F.lit(" ")))
        .otherwise(c("expected_rule")).alias("expected_rule"),
        "expected_cause",
        n.alias("n"),
    )


@query(
    "dq_label_rules",
    """select case way when 0 then '  ' else case_id end as case_id, case way
         when 0 then 'id_missing' when 1 then 'reason_missing' when 2 then 'reason_not_one_line'
         when 3 then 'reason_too_short' when 4 then 'reason_too_long' when 5 then 'rule_missing'
         when 6 then 'replay_missing' when 7 then 'observations_missing'
         when 8 then 'observation_repeated' when 9 then 'family_empty'
         when 10 then 'family_malformed' else 'rule_malformed' end as rule
       from (select *, first_id % 20 as way from labelled)
       where way in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10)
         or (way in (5, 11) and expectation <> 'must-abstain')
       union all select '  ', 'id_duplicate' where (select count(*) from labelled where first_id % 20 = 0) > 1
       union all select ' CASE-' || cast(first_id + 1 as varchar), 'id_duplicate' from labelled
         where first_id % 20 = 13 and first_id + 1 <= (select max(first_id) from labelled)""",
)
def dq_label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.label_rules(flawed_labels(spark, sf_dir))


@query(
    "join_dangling",
    """select l.case_id, x.obs_id from labelled l, (select obs_id, connector_id from obs) x
       where x.obs_id in (l.first_id, l.second_id) and x.connector_id <> l.replay""",
)
def join_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose second sighting belongs to another stream than the one they name."""
    labels, obs = tables.labelled_pairs(spark, sf_dir), tables.sightings(spark, sf_dir)
    return Q.dangling_labels(labels, obs).distinct()


