"""Device-level and source-state queries: specified or labelled work, built on the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.catalog.linking import (
    DIFF,
    INTERFACE,
    earlier_sightings,
    pairs_of,
    passes,
    second_pass,
)
from sightline.catalog.reconcile import PERIMETER
from sightline.catalog.registry import EARLIER, NOW, is_address, query
from sightline.functions.facts import macs
from sightline.operators import devices as D
from sightline.operators import gaps as G
from sightline.operators import history as H
from sightline.operators import keys as K
from sightline.operators import lattice as L
from sightline.operators import sources as P
from sightline.operators import subnets as N
from sightline.operators import verdicts as V
from sightline.plans.lineage import cut, scratch_path
from sightline.plans.skew import unsent
from sightline.sources import rollup as R
from sightline.sources import tables

_PORTS = """
port_names as (
  select peer_mac, peer_port, count(distinct case when hostname <> '' then hostname end) as n
  from obs where peer_mac is not null group by 1, 2),
sides as (
  select p.low, p.high, a.hostname as ha, b.hostname as hb, a.peer_mac as ma, b.peer_mac as mb,
    case when a.peer_port = b.peer_port then na.n else na.n + nb.n end as names
  from pairs p join obs a on a.obs_id = p.low join obs b on b.obs_id = p.high
  left join port_names na on na.peer_mac = a.peer_mac and na.peer_port = a.peer_port
  left join port_names nb on nb.peer_mac = b.peer_mac and nb.peer_port = b.peer_port),
l2 as (
  select low, high, case when ha = hb then 'l2-hostname-agrees' else 'l2-different-hostname' end as rule,
    case when ha = hb then 'Decisive' else 'Disqualifying' end as verdict
  from sides where ha <> '' and hb <> ''
  union all
  select low, high, case when ma = mb then 'l2-uplink-agrees' else 'l2-different-switch' end,
    case when ma <> mb then 'Disqualifying' when names <= 1 then 'Decisive' else 'Neutral' end
  from sides where ma is not null and mb is not null)"""


@query(
    "b_l2_rules",
    """select p.low, p.high,
         case when count(*) filter (verdict = 'Disqualifying') > 0 then 'no_match'
              when count(*) filter (verdict = 'Decisive') > 0 then 'match' else 'abstained' end as outcome,
         coalesce(min(rule) filter (verdict = 'Disqualifying'), min(rule) filter (verdict = 'Decisive'))
           as rule_id,
         case when count(*) filter (verdict in ('Disqualifying', 'Decisive')) = 0
              then 'absence_of_proof' end as cause
       from pairs p left join l2 using (low, high) group by 1, 2""",
    _PORTS,
)
def b_l2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.sightings(spark, sf_dir)
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    return V.decide(D.l2_verdicts(asked, obs), pairs=asked).drop("ruleset_version", "verdicts")


_NODES = """
edges as (
  select distinct first_mac as a, l2_domain || '/' || f.value as b from (
    select obs_id, l2_domain, l2_domain || '/' || coalesce(mac, mac2) as first_mac from obs
    where coalesce(mac, mac2) is not null) o join facts f using (obs_id) where f.field = 'mac'
  union
  select distinct l2_domain || '/' || coalesce(mac, mac2), 'name/' || l2_domain || '/' || hostname
  from obs where coalesce(mac, mac2) is not null and hostname <> ''),
nodes as (select a as node from edges union select b from edges)"""
_REACH = """
reach as (
  select node, node as label from nodes
  union
  select r.node, e.b from reach r join (select a, b from edges union select b, a from edges) e
    on e.a = r.label)"""


@query(
    "b_device_grouping",
    """select cast(split_part(node, '/', 1) as int) as l2_domain, split_part(node, '/', 2) as mac,
         min(label) as device
       from reach where node not like 'name/%' group by node""",
    _NODES,
    _REACH,
)
def b_device_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.devices(tables.sightings(spark, sf_dir))


_SIDES = """
switch as (
  select l2_domain || '/' || f.value as node, arg_max(peer_mac, (observed_at, obs_id)) as side
  from obs join facts f using (obs_id) where f.field = 'mac' and peer_mac is not null group by 1),
walk as (
  select node, side, 0 as dist from switch
  union
  select e.b, w.side, w.dist + 1 from walk w
  join (select a, b from edges union select b, a from edges) e on e.a = w.node where w.dist < 8),
nearest as (select node, arg_min(side, (dist, side)) as side from walk group by 1),
kept as (
  select a, b from edges e left join nearest x on x.node = e.a left join nearest y on y.node = e.b
  where x.side is not distinct from y.side),
held as (
  select node, node as label from nodes
  union
  select r.node, e.b from held r join (select a, b from kept union select b, a from kept) e
    on e.a = r.label)"""


@query(
    "b_device_parted",
    """select cast(split_part(node, '/', 1) as int) as l2_domain, split_part(node, '/', 2) as mac,
         any_value(side) as switch, min(label) as device
       from held left join nearest using (node) where node not like 'name/%' group by node""",
    _NODES,
    _SIDES,
)
def b_device_parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices cut where interfaces were last seen behind different switches."""
    return D.parted_devices(tables.sightings(spark, sf_dir))


_BORNE = """
edges as (
  select distinct l2_domain || '/' || mac as a, 'name/' || l2_domain || '/' || hostname as b
  from obs where mac is not null and hostname <> ''),
nodes as (
  select l2_domain || '/' || mac as node from obs where mac is not null union select b from edges)"""


@query(
    "b_device_bearers",
    """select distinct o.l2_domain, '00:00:5e:00:01:' || substr(mac2, 13, 2) as virtual_mac, device
       from obs o join (select node, min(label) as device from reach group by 1) r
         on r.node = o.l2_domain || '/' || o.mac where mac2 is not null""",
    _BORNE,
    _REACH,
)
def b_device_bearers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second macs spelled as virtual routers, and the devices that bear them."""
    spelled = F.transform(
        "facts",
        lambda f: f.withField(
            "Mac.addr",
            F.when(
                f["Mac"]["addr"].startswith("02:00:5e:01:"),
                F.concat(F.lit("00:00:5e:00:01:"), F.substring(f["Mac"]["addr"], 13, 2)),
            ).otherwise(f["Mac"]["addr"]),
        ),
    )
    obs = tables.sightings(spark, sf_dir).withColumn("facts", spelled)
    return D.borne(obs, D.devices(obs))


_CLASSES = """
spelled as (
  select obs_id, case obs_id % 5 when 0 then '00:00:5e:00:01:' || mac[-2:]
    when 1 then '00:00:0c:07:ac:' || mac[-2:] when 2 then '00:00:0c:9f:f1:' || mac[-2:]
    when 3 then '00' || mac[3:] else mac end as mac from obs where mac is not null)"""


@query(
    "b_virtual_prefix",
    """select obs_id, mac, case when mac like '00:00:5e:00:01:%' then 'vrrp'
         when mac like '00:00:0c:07:ac:%' then 'hsrp' when mac like '00:00:0c:9f:f%' then 'hsrp2'
         when substr(mac, 2, 1) in ('2', '3', '6', '7', 'a', 'b', 'e', 'f') then 'local'
         else 'universal' end as class from spelled""",
    _CLASSES,
)
def b_virtual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tables.sighting_columns(spark, sf_dir).where("mac is not null")
    way, tail = F.col("obs_id") % 5, F.substring("mac", -2, 2)
    spelled = (
        F.when(way == 0, F.concat(F.lit("00:00:5e:00:01:"), tail))
        .when(way == 1, F.concat(F.lit("00:00:0c:07:ac:"), tail))
        .when(way == 2, F.concat(F.lit("00:00:0c:9f:f1:"), tail))
        .when(way == 3, F.concat(F.lit("00"), F.substring("mac", 3, 15)))
        .otherwise(F.col("mac"))
    )
    return flat.select("obs_id", spelled.alias("mac")).withColumn("class", D.mac_class(F.col("mac")))


_STATE = """
words as (
  select stream, arg_max(coalesce(error_code, ''), seq) as cause from feed
  where record = 'observation' or (record = 'failure' and error_code <> 'Cancelled') group by 1),
told as (select stream, arg_max(kinds, seq) as kinds from feed where record = 'capability' group by 1)"""


@query(
    "b_source_state",
    """select s.stream, s.l2_domain, s.vantage, s.last_ok,
         case when w.cause = '' then 'live' else 'blind' end as liveness,
         nullif(w.cause, '') as cause,
         case when coalesce(t.kinds, 'all') = 'all' then 'full' else 'reduced' end as capability,
         case when w.cause <> '' then 'offline' when coalesce(t.kinds, 'all') = 'all' then 'full'
              else 'degraded' end as shown
       from (select stream, l2_domain, vantage, max(observed_at) as last_ok from feed
             where record = 'observation' group by 1, 2, 3) s
       join words w using (stream) left join told t using (stream)""",
    _STATE,
)
def b_source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.source_state(tables.feed(spark, sf_dir))


_NEWEST = """
newest as (
  select i.entity_id, o.connector_id from ident i join (
    select ipv4, arg_max(connector_id, (observed_at, obs_id)) as connector_id from obs group by 1) o
  using (ipv4))"""


@query(
    "b_suppress_blind",
    """select c.entity_id, c.attr_key as field, c.observed, n.connector_id as stream
       from compared c join newest n using (entity_id) left join told t on t.stream = n.connector_id
       where c.status = 'gap' and n.connector_id <> 'error' and n.connector_id <> 'click'""",
    PERIMETER,
    _NEWEST,
    _STATE,
)
def b_suppress_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps kept when one source is blind and another cannot see the fields."""
    declared, obs = tables.declared(spark, sf_dir), tables.sightings(spark, sf_dir)
    newest = G.newest_sighting(declared, obs).select(
        "entity_id", F.col("connector_id").alias("stream")
    )
    gaps = G.gaps(declared, obs).select("entity_id", "field", "observed").join(newest, "entity_id")
    kinds = F.when(F.col("stream") == "click", F.array(F.lit("Rtt"))).otherwise(
        F.array(*map(F.lit, S.FACT_KINDS))
    )
    sources = obs.select(F.col("connector_id").alias("stream")).distinct().select(
        "stream", (F.col("stream") != "error").alias("live"), kinds.alias("kinds")
    )
    return P.unsuppressed_gaps(gaps, sources)


@query(
    "b_presence",
    """select s.stream, s.l2_domain, s.mac, s.day, count(p.day) as missed,
         case when count(p.day) >= 3 then 'gone' when count(p.day) > 0 then 'stale' else 'present' end
           as state
       from (select connector_id as stream, k.l2_domain, k.mac, max(cast(k.observed_at as date)) as day
             from keys k join obs o using (obs_id) group by 1, 2, 3) s
       left join (select connector_id as stream, cast(observed_at as date) as day,
               not bool_or(user_id % 150 = 0) as live
             from obs join events on event_id = obs_id group by 1, 2) p
         on p.stream = s.stream and p.live and p.day > s.day
           and p.day > date '2024-01-30' - 7 and p.day <= date '2024-01-30'
       group by 1, 2, 3, 4""",
)
def b_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys per source on 30 January; a day on which user 0 (mod 150) is seen counts as blind."""
    obs = tables.sightings(spark, sf_dir)
    day = F.col("observed_at").cast("date")
    seen = (
        obs.select(F.col("connector_id").alias("stream"), "l2_domain", F.explode(macs()).alias("mac"),
                   day.alias("day"))
        .groupBy("stream", "l2_domain", "mac").agg(F.max("day").alias("day"))
    )
    events = tables.read_table(spark, sf_dir, "events")
    polls = events.groupBy(
        F.col("event_type").alias("stream"), F.col("ts").cast("date").alias("day")
    ).agg((~F.bool_or(F.col("user_id") % 150 == 0)).alias("live"))
    return P.presence(seen, polls, "2024-01-30", 3, 7, "mac")


@query(
    "b_dormant",
    """select l2_domain, mac, last_seen_at,
         case when last_seen_at < timestamp '2024-02-20 00:00:00' - interval 30 day and n % 5 <> 0
              then 'dormant' else 'active' end as state
       from (select l2_domain, mac, max(observed_at) as last_seen_at, count(*) as n from keys
             group by 1, 2)""",
)
def b_dormant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces on 20 February; those with a multiple of five sightings count as grouped by hand."""
    made = K.seen_window(K.scoped_keys(tables.sightings(spark, sf_dir)))
    exempt = made.where("members % 5 = 0")
    return P.dormancy(made.select("l2_domain", "mac", "last_seen_at"), exempt, "2024-02-20 00:00:00")


@query(
    "b_retention",
    """select o.ipv4, f.value as mac, min(o.observed_at) as first_seen_at,
         max(o.observed_at) as last_seen_at, count(*) as sightings,
         count(*) filter (o.observed_at >= timestamp '2024-04-15 00:00:00' - interval 90 day) as kept
       from obs o join facts f using (obs_id) where f.field = 'mac' group by 1, 2""",
)
def b_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address history kept for ever, beside what retention leaves of it on 15 April."""
    obs = tables.sightings(spark, sf_dir)
    kept = P.address_history(P.retained(obs, "2024-04-15 00:00:00")).select(
        "ipv4", "mac", F.col("sightings").alias("kept")
    )
    return P.address_history(obs).join(kept, ["ipv4", "mac"], "left").fillna(0, ["kept"])


@query(
    "b_retention_rollup",
    """select o.ipv4, f.value as mac, min(o.observed_at) as first_seen_at,
         max(o.observed_at) as last_seen_at, count(*) as sightings
       from obs o join facts f using (obs_id) where f.field = 'mac' group by 1, 2""",
)
def b_retention_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history by daily parts: ten days at a time, some rolled twice, folded twice on the way."""
    root = scratch_path(spark, "rollup")
    obs = tables.sightings(spark, sf_dir).select("observed_at", "facts")
    for first, last, cutoff in ((0, 10, None), (8, 20, "2024-01-09"), (20, 4000, "2024-01-21")):
        days = F.date_diff(F.col("observed_at"), F.lit("2024-01-01").cast("date"))
        R.roll(obs.where(days.between(first, last - 1)), root)
        if cutoff:
            R.fold(spark, root, cutoff)
    return R.history(spark, root)


_CLASH = f"""
clash as (
  select o.ipv4, count(distinct o.l2_domain || '/' || f.value) as keys
  from obs o join facts f using (obs_id) where f.field = 'mac' group by 1
  having count(distinct o.l2_domain || '/' || f.value) > 1),
leases as (
  select regexp_replace(ipv4, '[.][0-9]+$', '') as range_id,
    min(cast(regexp_extract(ipv4, '([0-9]+)$', 1) as int)) as low,
    max(cast(regexp_extract(ipv4, '([0-9]+)$', 1) as int)) as high
  from obs where lease_until is not null and {is_address('ipv4')} group by 1)"""


@query(
    "b_ip_conflict",
    """select 'two_keys' as kind, ipv4, keys as n from clash
       union all select 'static_in_dhcp', d.ipv4, d.entity_id from declared_wide d join leases l
         on regexp_replace(d.ipv4, '[.][0-9]+$', '') = l.range_id
        and cast(regexp_extract(d.ipv4, '([0-9]+)$', 1) as int) between l.low and l.high""",
    _CLASH,
)
def b_ip_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys on one address, and declared addresses inside the range a lease was seen from."""
    declared, obs = tables.declared(spark, sf_dir), tables.sightings(spark, sf_dir)
    lease = obs.select(F.explode("facts.DhcpLease.ip").alias("ip")).where("ip is not null")
    number = P.ipv4_to_long(F.col("ip"))
    ranges = lease.groupBy(F.substring_index("ip", ".", 3).alias("range_id")).agg(
        F.min(number).alias("low"), F.max(number).alias("high")
    )
    static = P.static_in_dhcp(declared, ranges).select(
        F.lit("static_in_dhcp").alias("kind"), "ipv4", F.col("entity_id").alias("n")
    )
    clash = P.ip_conflicts(obs).select(F.lit("two_keys").alias("kind"), "ipv4", F.col("keys").alias("n"))
    return clash.unionByName(static)


_SPANS = f"""
spans as (
  select connector_id as stream, min(n) as low, max(n) as high from (
    select connector_id, list_reduce([cast(x as bigint) for x in string_split(ipv4, '.')],
      lambda a, b: a * 256 + b) as n from obs where {is_address('ipv4')}) group by 1)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, low, high): from the lowest to the highest address that each source saw."""
    number = P.ipv4_to_long(F.col("ipv4"))
    return tables.sighting_columns(spark, sf_dir).groupBy(F.col("connector_id").alias("stream")).agg(
        F.min(number).alias("low"), F.max(number).alias("high")
    )


@query(
    "b_range_cidrs",
    """select stream, low, high, concat_ws('.', (n >> 24) & 255, (n >> 16) & 255, (n >> 8) & 255, n & 255)
           || '/' || cast(32 - k as varchar) as cidr
       from (select distinct stream, low, high, k, unnest([low >> k, (low >> k) + 1, greatest((high >> k) - 1, 0), high >> k])
               << k as n from spans, (select unnest(range(33)) as k))
       where n >= low and n + (1::bigint << k) - 1 <= high and not (
         (n >> (k + 1)) << (k + 1) >= low
         and ((n >> (k + 1)) << (k + 1)) + (1::bigint << (k + 1)) - 1 <= high)""",
    _SPANS,
)
def b_range_cidrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest aligned blocks inside the range of each source."""
    return N.range_cidrs(_spans(spark, sf_dir))


@query(
    "b_static_in_span",
    f"""select stream, entity_id, ipv4 from spans join (
         select entity_id, ipv4, list_reduce([cast(x as bigint) for x in string_split(ipv4, '.')],
           lambda a, b: a * 256 + b) as n from declared_wide where {is_address('ipv4')})
         on n between low and high""",
    _SPANS,
)
def b_static_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared addresses inside the range of each source, wide as it may be."""
    spans = _spans(spark, sf_dir).withColumnRenamed("stream", "range_id")
    found = P.static_in_dhcp(tables.declared(spark, sf_dir), spans)
    return found.withColumnRenamed("range_id", "stream")


@query(
    "b_alerts",
    f"""select 'unknown_device' as kind, ipv4 from (select distinct ipv4 from obs
          where ipv4 not in (select ipv4 from declared_wide))
        union all select 'unseen', ipv4 from (select distinct ipv4 from declared_wide) d
          where not exists (select 1 from obs o where o.ipv4 = d.ipv4
            and o.observed_at >= timestamp '{NOW}' - interval 14 day)
        union all select 'ip_conflict', ipv4 from clash""",
    _CLASH,
)
def b_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.alerts(tables.declared(spark, sf_dir), tables.sightings(spark, sf_dir), NOW, 14)


@query(
    "b_source_disagreement",
    """select ipv4, field, count(distinct connector_id) as sources, count(distinct value) as n_values
       from (select o.ipv4, f.field, o.connector_id, f.value from obs o join facts f using (obs_id)
             where not (o.connector_id = 'view' and f.field <> 'mac'))
       group by 1, 2 having count(distinct connector_id) > 1 and count(distinct value) > 1""",
)
def b_source_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source can see macs only; what it says of names does not count."""
    obs = tables.sightings(spark, sf_dir)
    kinds = F.when(F.col("connector_id") == "view", F.array(F.lit("Mac"))).otherwise(
        F.array(*map(F.lit, S.FACT_KINDS))
    )
    capable = obs.select("connector_id").distinct().withColumn("kinds", kinds)
    return P.source_disagreement(obs, capable)


_BEFORE = f"""
seen0 as (
  select p.entity_id, f.field, min(f.value) as value, count(distinct f.value) as nv
  from peri p join facts f using (obs_id) join obs o using (obs_id)
  where o.observed_at < timestamp '{EARLIER}' and not (o.connector_id = 'error' and f.field = 'mac')
  group by 1, 2),
compared0 as (
  select d.entity_id, d.attr_key, case when o.nv = 1 then o.value end as observed,
    case when o.nv is null then 'NoObservedValue' when o.nv > 1 then 'ConflictingObservations'
         when o.value <> d.attr_value then 'gap' else 'clear' end as status
  from declared d left join seen0 o on o.entity_id = d.entity_id and o.field = d.attr_key)"""


@query(
    "b_attention_filter",
    """select c.entity_id, c.attr_key as field, c.attr_value as declared, c.observed
       from compared c left join compared0 b on b.entity_id = c.entity_id and b.attr_key = c.attr_key
         and b.status = 'gap'
       where c.status = 'gap'
         and (b.observed || case when c.entity_id % 3 = 0 then '-before' else '' end)
           is distinct from c.observed
         and not (b.entity_id is not null and c.entity_id % 5 = 0)""",
    PERIMETER,
    _BEFORE,
)
def b_attention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions taken on the earlier gaps, some on another value, some to keep the declared one."""
    declared, obs = tables.declared(spark, sf_dir), tables.sightings(spark, sf_dir)
    decided = G.gaps(declared, earlier_sightings(obs)).select(
        "entity_id",
        "field",
        F.when(F.col("entity_id") % 3 == 0, F.concat("observed", F.lit("-before")))
        .otherwise(F.col("observed")).alias("observed"),
        F.when(F.col("entity_id") % 5 == 0, "AlwaysKeepMine").otherwise("Keep").alias("disposition"),
        F.lit(EARLIER).cast("timestamp_ntz").alias("decided_at"),
    )
    return P.surfaced(G.gaps(declared, obs), decided)


@query(
    "b_regimes",
    """select fields, asked * 1000 // nullif(fields, 0) as coverage_per_mille,
         moved * 1000 // nullif(asked, 0) as churn_per_mille,
         case when asked < 0.8 * fields then 'bootstrap' when moved <= 0.02 * asked then 'steady'
              else 'migration' end as regime
       from (select count(*) as fields, count(*) filter (b.status <> 'NoObservedValue') as asked,
               count(*) filter (b.status <> 'NoObservedValue' and b.observed is distinct from c.observed)
                 as moved
             from compared c join compared0 b using (entity_id, attr_key))""",
    PERIMETER,
    _BEFORE,
)
def b_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, obs = tables.declared(spark, sf_dir), tables.sightings(spark, sf_dir)
    return P.regime(G.compare(declared, earlier_sightings(obs)), G.compare(declared, obs))


@query(
    "b_changes_since",
    f"""select observation_id, nullif(subject, '{S.NIL_ID}') as interface_id, outcome, 'opened' as change
        from desired where valid_from >= timestamp '{EARLIER}' - interval 1 day
        union all
        select h.observation_id, h.interface_id, h.outcome,
          case when h.valid_from >= timestamp '{EARLIER}' - interval 1 day then 'replaced' else 'closed' end
        from desired0 h join actions a on a.observation_id = h.observation_id and a.subject = h.subject
        where a.action in ('superseded', 'vacated') and a.at >= timestamp '{EARLIER}' - interval 1 day""",
    *DIFF,
)
def b_changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = second_pass(spark, sf_dir)
    return P.changes_since(done.links, "2024-01-24 00:00:00")


@query(
    "b_search_record",
    """select l2_domain, ipv4, coalesce(mac, mac2) as mac, hostname, count(*) as sightings,
         min(observed_at) as first_seen_at, max(observed_at) as last_seen_at
       from obs where hostname = 'host-8' group by 1, 2, 3, 4""",
)
def b_search_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.search(tables.sightings(spark, sf_dir), "host-8")


_SOFTWARE = """
instances as (
  select distinct l_suppkey as device_id, p_brand as software, p_size as version
  from lineitem join part on p_partkey = l_partkey),
apps as (
  select p_brand as software, min(p_type) as application, 'owner-' || max(p_brand) as owner,
    case when count(*) % 2 = 0 then 'high' else 'low' end as criticality from part group by 1)"""


@query(
    "b_software",
    """select i.device_id, a.application, a.owner, a.criticality, count(*) as instances,
         count(*) filter (i.version < n.newest) as behind
       from instances i join apps a using (software)
       join (select software, max(version) as newest from instances group by 1) n using (software)
       group by 1, 2, 3, 4""",
    _SOFTWARE,
)
def b_software(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand in for devices and part brands for software; the part size is a version."""
    part = tables.read_table(spark, sf_dir, "part")
    lines = tables.read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    instances = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("device_id"),
        F.col("p_brand").alias("software"),
        F.col("p_size").alias("version"),
    ).distinct()
    apps = part.groupBy(F.col("p_brand").alias("software")).agg(
        F.min("p_type").alias("application"),
        F.concat(F.lit("owner-"), F.max("p_brand")).alias("owner"),
        F.when(F.count("*") % 2 == 0, "high").otherwise("low").alias("criticality"),
    )
    return P.hosted(instances, apps)


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers depend on suppliers, and suppliers on customers of their returned lines."""
    lines = tables.read_table(spark, sf_dir, "lineitem")
    orders = tables.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("back"),
        (F.col("l_quantity") < 2).alias("out"),
    )
    out = both.where("out").select(F.col("c").alias("src"), F.col("s").alias("dst"))
    back = both.where("back").select(F.col("s").alias("src"), F.col("c").alias("dst"))
    return out.unionByName(back).distinct()


@query(
    "b_impact_bfs",
    "select node, depth from walk where depth > 0",
    """deps as (
         select distinct 'c' || o_custkey as src, 's' || l_suppkey as dst
         from lineitem join orders on o_orderkey = l_orderkey where l_quantity < 2
         union
         select distinct 's' || l_suppkey, 'c' || o_custkey
         from lineitem join orders on o_orderkey = l_orderkey
         where l_returnflag = 'R' and l_quantity > 49),
       walk(node, depth) using key (node) as (
         select 's1' as node, 0 as depth
         union select d.src, min(w.depth) + 1 from walk w join deps d on d.dst = w.node
         where not exists (select 1 from recurring.walk r where r.node = d.src) group by 1)""",
)
def b_impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = dependencies(spark, sf_dir)
    return D.impact(edges, spark.createDataFrame([("s1",)], "node string"))


@query(
    "b_cluster_metrics",
    """select count(*) as clusters, count(*) filter (truths > 1) as contaminated,
         sum(n * (n - 1) // 2)::bigint as made_pairs, any_value(t.p) as true_pairs, any_value(b.p) as right_pairs,
         any_value(b.p) * 1000 // nullif(sum(n * (n - 1) // 2)::bigint, 0) as precision_per_mille,
         any_value(b.p) * 1000 // nullif(any_value(t.p), 0) as recall_per_mille
       from (select k.l2_domain, k.mac, count(*) as n, count(distinct e.user_id) as truths
             from keys k join events e on e.event_id = k.obs_id group by 1, 2),
         (select sum(n * (n - 1) // 2)::bigint as p from (select count(*) as n from keys k
            join events e on e.event_id = k.obs_id group by e.user_id)) t,
         (select sum(n * (n - 1) // 2)::bigint as p from (select count(*) as n from keys k
            join events e on e.event_id = k.obs_id group by k.l2_domain, k.mac, e.user_id)) b""",
)
def b_cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key groups judged against the user each sighting came from."""
    made = K.scoped_keys(tables.sightings(spark, sf_dir))
    truth = tables.read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("obs_id"), F.col("user_id").alias("truth")
    )
    assigned = made.join(truth, "obs_id").select(
        F.concat_ws("/", F.col("l2_domain").cast("string"), "mac").alias("cluster"), "truth"
    )
    return D.cluster_metrics(assigned)


@query(
    "b_monotone",
    """select before, after, count(*) as pairs, true as holds from (
         select case verdict when 'Decisive' then 'match' when 'Disqualifying' then 'no_match'
                  else 'abstained' end as before,
           case when a.connector_id = 'view' or b.connector_id = 'view' or verdict = 'Neutral'
                then 'abstained' when verdict = 'Decisive' then 'match' else 'no_match' end as after
         from pair_l1 p join obs a on a.obs_id = p.low join obs b on b.obs_id = p.high)
       group by 1, 2""",
)
def b_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source loses its macs; no verdict may become more certain or turn over."""
    obs = tables.sightings(spark, sf_dir)
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    blind = F.filter("facts", lambda f: f["Mac"].isNull())
    masked = obs.withColumn(
        "facts", F.when(F.col("connector_id") == "view", blind).otherwise(F.col("facts"))
    )
    return D.monotone(V.decide_l1(asked, obs), V.decide_l1(asked, masked))



_LATTICE = """
said as (
  select 'interface' as level, low, high, verdict, 1 as needs, 0 as lacks from pair_l1
  union all
  select 'interface', p.low, p.high, case when a.hostname = b.hostname then 'Supports' else 'Opposes' end, 4, 0
  from pairs p join obs a on a.obs_id = p.low join obs b on b.obs_id = p.high
  where a.hostname <> '' and b.hostname <> ''
  union all
  select 'device', low, high, case when verdict = 'Neutral' then 'Decisive' else verdict end,
    case when rule like 'l2-hostname%' or rule = 'l2-different-hostname' then 4 else 16 end,
    case when verdict = 'Neutral' then 4 else 0 end
  from l2),
under_mask as (
  select s.level, s.low, s.high, t.m,
    case when max(case when verdict = 'Disqualifying' and (m & needs) = needs and (m & lacks) = 0 then 1 else 0 end) = 1
           then 'no_match'
         when max(case when verdict = 'Decisive' and (m & needs) = needs and (m & lacks) = 0 then 1 else 0 end) = 1
          and max(case when verdict = 'Opposes' and (m & needs) = needs and (m & lacks) = 0 then 1 else 0 end) = 0
           then 'match' else 'abstained' end as outcome
  from said s, (select unnest(range(128)) as m) t group by 1, 2, 3, 4)"""


def _lattice(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    obs = tables.sightings(spark, sf_dir)
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    return {
        "interface": L.outcomes(L.interface_verdicts(asked, obs)),
        "device": L.outcomes(L.device_verdicts(asked, obs)),
    }


def _levels(found: dict[str, DataFrame], asked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = [asked(df).withColumn("level", F.lit(level)) for level, df in found.items()]
    return rows[0].unionByName(rows[1])


@query(
    "b_lattice_outcomes",
    """select level, low, high, count(*) filter (outcome = 'match') as match_sets,
         count(*) filter (outcome = 'no_match') as no_match_sets
       from under_mask group by 1, 2, 3""",
    _PORTS,
    _LATTICE,
)
def b_lattice_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 128 sets of capabilities, how many make each labelled pair a match or not."""
    return _levels(_lattice(spark, sf_dir), L.sets_per_outcome)


@query(
    "b_lattice",
    """select a.level, a.low, a.high, k.kind as lost, count(*) as edges
       from (select unnest(['Mac','IpV4','Hostname','DhcpLease','Uplink','OuiVendor','Rtt']) as kind,
               unnest(range(7)) as i) k
       join under_mask a on (a.m & (1 << k.i)) <> 0
       join under_mask b on b.level = a.level and b.low = a.low and b.high = a.high
         and b.m = a.m - (1 << k.i)
       where b.outcome <> 'abstained' and b.outcome <> a.outcome group by 1, 2, 3, 4""",
    _PORTS,
    _LATTICE,
)
def b_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs that the loss of one kind makes more certain, or turns over, under some set."""
    return _levels(_lattice(spark, sf_dir), L.violations)


_HISTORY = (
    """
worn as (
  select k.l2_domain, k.mac, k.obs_id, k.observed_at, o.ipv4, o.hostname from keys k join obs o using (obs_id)),
turned as (
  select *, case when lag(obs_id) over w is not null and lag(ipv4) over w is not distinct from ipv4
                  and lag(hostname) over w is not distinct from hostname then 0 else 1 end as turn
  from worn window w as (partition by l2_domain, mac order by observed_at, obs_id)),
runs as (
  select *, sum(turn) over (partition by l2_domain, mac order by observed_at, obs_id) as stretch from turned),
stretches as (
  select *, lead(first_seen_at) over (partition by l2_domain, mac order by stretch) as until
  from (select l2_domain, mac, cast(stretch as bigint) as stretch, ipv4, hostname, count(*) as sightings,
          min(observed_at) as first_seen_at, max(observed_at) as last_seen_at from runs group by 1, 2, 3, 4, 5))""",
    f"""
placed as (select distinct {INTERFACE} as interface_id, l2_domain, mac from keys k),
versions as (
  select i.l2_domain, i.mac, w.valid_from, false as ended
  from desired w join placed i using (interface_id)
  where not exists (select 1 from actions a where a.observation_id = w.observation_id
                    and a.subject = w.subject and a.action = 'unchanged')
  union all
  select i.l2_domain, i.mac, h.valid_from, a.action <> 'unchanged'
  from desired0 h join placed i using (interface_id)
  join actions a on a.observation_id = h.observation_id and a.subject = h.subject),
version_in as (
  select v.l2_domain, v.mac, s.stretch, v.ended from versions v asof join
    (select l2_domain, mac, first_seen_at, max(stretch) as stretch from stretches group by 1, 2, 3) s
    on s.l2_domain = v.l2_domain and s.mac = v.mac and v.valid_from >= s.first_seen_at),
history as (
  select s.*, coalesce(n.versions, 0) as versions, coalesce(n.ended, 0) as ended
  from stretches s left join (select l2_domain, mac, stretch, count(*) as versions,
      count(*) filter (ended) as ended from version_in group by 1, 2, 3) n using (l2_domain, mac, stretch))""",
)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = cut(H.narrow(tables.sightings(spark, sf_dir)))
    # What the first pass left is all current, and the second looks at every sighting, so it meets all versions.
    done = passes(seen)
    return H.address_history(seen, H.versions_met(done.actions, done.interfaces))


@query(
    "b_address_history",
    """select l2_domain, mac, stretch, ipv4, hostname, first_seen_at, last_seen_at, until, sightings,
         versions, ended from history""",
    *DIFF,
    *_HISTORY,
)
def b_address_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every interface under one address and name, with the link versions begun in it."""
    return _history(spark, sf_dir)


@query(
    "b_decision_history",
    f"""select observation_id, nullif(subject, '{S.NIL_ID}') as interface_id, outcome, rule_id,
          cause as abstention_cause, min(valid_from) as valid_from, max(valid_to) as valid_to,
          count(*) as versions
        from (select *, sum(fresh) over (partition by observation_id, subject order by valid_from, valid_to)
                as run
              from (select *, case when lag(outcome) over w = outcome
                        and lag(rule_id) over w is not distinct from rule_id
                        and lag(cause) over w is not distinct from cause
                        and lag(valid_to) over w = valid_from then 0 else 1 end as fresh
                    from held window w as (partition by observation_id, subject order by valid_from, valid_to)))
        group by observation_id, subject, outcome, rule_id, cause, run""",
    *DIFF,
    f"""
held as (
  select observation_id, subject, outcome, rule_id, cause, valid_from, timestamp '{S.OPEN_END}' as valid_to
  from desired w where not exists (select 1 from actions a where a.observation_id = w.observation_id
    and a.subject = w.subject and a.action = 'unchanged')
  union all
  select h.observation_id, h.subject, h.outcome, h.rule_id, h.cause, h.valid_from,
    case when a.action = 'unchanged' then timestamp '{S.OPEN_END}' else a.at end
  from desired0 h join actions a on a.observation_id = h.observation_id and a.subject = h.subject)""",
)
def b_decision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was decided of each sighting and how long it held; new evidence alone starts no new interval."""
    _, _, done = second_pass(spark, sf_dir)
    return H.decision_history(done.links).drop("decided_by")


@query(
    "b_full_record",
    """select t.term, w.*, coalesce(i.instances, 0) as instances
       from (select distinct lower(attr_value) as term from declared
             where attr_key in ('ipv4', 'hostname', 'mac')) t
       join (select distinct l2_domain, mac, unnest([ipv4, mac, lower(hostname)]) as term from history) h
         on h.term = t.term
       join (select l2_domain, mac, min(first_seen_at) as first_seen_at, max(last_seen_at) as last_seen_at,
               count(*) as stretches, sum(sightings)::bigint as sightings, sum(versions)::bigint as versions,
               sum(ended)::bigint as ended, arg_max_null(ipv4, stretch) as ipv4,
               arg_max_null(hostname, stretch) as hostname from history group by 1, 2) w
         on w.l2_domain = h.l2_domain and w.mac = h.mac
       left join (select mac, count(distinct p_brand) as instances from declared_wide
           join orders on o_custkey = entity_id join lineitem on l_orderkey = o_orderkey
           join part on p_partkey = l_partkey where mac is not null group by 1) i on i.mac = w.mac""",
    *DIFF,
    *_HISTORY,
)
def b_full_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each interface that ever wore a declared address, mac or name.

    Customers stand in for declared devices, and the brands of the parts they ordered for their software.
    """
    declared = tables.declared(spark, sf_dir)
    terms = declared.where("attr_key in ('ipv4', 'hostname', 'mac')").select(F.col("attr_value").alias("term"))
    orders = tables.read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"))
    lines = tables.read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    brands = tables.read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    of = declared.where("attr_key = 'mac'").select("entity_id", F.col("attr_value").alias("mac"))
    # One mac a device, so brands are told apart by mac at once; a few rows for each task are left.
    ordered = orders.join(unsent(of), "entity_id").select("o_orderkey", "mac")
    bought = lines.join(unsent(ordered), "o_orderkey").select("l_partkey", "mac")
    runs = bought.join(unsent(brands), "l_partkey").select("mac", "p_brand").distinct()
    hosted = runs.groupBy("mac").agg(F.count("*").alias("instances"))
    return H.records(cut(_history(spark, sf_dir)), terms, hosted)
