"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-02-01 00:00:00"
EARLIER = "2024-01-25 00:00:00"

_OCTETS = " || ':' || ".join(f"substr(d, {i}, 2)" for i in (1, 3, 5, 7, 9))

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def is_address(column: str) -> str:
    """In SQL, whether a text is a dotted quad: ids from 65,536 on give texts that are none, and are refused."""
    return f"regexp_full_match({column}, '{_OCTET}([.]{_OCTET}){{3}}')"


# The table views of sightline.sources.tables, stated in SQL.
VIEWS = f"""
ev as (
  select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
         lpad(cast(event_id as varchar), 10, '0') as d
  from events),
obs as (
  select event_id as obs_id, event_type as connector_id, ts as observed_at,
    cast(user_id % 4 as int) as l2_domain, cast(k % 3 as int) as vantage,
    case when k % 10 = 0 then null
         when event_id % 200 = 3 then '06:' || {_OCTETS}
         else '02:00:5e:00:' || lpad(cast(user_id % 90 as varchar), 2, '0') || ':' ||
              lpad(cast(user_id % 3 as varchar), 2, '0') end as mac,
    case when event_id % 50 = 1
         then '02:00:5e:01:' || lpad(cast(user_id % 90 as varchar), 2, '0') || ':00' end as mac2,
    case when event_id % 500 = 7 then '10.9.9.9'
         else '10.' || cast(user_id // 256 as varchar) || '.' || cast(user_id % 256 as varchar) ||
              '.' || cast(k % 4 as varchar) end as ipv4,
    case when k % 5 = 0 then null when user_id % 7 = 0 then ''
         when event_id % 97 = 0 then 'alias-' || cast(user_id as varchar)
         else 'host-' || cast(user_id % 60 as varchar) end as hostname,
    case when k % 3 = 0 then cast(floor(value) as bigint) end as rtt,
    case when k % 2 = 0
         then '02:00:5e:aa:00:' || lpad(cast(user_id % 12 as varchar), 2, '0') end as peer_mac,
    'ge-0/0/' || cast(user_id % 48 as varchar) as peer_port,
    case when user_id % 3 = 0 then case when k % 11 = 0 then '' else event_type end end as vendor,
    case when event_type = 'signup' then ts + interval 1 hour end as lease_until,
    event_id % 1000 <> 11 as mac_flag,
    case when k % 4 = 0 then props end as raw
  from ev),
fact_list as (
  select obs_id, 1 as o, 'IpV4' as kind, ipv4 as value, 'IpV4 ' || ipv4 as claim from obs
  union all select obs_id, 2, 'Hostname', hostname, 'Hostname ' || hostname || '|Dhcp'
    from obs where hostname is not null
  union all select obs_id, 3, 'Mac', mac, 'Mac ' || mac || '|' || cast(mac_flag as varchar)
    from obs where mac is not null
  union all select obs_id, 4, 'Mac', mac2, 'Mac ' || mac2 || '|' || cast(mac_flag as varchar)
    from obs where mac2 is not null
  union all select obs_id, 5, 'Rtt', cast(rtt as varchar) || ' ms', 'Rtt ' || cast(rtt as varchar)
    from obs where rtt is not null
  union all select obs_id, 6, 'Uplink', peer_mac, 'Uplink ' || peer_mac || '|' || peer_port
    from obs where peer_mac is not null
  union all select obs_id, 7, 'OuiVendor', vendor, 'OuiVendor ' || vendor
    from obs where vendor is not null
  union all select obs_id, 8, 'DhcpLease', ipv4,
      'DhcpLease ' || ipv4 || '|' || strftime(lease_until, '%Y-%m-%d %H:%M:%S.%f')
    from obs where lease_until is not null),
all_facts as (
  select obs_id, cast(row_number() over (partition by obs_id order by o) - 1 as int) as pos,
         kind, value, claim,
         case kind when 'IpV4' then 'ipv4' when 'Hostname' then 'hostname' when 'Mac' then 'mac'
                   end as field
  from fact_list),
facts as (select obs_id, pos, field, value from all_facts where field is not null),
keys as (
  select distinct f.obs_id, o.l2_domain, f.value as mac, o.observed_at
  from facts f join obs o using (obs_id) where f.field = 'mac'),
declared_wide as (
  select c_custkey as entity_id,
    case c_custkey % 3 when 0 then 'manual' when 1 then 'adopted' else 'imported' end as origin,
    case when c_custkey % 3 = 1 then c_custkey end as origin_obs_id,
    'operator-' || cast(c_nationkey as varchar) as actor_id,
    timestamp '2024-01-15 00:00:00' + to_hours(c_custkey) as updated_at,
    '10.' || cast(c_custkey // 256 as varchar) || '.' || cast(c_custkey % 256 as varchar) || '.' ||
      cast(c_custkey % 5 as varchar) as ipv4,
    case when c_custkey % 7 = 0 then 'nas-' || cast(c_custkey as varchar)
         else 'host-' || cast(c_custkey % 60 as varchar) end as hostname,
    case when c_custkey % 4 <> 0 then '02:00:5e:00:' || lpad(cast(c_custkey % 90 as varchar), 2, '0')
      || ':' || lpad(cast(case when c_custkey % 6 = 0 then 9 else c_custkey % 3 end as varchar), 2, '0')
      end as mac,
    case when c_mktsegment = 'BUILDING' then 'sn-' || cast(c_custkey as varchar) end as serial
  from customer),
declared as (
  select entity_id, 'ipv4' as attr_key, ipv4 as attr_value, origin, origin_obs_id, actor_id,
         updated_at from declared_wide
  union all select entity_id, 'hostname', hostname, origin, origin_obs_id, actor_id, updated_at
    from declared_wide
  union all select entity_id, 'mac', mac, origin, origin_obs_id, actor_id, updated_at
    from declared_wide where mac is not null
  union all select entity_id, 'serial', serial, origin, origin_obs_id, actor_id, updated_at
    from declared_wide where serial is not null),
feed as (
  select o.connector_id as stream, o.obs_id as seq, r.record,
    case when record = 'observation'
         then case when o.obs_id % 401 = 5 then o.obs_id - 5 else o.obs_id end end as obs_id,
    case when record = 'observation'
         then case when o.obs_id % 701 = 2 then 'stranger' else o.connector_id end end as connector_id,
    case when record = 'observation' then observed_at end as observed_at,
    case when record = 'observation' then l2_domain end as l2_domain,
    case when record = 'observation' then vantage end as vantage,
    case when record = 'capability'
         then case when o.obs_id % 3 = 0 then observed_at - interval 2 days else observed_at end
         end as as_of,
    case when record = 'capability'
         then case when o.obs_id % 2 = 0 then 'all' else 'some' end end as kinds,
    case when record = 'failure' then case o.obs_id % 5 when 0 then 'Unreachable'
         when 1 then 'Cancelled' when 2 then 'Timeout' else 'Unauthorized' end end as error_code,
    raw
  from obs o join (select obs_id, case when obs_id % 53 = 0 then 'capability'
                     when obs_id % 997 = 1 then 'failure' else 'observation' end as record
                   from obs) r on o.obs_id = r.obs_id),
feed_facts as (
  select f.stream, f.seq, f.obs_id, a.pos, a.kind, a.value, a.claim
  from feed f join all_facts a on a.obs_id = f.seq where f.record = 'observation'),
labelled as (
  select 'case-' || cast(event_id as varchar) as case_id, event_type as replay,
    event_id as first_id,
    case when event_id % 31 = 0 then null when event_id % 29 = 0 then event_id
         else event_id + 1 end as second_id,
    'sightings of user ' || cast(user_id as varchar) || ' compared' as reason,
    case when event_id % 17 <> 0 then (case when event_id % 2 = 0 then 'Family-' else 'family-' end)
         || cast(user_id % 40 as varchar) end as family,
    case event_id % 3 when 0 then 'must-merge' when 1 then 'must-not-merge' else 'must-abstain' end
      as expectation,
    case when event_id % 3 <> 2 then case when event_id % 13 = 0 then 'l2-hostname-agrees'
         when event_id % 2 = 0 then 'l1-exact-mac' else 'l1-distinct-mac' end end as expected_rule,
    case when event_id % 3 = 2 then 'absence_of_proof' end as expected_cause
  from events where event_id < (select max(event_id) from events)),
pairs as (
  select first_id as low, second_id as high from labelled where first_id < second_id),
pair_l1 as (
  select p.low, p.high,
    case when a.obs_id is null or b.obs_id is null then 'Neutral'
         when exists (select 1 from keys x join keys y on x.l2_domain = y.l2_domain and x.mac = y.mac
                      where x.obs_id = p.low and y.obs_id = p.high) then 'Decisive'
         else 'Disqualifying' end as verdict
  from pairs p left join (select distinct obs_id from keys) a on a.obs_id = p.low
               left join (select distinct obs_id from keys) b on b.obs_id = p.high),
answers as (
  select l.case_id, l.expectation, l.expected_rule,
    case v.verdict when 'Decisive' then 'merged' when 'Disqualifying' then 'refused'
                   when 'Neutral' then 'abstained' end as outcome,
    case v.verdict when 'Decisive' then 'l1-exact-mac' when 'Disqualifying' then 'l1-distinct-mac'
                   end as rule_id,
    case v.verdict when 'Neutral' then 'absence_of_proof' end as cause,
    case when l.second_id is null or l.second_id = l.first_id then 'no_pair'
         when l.expected_rule is null then 'no_level'
         when l.expected_rule not like 'l1-%' then 'level_not_implemented' end as unanswered
  from labelled l left join pair_l1 v on v.low = l.first_id and v.high = l.second_id
    and l.expected_rule like 'l1-%')
"""


def with_views(body: str, *ctes: str) -> str:
    """``body`` behind the table views and any further CTEs."""
    return "with recursive " + ",\n".join([VIEWS.strip(), *[c.strip() for c in ctes]]) + "\n" + body


def query(name: str, body: str | None = None, *ctes: str):
    """Register a query and, when it can be stated in SQL, its oracle."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if body is not None:
            ORACLES[name] = with_views(body, *ctes)
        return fn

    return register
