"""Declared against observed: gaps, abstentions, the triage queue, documents and subnets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.linking import engine_links
from sightline.catalog.registry import NOW, query
from sightline.functions import facts as X
from sightline.operators import documents, robust, subnets, triage
from sightline.operators import gaps as G
from sightline.operators import sources as P
from sightline.sources import tables

Both = tuple[DataFrame, DataFrame]


def both(spark: SparkSession, sf_dir: str) -> Both:
    return tables.declared(spark, sf_dir), tables.sightings(spark, sf_dir)


# SQL: the perimeter is listed sighting by sighting, unlike the Spark form.
PERIMETER = """
ident as (select entity_id, attr_value as ipv4 from declared where attr_key = 'ipv4'),
peri as (select distinct i.entity_id, i.ipv4, f.obs_id from ident i
         join facts f on f.field = 'ipv4' and f.value = i.ipv4),
seen as (select p.entity_id, f.field, min(f.value) as value, count(distinct f.value) as nv
         from peri p join facts f using (obs_id) group by 1, 2),
compared as (
  select d.entity_id, i.ipv4, d.attr_key, d.attr_value, case when o.nv = 1 then o.value end as observed,
    case when o.nv is null then 'NoObservedValue' when o.nv > 1 then 'ConflictingObservations'
         when o.value <> d.attr_value then 'gap' else 'clear' end as status
  from declared d join ident i using (entity_id)
  left join seen o on o.entity_id = d.entity_id and o.field = d.attr_key),
causes as (
  select i.entity_id, 'OutOfPerimeter' as cause,
    (select count(*) from obs) - (select count(*) from peri p where p.entity_id = i.entity_id) as n
  from ident i
  union all select entity_id, 'ConflictingObservations', count(*) from seen where nv > 1 group by 1
  union all select entity_id, 'NoObservedValue', count(*) from compared
    where status in ('NoObservedValue', 'ConflictingObservations') group by 1)"""


@query(
    "join_declared_observed",
    "select entity_id, ipv4, attr_key, attr_value, observed, status from compared",
    PERIMETER,
)
def join_declared_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.compare(*both(spark, sf_dir))


@query(
    "agg_gaps",
    """select entity_id, attr_key as field, attr_value as declared, observed from compared
       where status = 'gap'""",
    PERIMETER,
)
def agg_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gaps(*both(spark, sf_dir))


@query("agg_abstentions", "select entity_id, cause, n from causes where n > 0", PERIMETER)
def agg_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.abstentions(*both(spark, sf_dir))


@query(
    "agg_field_values", "select entity_id, field, nv as n_values, value from seen", PERIMETER
)
def agg_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.field_values(*both(spark, sf_dir))


@query(
    "join_unclaimed",
    """select distinct value as ipv4 from facts where field = 'ipv4'
       and value not in (select ipv4 from ident)""",
    PERIMETER,
)
def join_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unclaimed(*both(spark, sf_dir))


_FIRST_NEW = """
first_new as (
  select ipv4, observed_at, obs_id, connector_id from (
    select o.*, row_number() over (partition by ipv4 order by observed_at, obs_id) as r from obs o
    where ipv4 not in (select ipv4 from ident)) where r = 1),
newest as (
  select i.entity_id, i.ipv4, o.observed_at, o.obs_id, o.connector_id from ident i join (
    select o.*, row_number() over (partition by ipv4 order by observed_at desc, obs_id desc) as r
    from obs o) o on o.ipv4 = i.ipv4 and o.r = 1)"""


@query("win_first_new_address", "select * from first_new", PERIMETER, _FIRST_NEW)
def win_first_new_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_new_address(*both(spark, sf_dir))


@query("win_newest_sighting", "select * from newest", PERIMETER, _FIRST_NEW)
def win_newest_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.newest_sighting(*both(spark, sf_dir))


@query(
    "join_declared_provenance",
    """select c.entity_id, c.attr_key as field, c.attr_value as declared, c.observed, d.origin,
         d.updated_at, (select max(updated_at) from declared x where x.entity_id = c.entity_id)
           as entity_updated_at
       from compared c join declared d using (entity_id, attr_key) where c.status = 'gap'""",
    PERIMETER,
)
def join_declared_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.declared_provenance(*both(spark, sf_dir))


# ---------------------------------------------------------------- triage

_QUEUE = f"""
queue as (
  select 'ecart:' || cast(c.entity_id as varchar) || ':' || c.attr_key as row_id, 'ecart' as kind,
    c.entity_id, c.ipv4, c.attr_key as field, c.attr_value as declared, c.observed,
    cast(null as bigint) as n, w.connector_id, w.observed_at as seen_at
  from compared c left join newest w using (entity_id) where c.status = 'gap'
  union all
  select case cause when 'NoObservedValue' then 'absence:' else 'conflit:' end ||
      cast(i.entity_id as varchar), case cause when 'NoObservedValue' then 'absence' else 'conflit' end,
    i.entity_id, i.ipv4, '', '', '', a.n, w.connector_id, w.observed_at
  from causes a join ident i using (entity_id) left join newest w using (entity_id)
  where a.cause <> 'OutOfPerimeter'
  union all
  select 'nouveau:' || ipv4, 'nouveau', null, ipv4, 'ipv4', '', ipv4, null, connector_id, observed_at
  from first_new),
aged as (
  select *, case when seen_at is null then 9223372036854775807
    else greatest((epoch_us(timestamp '{NOW}') - epoch_us(seen_at)) // 1000000, 0) end as age_seconds
  from queue)"""
QUEUE = (PERIMETER, _FIRST_NEW, _QUEUE)


@query("tri_queue", "select * from aged", *QUEUE)
def tri_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.queue(*both(spark, sf_dir), NOW)


@query(
    "srt_triage_age",
    "select row_id, age_seconds from aged order by age_seconds desc, entity_id, row_id",
    *QUEUE,
)
def srt_triage_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triage.queue(*both(spark, sf_dir), NOW)
    return triage.by_age(rows).select("row_id", "age_seconds")


@query(
    "tri_detail",
    f"""select q.row_id, q.kind, q.ipv4, q.field, q.declared, q.observed, q.n,
          case when q.kind = 'nouveau' then null else d.origin end as declared_origin,
          case when q.kind = 'nouveau' then null else d.updated_at end as declared_at,
          substr(q.connector_id, 1, 8) as observed_source,
          case when s is null then 'never_seen' when s < 0 then 'ahead' when s < 60 then 'just_now'
               when s < 3600 then 'minutes' when s < 86400 then 'hours' else 'days' end as freshness_unit,
          case when s < 60 then null when s < 3600 then s // 60 when s < 86400 then s // 3600
               else s // 86400 end as freshness_n,
          case q.kind when 'conflit' then 'resolve' else 'document' end as action
        from (select *, (epoch_us(timestamp '{NOW}') - epoch_us(seen_at)) // 1000000 as s from queue) q
        left join declared_wide d using (entity_id)""",
    *QUEUE,
)
def tri_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, obs = both(spark, sf_dir)
    return triage.detail(triage.queue(declared, obs, NOW), declared, NOW)


@query(
    "tri_reconciled_entity",
    """select entity_id, 'declared' as part, attr_key as field, attr_value as declared,
         cast(null as varchar) as observed, cast(null as bigint) as n from compared
       union all select distinct p.entity_id, 'observed', coalesce(a.field, 'rtt'), null, a.value, null
         from peri p join all_facts a using (obs_id) where a.field is not null or a.kind = 'Rtt'
       union all select entity_id, 'gap', attr_key, attr_value, observed, null from compared
         where status = 'gap'
       union all select entity_id, 'abstention', cause, null, null, n from causes where n > 0""",
    PERIMETER,
)
def tri_reconciled_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconciled view of every entity."""
    return triage.reconciled_entities(*both(spark, sf_dir))


@query(
    "lim_first_entity",
    "select entity_id, ipv4 from ident where entity_id = (select min(entity_id) from ident)",
    PERIMETER,
)
def lim_first_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.first_entity(tables.declared(spark, sf_dir))


@query(
    "obj_state",
    """select cast(c.entity_id as varchar) as object_id, c.ipv4,
         case when c.ipv4 in (select ipv4 from ident group by 1 having count(*) > 1) then 'ambiguous'
              when bool_or(c.status = 'ConflictingObservations') then 'conflict'
              when bool_or(c.status = 'gap') then 'gap' else 'concordant' end as state
       from compared c group by c.entity_id, c.ipv4
       union all select distinct ipv4, ipv4, 'undeclared' from obs
         where ipv4 not in (select ipv4 from ident)""",
    PERIMETER,
)
def obj_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities declaring one address between them are ambiguous."""
    declared, obs = both(spark, sf_dir)
    shared = G.identities(declared).groupBy("ipv4").agg(F.count("*").alias("n")).where("n > 1")
    return G.object_state(declared, obs, shared)


# ---------------------------------------------------------------- store views

_REACH = """
desired_reach as (
  select 'match' as outcome, cast(null as varchar) as abstention_cause, count(distinct obs_id) as n
  from keys union all
  select 'abstained', 'absence_of_proof', count(*) from obs where obs_id not in (select obs_id from keys))"""


@query("agg_engine_reach", "select * from desired_reach order by 1, 2", _REACH)
def agg_engine_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.engine_reach(engine_links(tables.sightings(spark, sf_dir)))


@query(
    "agg_identity_view",
    """select sum(case when outcome = 'match' then n else 0 end)::bigint as placed,
         sum(case when outcome = 'abstained' then n else 0 end)::bigint as not_placed,
         0::bigint as settled from desired_reach""",
    _REACH,
)
def agg_identity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine_links(tables.sightings(spark, sf_dir))
    return triage.identity_view(triage.engine_reach(made))


@query(
    "agg_store_facts",
    """select (select count(*) from obs) as observations,
         (select count(*) from declared) as declared_attributes,
         (select count(*) from keys) + (select n from desired_reach where outcome = 'abstained')
           as identity_links,
         (select count(*) from keys) + (select n from desired_reach where outcome = 'abstained')
           as current_engine_links,
         (select n from desired_reach where outcome = 'match') as placed,
         (select n from desired_reach where outcome = 'abstained') as not_placed""",
    _REACH,
)
def agg_store_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, obs = both(spark, sf_dir)
    return triage.store_facts(obs, declared, engine_links(obs))


@query("agg_last_observed", "select max(observed_at) as last_observed_at from obs")
def agg_last_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.last_observed(tables.sightings(spark, sf_dir))


@query(
    "agg_dashboard_pending",
    """select 'linked' as asked, (select count(*) from obs) > 0 and (select count(*) from obs) = 0 as pending
       union all select 'before the first pass', (select count(*) from obs) > 0
       union all select 'nothing seen', (select count(*) from obs where obs_id < 0) > 0""",
)
def agg_dashboard_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a pass, before the first one, and with neither sightings nor links."""
    obs = tables.sightings(spark, sf_dir)
    made = engine_links(obs)
    asked = {
        "linked": (obs, made),
        "before the first pass": (obs, made.where("false")),
        "nothing seen": (obs.where("obs_id < 0"), made.where("false")),
    }
    rows = [
        triage.dashboard_pending(seen, links).select(F.lit(name).alias("asked"), "pending")
        for name, (seen, links) in asked.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "src_coverage",
    """select s.stream, k.kind, k.kind in (select distinct kind from feed_facts f
           where f.stream = s.stream) as seen,
         s.last_observed_at, s.perimeter_valid
       from (select stream, max(observed_at) as last_observed_at,
               count(*) filter (record = 'failure' and error_code <> 'Cancelled') = 0 as perimeter_valid
             from feed group by 1) s,
         (select unnest(['Mac','IpV4','Hostname','DhcpLease','Uplink','OuiVendor','Rtt']) as kind) k""",
)
def src_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: kinds it was and was not seen to report, its last sighting, its failures."""
    feed = tables.feed(spark, sf_dir)
    blinding = (F.col("record") == "failure") & X.is_blinding(F.col("error_code"))
    state = feed.groupBy("stream").agg(
        F.max("observed_at").alias("last_observed_at"),
        F.coalesce(~F.bool_or(blinding), F.lit(True)).alias("perimeter_valid"),
    )
    kinds = (
        feed.select("stream", F.explode("facts").alias("f"))
        .select("stream", X.kind_of(F.col("f")).alias("kind"))
        .groupBy("stream")
        .agg(F.collect_set("kind").alias("kinds"))
    )
    return robust.capability_split(kinds).join(state, "stream")


_TAILS = ["/24", "/30", "/33", "/8", "", "/x", None, "/22", "/32", "/21", "/31", "/0"]
_TAIL_LIST = ", ".join("null" if t is None else f"'{t}'" for t in _TAILS)


@query(
    "src_source_view",
    """select source, cidr as perimeter, not regexp_full_match(cidr, '.*/(2[2-9]|3[0-2])') as refused,
         coalesce(array_to_string(list_filter(every, lambda k: list_contains(kinds, k)), '|'), '') as observes,
         coalesce(array_to_string(list_filter(every, lambda k: not list_contains(kinds, k)), '|'), '') as cannot_see,
         case when s < 0 then 'ahead' when s < 60 then 'just_now' when s < 3600 then 'minutes'
              when s < 86400 then 'hours' when s is not null then 'days' end as age_unit,
         case when s < 60 then null when s < 3600 then s // 60 when s < 86400 then s // 3600
              else s // 86400 end as age
       from (select source, cidr, kinds, ['Mac','IpV4','Hostname','DhcpLease','Uplink','OuiVendor','Rtt'] as every,
               cast(floor(epoch(timestamp '%s') - epoch(last)) as bigint) as s
             from configured left join (select connector_id, l2_domain, vantage, max(observed_at) as last
               from obs where obs_id %% 53 <> 0 and obs_id %% 997 <> 1 and vantage < 2 group by 1, 2, 3)
               using (connector_id, l2_domain, vantage)) where cidr is not null"""
    % NOW,
    f"""
told as (select stream, arg_max(case kinds when 'all' then
             ['Mac','IpV4','Hostname','DhcpLease','Uplink','OuiVendor','Rtt'] else ['Mac','IpV4','Hostname'] end, seq)
           as kinds from feed where record = 'capability' group by 1),
configured as (
  select connector_id || '/' || cast(l2_domain as varchar) || '/' || cast(vantage as varchar) as source,
    connector_id, l2_domain, vantage, coalesce(kinds, []) as kinds,
    '10.' || cast(l2_domain as varchar) || '.' || cast(vantage as varchar) || '.0' ||
      [{_TAIL_LIST}][l2_domain * 3 + vantage + 1] as cidr
  from (select distinct connector_id, l2_domain, vantage from obs) left join told on stream = connector_id)""",
)
def src_source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per scope, with perimeters good, refused and missing; those of one vantage saw nothing."""
    feed, obs = tables.feed(spark, sf_dir), tables.sightings(spark, sf_dir)
    kinds = feed.where("record = 'capability'").groupBy(F.col("stream").alias("connector_id")).agg(
        F.max_by("kinds", "seq").alias("kinds")
    )
    scopes = obs.select("connector_id", "l2_domain", "vantage").distinct()
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), F.col("l2_domain") * 3 + F.col("vantage") + 1)
    text = [F.col(c).cast("string") for c in ("connector_id", "l2_domain", "vantage")]
    configured = scopes.join(kinds, "connector_id", "left").select(
        "*",
        F.concat_ws("/", *text).alias("source"),
        F.concat(F.lit("10."), text[1], F.lit("."), text[2], F.lit(".0"), tail).alias("cidr"),
    )
    # A sighting counts by where it was made, also where its line names another connector.
    seen = feed.where("record = 'observation' and vantage < 2").withColumn("connector_id", F.col("stream"))
    shown = P.source_view(configured, seen, NOW)
    return shown.withColumns({c: F.array_join(c, "|") for c in ("observes", "cannot_see")})


# ---------------------------------------------------------------- documents

_FIRST_VALUE = """
first_value as (
  select obs_id, field, value from (select *, row_number() over (partition by obs_id, field
    order by pos) as r from facts) where r = 1),
asked as (select distinct obs_id from (select obs_id from obs union all
          select -1 - event_id from events)),
refused as (
  select a.obs_id, case when o.obs_id is null then 'unknown_subject'
      when exists (select 1 from declared d join first_value v on v.field = d.attr_key
                   and v.obs_id = d.origin_obs_id where v.obs_id = a.obs_id) then 'already_documented'
      end as reason
  from asked a left join obs o using (obs_id))"""


def subjects(obs: DataFrame) -> DataFrame:
    """Every sighting is asked for, and as many ids nobody ever sighted."""
    unknown = obs.select((-1 - F.col("obs_id")).alias("obs_id"))
    return obs.select("obs_id").unionByName(unknown)


@query("win_first_value_per_field", "select * from first_value", _FIRST_VALUE)
def win_first_value_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.first_value_per_field(tables.sightings(spark, sf_dir))


@query(
    "doc_adopt",
    """select origin_obs_id, attr_key, attr_value, 'adopted' as origin from (
         select v.obs_id as origin_obs_id, v.field as attr_key, v.value as attr_value
         from first_value v join refused r using (obs_id) where r.reason is null)""",
    _FIRST_VALUE,
)
def doc_adopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, obs = both(spark, sf_dir)
    return documents.adopt(subjects(obs), obs, declared).drop("entity_id")


@query("doc_refusals", "select obs_id, reason from refused where reason is not null", _FIRST_VALUE)
def doc_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, obs = both(spark, sf_dir)
    return documents.refusals(subjects(obs), obs, declared)


@query(
    "doc_refusals_blind",
    """select obs_id, reason from (
         select r.obs_id, case when r.reason is not null and r.reason <> 'already_documented' then r.reason
             when o.connector_id = 'error' then 'nothing_to_document' else r.reason end as reason
         from refused r left join obs o using (obs_id)) where reason is not null""",
    _FIRST_VALUE,
)
def doc_refusals_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where one source reports nothing that can be declared by hand."""
    declared, obs = both(spark, sf_dir)
    other = F.filter("facts", lambda f: X.declarable_field(f).isNull())
    facts = F.when(F.col("connector_id") == "error", other).otherwise(F.col("facts"))
    return documents.refusals(subjects(obs), obs.withColumn("facts", facts), declared)


@query(
    "doc_manual",
    """select s_suppkey as entity_id, 'serial' as attr_key, s_name as attr_value, 'manual' as origin
       from supplier where not exists (select 1 from declared d where d.entity_id = s_suppkey
         and d.attr_key = 'serial')""",
)
def doc_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A serial number for every supplier's number; entities that have one refuse it."""
    entries = tables.read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("entity_id"),
        F.lit("serial").alias("attr_key"),
        F.col("s_name").alias("attr_value"),
    )
    return documents.add_manual(entries, tables.declared(spark, sf_dir))


# ---------------------------------------------------------------- subnets

_CELLS = """
cells as (
  select subnet, octet, min(rank) as rank from (
    select regexp_replace(ipv4, '[0-9]+$', '') || '0/24' as subnet,
      cast(regexp_extract(ipv4, '([0-9]+)$', 1) as int) as octet, rank
    from (select ipv4, 1 as rank from obs union all select ipv4, 2 from declared_wide))
  group by 1, 2)"""


def _cells(spark: SparkSession, sf_dir: str) -> Both:
    declared, obs = both(spark, sf_dir)
    return obs.select(F.explode(X.addresses()).alias("ipv4")), G.identities(declared).select("ipv4")


@query(
    "agg_occupancy",
    """select subnet, count(*) filter (rank = 1 and octet between 1 and 254) as used,
         count(*) filter (rank = 2 and octet between 1 and 254) as reserved,
         254 - count(*) filter (octet between 1 and 254) as free from cells group by 1""",
    _CELLS,
)
def agg_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subnets.occupancy(*_cells(spark, sf_dir))


@query(
    "top_next_free",
    """select s.subnet, replace(s.subnet, '0/24', '') || cast(min(h.i) as varchar) as host
       from (select distinct subnet from cells) s, (select unnest(range(1, 255)) as i) h
       where not exists (select 1 from cells c where c.subnet = s.subnet and c.octet = h.i)
       group by s.subnet""",
    _CELLS,
)
def top_next_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subnets.next_free(*_cells(spark, sf_dir))
