"""Joins on scoped keys, the verdict algebra, and the versioned link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.catalog.registry import EARLIER, query
from sightline.functions import facts as X
from sightline.operators import devices, keys, links, verdicts
from sightline.operators import quality as Q
from sightline.plans.lineage import cut, scratch_path
from sightline.plans.multiset import compared
from sightline.sources import store, tables


def ids(evidence: Column | str) -> Column:
    """An array of ids as text, for comparison outside Spark."""
    col = F.col(evidence) if isinstance(evidence, str) else evidence
    return F.array_join(col.cast("array<string>"), "|")


def pairs_of(labels: DataFrame) -> DataFrame:
    named = F.col("observations")
    return labels.where("size(observations) = 2").select(
        named[0].alias("low"), named[1].alias("high")
    ).where("low < high")


def earlier_sightings(obs: DataFrame) -> DataFrame:
    """What the store had resolved before: older sightings, one source then blind to macs."""
    blind = F.filter("facts", lambda f: f["Mac"].isNull())
    facts = F.when(F.col("connector_id") == "error", blind).otherwise(F.col("facts"))
    return obs.where(F.col("observed_at") < F.lit(EARLIER).cast("timestamp_ntz")).withColumn(
        "facts", facts
    )


def held_before(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interfaces and links as the earlier pass left them."""
    first = links.resolve(
        earlier_sightings(obs), links.empty_interfaces(obs), links.empty_links(obs), "first",
        check=False, settle=True,
    )
    return first.interfaces, first.links


def passes(seen: DataFrame) -> links.Pass:
    """The pass over everything, of settled narrow sightings (``history.narrow``); its actions are to be read once."""
    slim = ["obs_id", "observed_at", "l2_domain", "macs"]
    # Repeats of a sighting are equal up to raw text and fact order.
    told = cut(seen.select(*slim, "connector_id").distinct())
    blind = F.when(F.col("connector_id") == "error", F.slice("macs", 1, 0)).otherwise(F.col("macs"))
    early = told.where(F.col("observed_at") < F.lit(EARLIER).cast("timestamp_ntz")).withColumn("macs", blind)
    rows, early = told.select(*slim), early.select(*slim)
    first = links.resolve(
        early, links.empty_interfaces(rows), links.empty_links(rows), "first", check=False, settle=True, rows=early
    )
    return links.resolve(
        rows, first.interfaces, first.links, "second", check=False, settle=True, rows=rows, settle_actions=False
    )


def second_pass(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, links.Pass]:
    obs = tables.sightings(spark, sf_dir)
    interfaces, held = held_before(obs)
    return obs, held, links.resolve(obs, interfaces, held, "second", check=False, settle=True)


def engine_links(obs: DataFrame) -> DataFrame:
    """Links after one pass over everything."""
    return links.resolve(
        obs, links.empty_interfaces(obs), links.empty_links(obs), "only", check=False
    ).links


# SQL of the same: digest ids, witnesses by self-join, and the diff of two passes.
UUID = """{d}[1:8] || '-' || {d}[9:12] || '-8' || {d}[14:16] || '-8' || {d}[18:20] || '-' || {d}[21:32]"""


def _uuid(expression: str) -> str:
    return UUID.format(d=f"(sha256({expression}))")


INTERFACE = _uuid("cast(k.l2_domain as varchar) || chr(1) || k.mac")


def placed_sql(name: str, key_table: str, batch: str, within: str = "") -> str:
    """Placements and abstentions; ``within`` narrows who may witness whom."""
    return f"""
{name} as (
  select k.obs_id as observation_id, {INTERFACE} as subject, {INTERFACE} as interface_id,
    'match' as outcome, 'l1-exact-mac' as rule_id, cast(null as varchar) as cause,
    case when w.witness is null then cast(k.obs_id as varchar)
         else cast(least(k.obs_id, w.witness) as varchar) || '|' ||
              cast(greatest(k.obs_id, w.witness) as varchar) end as evidence,
    k.observed_at as valid_from
  from {key_table} k left join (
    select a.obs_id, a.l2_domain, a.mac, min(b.obs_id) as witness
    from {key_table} a join {key_table} b on a.l2_domain = b.l2_domain and a.mac = b.mac
      and a.obs_id <> b.obs_id {within} group by 1, 2, 3) w
    on w.obs_id = k.obs_id and w.l2_domain = k.l2_domain and w.mac = k.mac
  union all
  select o.obs_id, '{S.NIL_ID}', null, 'abstained', null, 'absence_of_proof', '', o.observed_at
  from {batch} o where not exists (select 1 from {key_table} k where k.obs_id = o.obs_id))"""


DESIRED = placed_sql("desired", "keys", "obs")
EARLY = (
    f"obs0 as (select * from obs where observed_at < timestamp '{EARLIER}')",
    """keys0 as (select k.* from keys k join obs0 o using (obs_id) where o.connector_id <> 'error')""",
    placed_sql("desired0", "keys0", "obs0"),
)
ACTIONS = """
actions as (
  select coalesce(w.observation_id, h.observation_id) as observation_id,
    coalesce(w.subject, h.subject) as subject,
    case when h.observation_id is null then 'written' when w.observation_id is null then 'vacated'
         when w.interface_id is not distinct from h.interface_id and w.outcome = h.outcome
          and w.rule_id is not distinct from h.rule_id and w.cause is not distinct from h.cause
          and w.evidence = h.evidence then 'unchanged' else 'superseded' end as action,
    coalesce(w.outcome, '') as outcome, coalesce(w.valid_from, h.valid_from) as at,
    w.evidence, h.evidence as held_evidence, h.valid_from as held_from
  from desired w full outer join desired0 h
    on w.observation_id = h.observation_id and w.subject = h.subject)"""
DIFF = (DESIRED, *EARLY, ACTIONS)


# ---------------------------------------------------------------- joins


@query("join_scoped_key", "select obs_id, l2_domain, mac, observed_at from keys")
def join_scoped_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.scoped_keys(tables.sightings(spark, sf_dir))


@query(
    "join_candidate_pairs",
    "select count(*) as observations, count(*) * (count(*) - 1) // 2 as pairs from obs",
)
def join_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe is sized, never listed."""
    return keys.candidate_universe(tables.sightings(spark, sf_dir))


def hostname_keys(obs: DataFrame) -> DataFrame:
    """Blocking key: the names a sighting carries, empty ones left out."""
    names = F.array_distinct(F.array_compact(F.col("facts.Hostname.name")))
    return obs.select("obs_id", F.explode(names).alias("hostname")).where("hostname <> ''")


@query(
    "join_blocked_pairs",
    """select p.low, p.high from pairs p join obs a on a.obs_id = p.low join obs b on b.obs_id = p.high
       where a.hostname = b.hostname and a.hostname <> ''""",
)
def join_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    return keys.blocked_pairs(asked, hostname_keys(tables.sightings(spark, sf_dir)), ["hostname"])


@query(
    "join_pairs_in_groups",
    """select a.l2_domain, a.mac, count(distinct a.obs_id) as members,
         sum(case when a.obs_id < b.obs_id then 1 else 0 end)::bigint as pairs
       from keys a join keys b on a.l2_domain = b.l2_domain and a.mac = b.mac group by 1, 2""",
)
def join_pairs_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pairs_in_groups(keys.scoped_keys(tables.sightings(spark, sf_dir)))


@query(
    "join_interface_lookup",
    f"""select k.l2_domain, k.mac, case when h.l2_domain is not null then {INTERFACE} end
          as interface_id
        from (select distinct l2_domain, mac from keys) k
        left join (select distinct l2_domain, mac from keys0) h using (l2_domain, mac)""",
    *EARLY,
)
def join_interface_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.sightings(spark, sf_dir)
    interfaces, _ = held_before(obs)
    return keys.interface_for_key(keys.scoped_keys(obs), interfaces)


# ---------------------------------------------------------------- verdicts


@query(
    "pair_l1_verdict",
    """select low, high, verdict,
         case when verdict = 'Disqualifying' then 'l1-distinct-mac' else 'l1-exact-mac' end as rule,
         case when verdict = 'Neutral' then ''
              else cast(low as varchar) || '|' || cast(high as varchar) end as evidence
       from pair_l1""",
)
def pair_l1_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.sightings(spark, sf_dir)
    sides = verdicts.pair_sides(pairs_of(tables.labelled_pairs(spark, sf_dir)), obs)
    return verdicts.l1_verdicts(sides).withColumn("evidence", ids("evidence"))


_VECTOR = """
vector as (
  select low, high, case when verdict = 'Disqualifying' then 'l1-distinct-mac' else 'l1-exact-mac' end
    as rule, verdict from pair_l1
  union all
  select p.low, p.high, case when a.hostname = b.hostname then 'l2-hostname-agrees'
      else 'l2-different-hostname' end, case when a.hostname = b.hostname then 'Supports' else 'Opposes' end
  from pairs p join obs a on a.obs_id = p.low join obs b on b.obs_id = p.high
  where a.hostname <> '' and b.hostname <> '')"""
_DECIDED = """
decided as (
  select p.low, p.high,
    max(case when v.verdict = 'Disqualifying' then 1 else 0 end) as dq,
    max(case when v.verdict = 'Decisive' then 1 else 0 end) as dc,
    max(case when v.verdict = 'Supports' then 1 else 0 end) as su,
    max(case when v.verdict = 'Opposes' then 1 else 0 end) as op,
    coalesce(string_agg(v.rule || '=' || v.verdict, ';' order by v.rule, v.verdict), '') as verdicts
  from pairs p left join vector v using (low, high) group by 1, 2)"""


@query(
    "pair_decide",
    """select low, high,
         case when dq = 1 then 'no_match' when dc = 1 and op = 0 then 'match' else 'abstained' end
           as outcome,
         case when dq = 1 then 'l1-distinct-mac' when dc = 1 and op = 0 then 'l1-exact-mac' end as rule_id,
         case when dq = 1 or (dc = 1 and op = 0) then null when dc = 1 or su = 1 then 'ambiguous'
              else 'absence_of_proof' end as cause, 1 as ruleset_version, verdicts
       from decided""",
    _VECTOR,
    _DECIDED,
)
def pair_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped-key and hostname verdicts of the labelled pairs, combined."""
    obs = tables.sightings(spark, sf_dir)
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    said = verdicts.l1_verdicts(verdicts.pair_sides(asked, obs)).unionByName(
        devices.hostname_verdicts(asked, obs)
    )
    told = F.transform("verdicts", lambda v: F.concat(v["rule"], F.lit("="), v["verdict"]))
    return verdicts.decide(said, pairs=asked).withColumn("verdicts", F.array_join(told, ";"))


@query(
    "pair_decide_l1",
    """select low, high,
         case verdict when 'Disqualifying' then 'no_match' when 'Decisive' then 'match'
                      else 'abstained' end as outcome,
         case verdict when 'Disqualifying' then 'l1-distinct-mac' when 'Decisive' then 'l1-exact-mac' end
           as rule_id,
         case when verdict = 'Neutral' then 'absence_of_proof' end as cause from pair_l1""",
)
def pair_decide_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    return verdicts.decide_l1(asked, tables.sightings(spark, sf_dir)).drop("evidence")


@query(
    "single_decide",
    """select min(obs_id) as obs_id, 'match' as outcome, 'l1-exact-mac' as rule_id,
         cast(min(obs_id) as varchar) as evidence
       from keys group by l2_domain, mac having count(*) = 1""",
)
def single_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = keys.key_groups(keys.scoped_keys(tables.sightings(spark, sf_dir)))
    return verdicts.decide_alone(groups).withColumn("evidence", ids("evidence"))


@query(
    "decision_rule",
    """select low, high, case verdict when 'Disqualifying' then 'l1-distinct-mac'
         when 'Decisive' then 'l1-exact-mac' end as rule from pair_l1""",
)
def decision_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = pair_decide_l1(spark, sf_dir)
    return decided.select(
        "low", "high", verdicts.decision_rule(F.col("outcome"), F.col("rule_id")).alias("rule")
    )


@query(
    "decision_to_outcome",
    """select low, high, case verdict when 'Disqualifying' then 'refused' when 'Decisive' then 'merged'
         else 'abstained' end as outcome,
         case when verdict = 'Neutral' then 'absence_of_proof' end as cause from pair_l1""",
)
def decision_to_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = pair_decide_l1(spark, sf_dir)
    return decided.select(
        "low", "high", verdicts.scored_outcome(F.col("outcome")).alias("outcome"), "cause"
    )


# ---------------------------------------------------------------- witnesses


@query(
    "win_witness",
    """select a.obs_id, a.l2_domain, a.mac, count(*) as members,
         coalesce(min(case when b.obs_id <> a.obs_id then b.obs_id end), a.obs_id) as witness
       from keys a join keys b on a.l2_domain = b.l2_domain and a.mac = b.mac group by 1, 2, 3""",
)
def win_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.witnesses(keys.scoped_keys(tables.sightings(spark, sf_dir))).drop("observed_at")


def universe_of(obs: DataFrame) -> DataFrame:
    """A narrowed universe: each sighting with the next one by id and the one 4 further."""
    low = F.col("obs_id")
    return obs.select(low.alias("low"), F.explode(F.array(low + 1, low + 4)).alias("high"))


@query(
    "win_witness_within",
    """select a.obs_id, a.l2_domain, a.mac, min(b.obs_id) as witness
       from keys a join keys b on a.l2_domain = b.l2_domain and a.mac = b.mac
         and abs(a.obs_id - b.obs_id) in (1, 4) group by 1, 2, 3
       union all
       select min(obs_id), l2_domain, mac, min(obs_id) from keys group by 2, 3 having count(*) = 1""",
)
def win_witness_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.sightings(spark, sf_dir)
    return keys.witnesses_within(keys.scoped_keys(obs), universe_of(obs))


# ---------------------------------------------------------------- link pass


@query(
    "scd2_desired",
    """select observation_id, subject, interface_id, outcome, rule_id, cause, evidence,
         1 as ruleset_version, valid_from from desired""",
    DESIRED,
)
def scd2_desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.sightings(spark, sf_dir)
    return links.desired(obs, links.empty_interfaces(obs)).withColumn("evidence", ids("evidence"))


@query("scd2_diff", "select observation_id, subject, action, a.at from actions a", *DIFF)
def scd2_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = second_pass(spark, sf_dir)
    return done.actions.select("observation_id", "subject", "action", "at")


@query(
    "scd2_same_decision",
    """select observation_id, subject, action = 'unchanged' as same from actions
       where action in ('unchanged', 'superseded')""",
    *DIFF,
)
def scd2_same_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = second_pass(spark, sf_dir)
    both = done.actions.where("wants is not null and held is not null")
    return both.select(
        "observation_id", "subject", links.same_decision("wants", "held").alias("same")
    )


@query(
    "scd2_vacate",
    "select observation_id, subject, a.at as close_at from actions a where action = 'vacated'",
    *DIFF,
)
def scd2_vacate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = second_pass(spark, sf_dir)
    return done.actions.where("action = 'vacated'").select(
        "observation_id", "subject", F.col("at").alias("close_at")
    )


_NEXT = """
next_links as (
  select observation_id, interface_id, subject as current_subject, outcome, rule_id, cause, evidence,
    valid_from, timestamp '9999-12-31 23:59:59.999999' as valid_to
  from desired
  union all
  select h.observation_id, h.interface_id, null, h.outcome, h.rule_id, h.cause, h.evidence,
    h.valid_from, a.at
  from desired0 h join actions a on a.observation_id = h.observation_id and a.subject = h.subject
  where a.action in ('superseded', 'vacated'))"""


def _link_rows(table: DataFrame) -> DataFrame:
    return table.select(
        "observation_id", "interface_id", "current_subject", "outcome", "rule_id",
        F.col("abstention_cause").alias("cause"), ids("evidence").alias("evidence"), "valid_from",
        "valid_to",
    )


@query("scd2_resolve", "select * from next_links", *DIFF, _NEXT)
def scd2_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole link table after the second pass, closed versions included."""
    _, _, done = second_pass(spark, sf_dir)
    return _link_rows(done.links)


@query("sink_links", "select * from next_links", *DIFF, _NEXT)
def sink_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot written to a new path and read back."""
    _, _, done = second_pass(spark, sf_dir)
    return _link_rows(store.write_snapshot(done.links, scratch_path(spark, "links")))


_CANDIDATES = f"""
candidates as (
  select d.low as observation_id, {INTERFACE} as interface_id, d.high,
    row_number() over (partition by d.low order by {INTERFACE}, d.high) as place
  from decided d join keys k on k.obs_id = d.high
  where d.dq = 0 and (d.op = 1 or d.dc = 0) and (d.dc = 1 or d.su = 1))"""


@query(
    "sink_link_candidates",
    f"""select observation_id, 'ambiguous' as cause, interface_id,
          cast(least(observation_id, high) as varchar) || '|' || cast(greatest(observation_id, high) as varchar)
            as evidence
        from candidates where place <= {links.MOST_CANDIDATES}""",
    _VECTOR,
    _DECIDED,
    _CANDIDATES,
)
def sink_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous decisions written as links with their candidate interfaces, and read back."""
    obs = tables.sightings(spark, sf_dir)
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    said = verdicts.l1_verdicts(verdicts.pair_sides(asked, obs)).unionByName(
        devices.hostname_verdicts(asked, obs)
    )
    interfaces = links.resolved_interfaces(keys.scoped_keys(obs), links.empty_interfaces(obs))
    made = links.ambiguous_links(verdicts.decide(said, pairs=asked), obs, interfaces, "judged")
    table = store.write_snapshot(made, scratch_path(spark, "candidates"))
    return links.candidates_of(table).select(
        "observation_id", "cause", "interface_id", ids("evidence").alias("evidence")
    )


@query(
    "src_link_snapshot",
    f"""select observation_id, interface_id, current_subject as subject, outcome, rule_id,
         cause as abstention_cause, evidence, 1 as ruleset_version, '{S.ENGINE}' as decided_by,
         valid_from from next_links where current_subject is not null order by 1, 3""",
    *DIFF,
    _NEXT,
)
def src_link_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = second_pass(spark, sf_dir)
    return links.snapshot(done.links).withColumn("evidence", ids("evidence"))


@query(
    "fn_subject",
    f"""select observation_id, valid_to, coalesce(interface_id, '{S.NIL_ID}') as subject,
         current_subject from next_links""",
    *DIFF,
    _NEXT,
)
def fn_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = second_pass(spark, sf_dir)
    return done.links.select(
        "observation_id",
        "valid_to",
        X.subject_of(F.col("interface_id")).alias("subject"),
        X.current_subject_of(F.col("interface_id"), F.col("valid_to")).alias("current_subject"),
    )


@query(
    "agg_resolution_summary",
    """select (select count(*) * (count(*) - 1) // 2 from obs) as candidate_pairs,
         (select count(*) from (select distinct l2_domain, mac from keys
            except select distinct l2_domain, mac from keys0)) as interfaces_minted,
         (select count(*) from (select distinct l2_domain, mac from keys
            intersect select distinct l2_domain, mac from keys0)) as interfaces_found,
         count(*) filter (action in ('written', 'superseded')) as links_written,
         count(*) filter (action in ('written', 'superseded') and outcome = 'abstained')
           as links_abstained,
         count(*) filter (action = 'superseded') as links_superseded,
         count(*) filter (action = 'unchanged') as links_unchanged,
         count(*) filter (action = 'vacated') as links_vacated from actions""",
    *DIFF,
)
def agg_resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, done = second_pass(spark, sf_dir)
    return done.summary


@query(
    "scd2_close",
    """select observation_id, coalesce(interface_id, '') as interface_id,
         case when outcome = 'abstained' and observation_id % 5 in (0, 1) then null else subject end
           as current_subject,
         case when outcome = 'abstained' and observation_id % 5 in (0, 1)
              then valid_from + interval 1 day
              else timestamp '9999-12-31 23:59:59.999999' end as valid_to,
         null as refused from desired
       union all
       select observation_id, '', null, null,
         case way when 1 then 'already_closed' when 2 then 'open_end' when 3 then 'inverted'
           else 'unknown_link' end
         from (select *, observation_id % 5 as way from desired where outcome = 'abstained')
         where way > 0""",
    DESIRED,
)
def scd2_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstentions closed a day after they were made, some twice, and closes that are refused."""
    made = engine_links(tables.sightings(spark, sf_dir))
    way = F.col("observation_id") % 5
    day = F.expr("interval 1 day")
    asked = made.where("outcome = 'abstained'").select(
        "observation_id",
        way.alias("way"),
        F.when(way == 4, F.concat(F.lit("no-"), "link_id")).otherwise(F.col("link_id")).alias("link_id"),
        F.when(way == 2, X.open_end())
        .when(way == 3, F.col("valid_from") - day)
        .otherwise(F.col("valid_from") + day)
        .alias("close_at"),
    )
    closed = links.close(made, asked.select("link_id", "close_at"))
    # The second time round the rows of way 1 are closed already; those of way 0 do not come again.
    refused = links.close_refusals(closed, asked.where("way > 0").select("link_id", "close_at"))
    shown = closed.select(
        "observation_id",
        F.coalesce("interface_id", F.lit("")).alias("interface_id"),
        "current_subject",
        "valid_to",
        F.lit(None).cast("string").alias("refused"),
    )
    named = refused.join(asked, "link_id").select(
        "observation_id", F.lit("").alias("interface_id"), F.col("reason").alias("refused")
    )
    return shown.unionByName(named, allowMissingColumns=True)


@query(
    "scd2_contradictions",
    """select obs_id, 2::bigint as versions from obs
       where obs_id % 4 = 1 or (obs_id % 4 = 0 and hostname is not null)
         or (obs_id % 4 = 3 and ipv4 is not null)""",
)
def scd2_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting comes twice: later, without its name, with a fact repeated, or other raw text only."""
    obs = tables.sightings(spark, sf_dir)
    nameless = F.filter("facts", lambda f: f["Hostname"].isNull())
    repeated = F.concat("facts", F.filter("facts", lambda f: f["IpV4"].isNotNull()))
    way = F.col("obs_id") % 4
    again = obs.select(
        "obs_id",
        "connector_id",
        F.when(way == 1, F.col("observed_at") + F.expr("interval 1 second"))
        .otherwise(F.col("observed_at")).alias("observed_at"),
        "l2_domain",
        "vantage",
        F.reverse(
            F.when(way == 0, nameless).when(way == 3, repeated).otherwise(F.col("facts"))
        ).alias("facts"),
        F.lit("another raw").alias("raw"),
    )
    return links.contradictions(obs.unionByName(again))


@query(
    "scd2_regressed",
    """select a.observation_id, a.subject, a.held_from + interval 1 day as held_from, a.at
       from actions a where a.action = 'superseded'""",
    *DIFF,
)
def scd2_regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held versions dated a day later than they were: every replacement now runs backwards."""
    obs = tables.sightings(spark, sf_dir)
    interfaces, held = held_before(obs)
    later = held.withColumn("valid_from", F.col("valid_from") + F.expr("interval 1 day"))
    done = links.resolve(obs, interfaces, later, "second", check=False)
    return links.regressed(done.actions)


@query(
    "scd2_operator_guard",
    """select w.observation_id, w.subject from desired w join desired0 h
         on w.observation_id = h.observation_id and w.subject = h.subject where h.outcome = 'match'""",
    *DIFF,
)
def scd2_operator_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements an operator took over: slots the next pass must not write."""
    obs = tables.sightings(spark, sf_dir)
    interfaces, held = held_before(obs)
    owner = F.when(F.col("outcome") == "match", S.OPERATOR).otherwise(F.col("decided_by"))
    wanted = links.desired(obs, interfaces)
    return links.operator_collisions(wanted, held.withColumn("decided_by", owner)).select(
        "observation_id", "subject"
    )


@query(
    "scd2_mint",
    f"""select distinct k.l2_domain, k.mac, {INTERFACE} as interface_id from keys k
        where not exists (select 1 from keys0 h where h.l2_domain = k.l2_domain and h.mac = k.mac)""",
    *EARLY,
)
def scd2_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.sightings(spark, sf_dir)
    interfaces, _ = held_before(obs)
    resolved = links.resolved_interfaces(keys.scoped_keys(obs), interfaces)
    return resolved.where("minted").select("l2_domain", "mac", "interface_id")


@query("scd2_purge_replay", "select 0::bigint as lost, 0::bigint as gained, count(*) as kept from desired", DESIRED)
def scd2_purge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purge the engine's rows, replay the pass, and compare the decisions."""
    obs, _, done = second_pass(spark, sf_dir)
    table = cut(done.links)
    replayed = links.resolve(
        obs, done.interfaces, links.purge(table), "replay", check=False
    ).links
    return compared(links.decisions(table), links.decisions(replayed))


@query(
    "scd2_guard_decision",
    """select p.low as decision_id, case when v.verdict = 'Neutral' then 'ambiguous_without_candidate'
         else 'decision_without_rule' end as reason
       from pairs p join pair_l1 v using (low, high) left join keys k on k.obs_id = p.low
       where (v.verdict = 'Neutral' and k.obs_id is null)
          or (v.verdict <> 'Neutral' and p.low % 10 = 9)
       group by all""",
)
def scd2_guard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstentions called ambiguous with the keys of their first sighting as candidates."""
    obs = tables.sightings(spark, sf_dir)
    decided = pair_decide_l1(spark, sf_dir).select(
        F.col("low").alias("decision_id"),
        "outcome",
        F.when(F.col("low") % 10 == 9, "").otherwise(F.col("rule_id")).alias("rule_id"),
        F.when(F.col("outcome") == S.ABSTAINED, S.AMBIGUOUS).alias("cause"),
    )
    candidates = keys.scoped_keys(obs).select(F.col("obs_id").alias("decision_id"), "mac")
    return links.guard_refusals(decided, candidates)


# ---------------------------------------------------------------- invariants


@query(
    "dq_link_constraints",
    """select observation_id, rule from (
         select if(observation_id % 10 = 8, -observation_id, observation_id) as observation_id,
           case observation_id % 10 when 0 then 'outcome' when 1 then 'decided_by'
           when 2 then 'rule_xor_cause' when 3 then 'rule_not_empty'
           when 4 then 'abstained_has_no_interface' when 5 then 'current_subject'
           when 6 then 'interval' when 7 then 'interface_fk' when 8 then 'observation_fk' end as rule,
           outcome from desired)
       where outcome = 'match' and rule is not null
       union all
       select observation_id, 'one_current' from desired
       where outcome = 'match' and observation_id % 10 in (4, 5, 7)
       group by 1 having count(*) > 1""",
    DESIRED,
)
def dq_link_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements damaged in nine ways, one per row, and the rules they break.

    A sighting on two keys, damaged alike, also has one slot twice.
    """
    obs = tables.sightings(spark, sf_dir)
    first = links.resolve(
        obs, links.empty_interfaces(obs), links.empty_links(obs), "only", check=False
    )
    way = F.when(F.col("outcome") == S.MATCH, F.col("observation_id") % 10)
    strange = F.lit("11111111-1111-8111-8111-111111111111")

    def damaged(column: str, n: int, value: Column) -> Column:
        return F.when(F.col("_way") == n, value).otherwise(F.col(column))

    broken = first.links.withColumn("_way", way).select(
        "link_id",
        damaged("observation_id", 8, -F.col("observation_id")).alias("observation_id"),
        F.when(F.col("_way") == 7, strange)
        .when(F.col("_way") == 4, F.lit(None)).otherwise(F.col("interface_id")).alias("interface_id"),
        F.when(F.col("_way") == 7, strange).when(F.col("_way") == 4, F.lit(S.NIL_ID))
        .when(F.col("_way") == 5, F.lit("elsewhere")).otherwise(F.col("current_subject"))
        .alias("current_subject"),
        damaged("outcome", 0, F.lit("perhaps")).alias("outcome"),
        damaged("rule_id", 3, F.lit("")).alias("rule_id"),
        damaged("abstention_cause", 2, F.lit("ambiguous")).alias("abstention_cause"),
        "evidence",
        "ruleset_version",
        damaged("decided_by", 1, F.lit("NOBODY")).alias("decided_by"),
        damaged("valid_from", 6, X.open_end()).alias("valid_from"),
        "valid_to",
    )
    found = Q.link_constraints(broken, obs, first.interfaces)
    owner = broken.select(F.col("link_id").alias("row_id"), "observation_id")
    return found.join(owner, "row_id").select("observation_id", "rule")


@query(
    "dq_interface_constraints",
    """select l2_domain, mac, unnest(list_filter([
           case when n % 5 = 0 then 'id_not_nil' end,
           case when n % 3 = 0 and first_seen < last_seen then 'window' end,
           case when n % 2 = 0 and mac <> upper(mac) then 'mac_lower' end], lambda x: x is not null)) as rule
       from (select l2_domain, mac, count(*) as n, min(observed_at) as first_seen,
               max(observed_at) as last_seen from keys group by 1, 2)""",
)
def dq_interface_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces damaged by the number of their sightings."""
    made = keys.seen_window(keys.scoped_keys(tables.sightings(spark, sf_dir)))
    n = F.col("members")
    row = F.concat_ws("/", F.col("l2_domain").cast("string"), "mac")
    broken = made.select(
        "l2_domain",
        F.col("mac").alias("own_mac"),
        F.when(n % 5 == 0, S.NIL_ID).otherwise(row).alias("interface_id"),
        F.when(n % 3 == 0, F.col("last_seen_at")).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(n % 3 == 0, F.col("first_seen_at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(n % 2 == 0, F.upper("mac")).otherwise(F.col("mac")).alias("mac"),
        row.alias("row"),
    )
    checked = Q.interface_constraints(broken, "row")
    return checked.select(
        F.substring_index("row_id", "/", 1).cast("int").alias("l2_domain"),
        F.substring_index("row_id", "/", -1).alias("mac"),
        "rule",
    )


@query(
    "dq_declared_constraints",
    """select row_id, rule from (
         select cast(entity_id as varchar) || ':' || attr_key as row_id, unnest(list_filter([
           case when origin = 'adopted' and entity_id % 2 = 0 then 'adopted_has_obs' end,
           case when entity_id % 5 = 0 then 'actor_not_scanner' end], lambda x: x is not null)) as rule
         from declared)
       union all select cast(entity_id as varchar) || ':' || attr_key, 'one_value_per_key' from declared
         where entity_id % 11 = 0
       union all select min(cast(entity_id as varchar) || ':' || attr_key), 'one_adoption_per_field'
         from (select entity_id, attr_key from declared where origin = 'adopted' and entity_id % 2 = 1
               union all select entity_id, attr_key from declared where origin = 'adopted'
                 and entity_id % 2 = 1 and entity_id % 11 = 0)
         group by entity_id, attr_key having count(*) > 1""",
)
def dq_declared_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations damaged by entity number: no origin id, a scanner's hand, or said twice."""
    declared = tables.declared(spark, sf_dir)
    e = F.col("entity_id")
    damaged = declared.withColumn(
        "origin_obs_id", F.when(e % 2 == 1, F.col("origin_obs_id"))
    ).withColumn("actor_id", F.when(e % 5 == 0, "scanner").otherwise(F.col("actor_id")))
    twice = damaged.where("entity_id % 11 = 0").withColumns(
        {"actor_id": F.lit("operator"), "origin": F.when(F.col("origin") == "adopted", F.when(
            F.col("origin_obs_id").isNotNull(), F.col("origin")).otherwise("manual")
        ).otherwise(F.col("origin"))}
    )
    return Q.declared_constraints(damaged.unionByName(twice))


# ---------------------------------------------------------------- aggregates over links and keys


@query(
    "agg_seen_window",
    """select l2_domain, mac, count(*) as members, min(observed_at) as first_seen_at,
         max(observed_at) as last_seen_at from keys group by 1, 2""",
)
def agg_seen_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.seen_window(keys.scoped_keys(tables.sightings(spark, sf_dir)))


@query(
    "agg_widen_window",
    f"""select k.l2_domain, k.mac, {INTERFACE} as interface_id, min(k.observed_at) as first_seen_at,
          max(k.observed_at) as last_seen_at
        from keys k group by 1, 2, 3""",
)
def agg_widen_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored windows widened by the whole batch, minted interfaces added."""
    _, _, done = second_pass(spark, sf_dir)
    return done.interfaces


@query(
    "agg_blocking_recall",
    """select count(*) as required, count(*) filter (a.hostname = b.hostname and a.hostname <> '') as found,
         count(*) filter (a.hostname = b.hostname and a.hostname <> '') * 1000 // nullif(count(*), 0)
           as per_mille
       from pair_l1 p join obs a on a.obs_id = p.low join obs b on b.obs_id = p.high
       where p.verdict = 'Decisive'""",
)
def agg_blocking_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the pairs that must meet does a hostname key propose?"""
    obs = tables.sightings(spark, sf_dir)
    asked = pairs_of(tables.labelled_pairs(spark, sf_dir))
    required = verdicts.l1_verdicts(verdicts.pair_sides(asked, obs)).where("verdict = 'Decisive'")
    proposed = keys.blocked_pairs(asked, hostname_keys(obs), ["hostname"])
    return keys.blocking_recall(required, proposed)


