"""Labelled evaluation, multiset comparison, and runs on degraded feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.catalog.linking import ids
from sightline.catalog.registry import query
from sightline.functions.facts import int_div
from sightline.operators import evaluate as E
from sightline.operators import links, robust
from sightline.plans.ordering import with_position
from sightline.plans.multiset import compared
from sightline.sources import tables


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = tables.labelled_pairs(spark, sf_dir)
    return labels, E.answers(labels, tables.sightings(spark, sf_dir))


@query(
    "eval_route_answer",
    """select case_id, case when unanswered is null then first_id end as low,
         case when unanswered is null then second_id end as high, unanswered, outcome, rule_id, cause
       from answers join labelled using (case_id)""",
)
def eval_route_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, given = judged(spark, sf_dir)
    return E.route(labels).join(given.drop("unanswered"), "case_id")


_SCORED = """
scored as (
  select *, case expectation when 'must-merge' then outcome = 'merged'
      when 'must-not-merge' then outcome in ('refused', 'abstained')
      else outcome = 'abstained' end as passed
  from answers where outcome is not null),
judged as (
  select *, passed and coalesce(expected_rule <> rule_id, false) as wrong_rule from scored)"""


@query("eval_score", "select case_id, expectation, outcome, passed from judged", _SCORED)
def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scored(*judged(spark, sf_dir)).select("case_id", "expectation", "outcome", "passed")


@query(
    "eval_wrong_rule",
    "select case_id, expected_rule, rule_id from judged where wrong_rule",
    _SCORED,
)
def eval_wrong_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.scored(*judged(spark, sf_dir)).where("wrong_rule")
    return rows.select("case_id", "expected_rule", "rule_id")


@query(
    "agg_truth_tally",
    """select expectation, count(*) as scored, count(*) filter (not passed) as failed from judged
       group by 1""",
    _SCORED,
)
def agg_truth_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tally(*judged(spark, sf_dir))


_FAMILIES = """
families as (
  select lower(trim(family)) as family, bool_or(expectation = 'must-merge') as has_merge,
    bool_or(expectation = 'must-not-merge') as has_not_merge
  from labelled where family is not null group by 1)"""


def sparse_families(labels: DataFrame) -> DataFrame:
    """Labels with a finer family, so that some families have one pole only."""
    n = F.substring_index("case_id", "-", -1).cast("bigint")
    return labels.withColumn(
        "family",
        F.when(
            F.col("family").isNotNull(), F.concat_ws("-", "family", int_div(n, 4).cast("string"))
        ),
    )


@query(
    "agg_incomplete_families",
    """select lower(family || '-' || cast(first_id // 4 as varchar)) as family,
         bool_or(expectation = 'must-merge') as has_merge,
         bool_or(expectation = 'must-not-merge') as has_not_merge
       from labelled where family is not null group by 1
       having not (bool_or(expectation = 'must-merge') and bool_or(expectation = 'must-not-merge'))""",
)
def agg_incomplete_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.incomplete_families(sparse_families(tables.labelled_pairs(spark, sf_dir)))


@query(
    "join_label_answer",
    """select case_id, 'answered' as kind, outcome, unanswered from answers
         where unanswered is distinct from 'no_level'
       union all select case_id, 'unaccounted', null, null from answers where unanswered = 'no_level'
       union all select case_id || '-more', 'unknown', null, null from answers
         where unanswered = 'no_pair'""",
)
def join_label_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and answers matched both ways: some answers left out, some naming no label."""
    labels, given = judged(spark, sf_dir)
    kept = given.where("unanswered is null or unanswered <> 'no_level'")
    strange = kept.where("unanswered = 'no_pair'").withColumn(
        "case_id", F.concat("case_id", F.lit("-more"))
    )
    all_given = kept.unionByName(strange)
    none = F.lit(None).cast("string")
    matched = E.joined(labels, all_given).where("_answered").select(
        "case_id", F.lit("answered").alias("kind"), "outcome", "unanswered"
    )
    missing = E.unaccounted_labels(labels, all_given).select(
        "case_id", F.lit("unaccounted").alias("kind"), none.alias("outcome"), none.alias("unanswered")
    )
    unknown = E.unknown_answers(labels, all_given).select(
        "case_id", F.lit("unknown").alias("kind"), none.alias("outcome"), none.alias("unanswered")
    )
    return matched.unionByName(missing).unionByName(unknown)


@query(
    "eval_report",
    """select r.*, f.n as incomplete_families,
         failures = 0 and wrong_rules = 0 and f.n = 0 and unanswered_must_merge = 0
           and unanswered_must_not_merge = 0 and unanswered_must_abstain = 0 and unaccounted = 0
           and discovered > 0 as passed
       from (select count(*) as discovered, count(a.outcome) as scored,
               count(*) filter (j.passed = false) as failures, count(*) filter (j.wrong_rule) as wrong_rules,
               count(*) filter (a.unanswered is not null and a.expectation = 'must-merge')
                 as unanswered_must_merge,
               count(*) filter (a.unanswered is not null and a.expectation = 'must-not-merge')
                 as unanswered_must_not_merge,
               count(*) filter (a.unanswered is not null and a.expectation = 'must-abstain')
                 as unanswered_must_abstain,
               0::bigint as unaccounted
             from answers a left join judged j using (case_id)) r,
            (select count(*) as n from families where not (has_merge and has_not_merge)) f""",
    _SCORED,
    _FAMILIES,
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(*judged(spark, sf_dir))


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run before, and one after names went missing and one source changed its capability."""
    labels, obs = tables.labelled_pairs(spark, sf_dir), tables.sightings(spark, sf_dir)
    n = F.substring_index("case_id", "-", -1).cast("bigint")
    full = F.array(*map(F.lit, S.FACT_KINDS))
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def run(given: DataFrame, as_of, kinds) -> DataFrame:
        rows = given.where("outcome is not null").join(
            labels.select("case_id", "replay"), "case_id"
        )
        return rows.select(
            "case_id", "outcome", "rule_id", "cause", as_of.alias("as_of"), kinds.alias("kinds")
        )

    keyless = F.filter("facts", lambda f: f["Mac"].isNull())
    later = obs.withColumn(
        "facts", F.when(F.col("obs_id") % 6 == 0, keyless).otherwise(F.col("facts"))
    )
    view = F.col("replay") == "view"
    before = run(E.answers(labels, obs), day, full).where(n % 10 != 1)
    after = run(
        E.answers(labels, later),
        F.when(F.col("replay") == "click", day + F.expr("interval 1 day")).otherwise(day),
        F.when(view, F.array(*map(F.lit, ["Mac", "IpV4"]))).otherwise(F.reverse(full)),
    ).where(n % 10 != 3)
    return before, after


_RUNS = """
after_run as (
  select a.case_id, l.replay, l.first_id,
    case when l.first_id % 6 = 0 or l.second_id % 6 = 0 then 'abstained' else a.outcome end as outcome
  from answers a join labelled l using (case_id) where a.outcome is not null),
compared_runs as (
  select r.case_id,
    case when r.first_id % 10 = 3 then 'only_before' when r.first_id % 10 = 1 then 'only_after'
         when r.replay in ('view', 'click') then 'incomparable'
         when a.outcome <> r.outcome then 'differing' else 'identical' end as bucket,
    case when r.first_id % 10 <> 1 then a.outcome end as before,
    case when r.first_id % 10 <> 3 then r.outcome end as after
  from after_run r join answers a using (case_id))"""


@query("join_run_compare", "select * from compared_runs", _RUNS)
def join_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compare_runs(*two_runs(spark, sf_dir))


@query(
    "eval_compare_records",
    """select case_id, bucket from compared_runs
       where bucket in ('identical', 'differing', 'incomparable')""",
    _RUNS,
)
def eval_compare_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = E.compare_runs(*two_runs(spark, sf_dir))
    return compared.where("before is not null and after is not null").select("case_id", "bucket")


@query("eval_compare_runs", "select bucket, count(*) as cases from compared_runs group by 1", _RUNS)
def eval_compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_buckets(E.compare_runs(*two_runs(spark, sf_dir)))


# ---------------------------------------------------------------- degraded feeds

MASKED = ["IpV4", "Hostname", "Rtt"]


def dense_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The feed with dense positions, and a cut in the middle of each stream."""
    slim = tables.feed(spark, sf_dir)
    feed = with_position(slim.withColumnRenamed("seq", "arrival"), ["stream"], ["arrival"])
    cuts = feed.groupBy("stream").agg(int_div(F.count("*"), 2).alias("k"))
    return feed, cuts


_DENSE = """
dense as (
  select *, seq as arrival, cast(row_number() over (partition by stream order by seq) - 1 as bigint) as place,
    count(*) over (partition by stream) // 2 as k from feed)"""


@query(
    "lim_prefix",
    "select stream, place as seq, record, obs_id from dense where place < k",
    _DENSE,
)
def lim_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each stream."""
    feed, cuts = dense_feed(spark, sf_dir)
    return robust.prefix(feed, cuts).select("stream", "seq", "record", "obs_id")


@query(
    "rob_cut",
    """select stream, place + case when place >= k then 1 else 0 end as seq, record, error_code from dense
       union all select distinct stream, k, 'failure', 'Unreachable' from dense""",
    _DENSE,
)
def rob_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, cuts = dense_feed(spark, sf_dir)
    return robust.cut(feed, cuts).select("stream", "seq", "record", "error_code")


@query(
    "rob_mask_capability",
    """select d.stream, d.place + case when d.place >= k then 1 else 0 end as seq, d.record,
         cast(count(f.kind) filter (d.place < k or f.kind in ('IpV4', 'Hostname', 'Rtt')) as int) as n_facts
       from dense d left join feed_facts f on f.seq = d.arrival group by d.stream, d.place, d.k, d.record
       union all select distinct stream, k, 'capability', 0 from dense""",
    _DENSE,
)
def rob_mask_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, cuts = dense_feed(spark, sf_dir)
    dated = cuts.join(robust.earliest_legal_date(feed, cuts), "stream")
    masked = robust.mask_capability(feed, dated.select("stream", "k", "as_of"), MASKED, F.col("as_of"))
    return masked.select(
        "stream", "seq", "record", F.greatest(F.size("facts"), F.lit(0)).alias("n_facts")
    )


@query(
    "rob_earliest_legal_date",
    "select stream, max(coalesce(observed_at, as_of)) as as_of from dense where place < k group by 1",
    _DENSE,
)
def rob_earliest_legal_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.earliest_legal_date(*dense_feed(spark, sf_dir))


@query(
    "rob_victim_kind",
    """select stream, victim, string_agg(kind, '|' order by kind) as kinds from (
         select distinct f.stream, f.kind, first_value(v.kind) over (partition by v.stream) as victim
         from feed_facts f join (
           select d.stream, f.kind from dense d join feed_facts f on f.seq = d.arrival where d.place >= d.k
           qualify row_number() over (partition by d.stream order by d.place, f.pos) = 1) v using (stream))
       where kind <> victim group by 1, 2""",
    _DENSE,
)
def rob_victim_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.victim_kind(*dense_feed(spark, sf_dir))
    return found.withColumn("kinds", ids("kinds"))


@query(
    "set_denied_present",
    """select d.stream, bool_or(coalesce(f.kind not in ('IpV4', 'Hostname', 'Rtt') and d.place >= d.k, false))
         as denied_present
       from dense d left join feed_facts f on f.seq = d.arrival group by 1""",
    _DENSE,
)
def set_denied_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, cuts = dense_feed(spark, sf_dir)
    return robust.denied_present(feed, cuts, MASKED)


_CLAIMS = """
claimed as (
  select obs_id, claim from all_facts
  union all select obs_id, 'provenance ' || strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') || '|' ||
    cast(l2_domain as varchar) || '|' || cast(vantage as varchar) || '|' || connector_id from obs)"""


@query("set_claims", "select obs_id, claim from claimed", _CLAIMS)
def set_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.claims(tables.sightings(spark, sf_dir))


def blind_run(obs: DataFrame) -> DataFrame:
    """The same sightings, one source without its macs and one telling its address twice."""
    no_mac = F.filter("facts", lambda f: f["Mac"].isNull())
    twice = F.concat("facts", F.slice("facts", 1, 1))
    return obs.withColumn(
        "facts",
        F.when(F.col("connector_id") == "view", no_mac)
        .when(F.col("connector_id") == "click", twice)
        .otherwise(F.col("facts")),
    )


@query(
    "set_unaccounted",
    """select f.obs_id, f.claim from all_facts f join obs o using (obs_id)
       where o.connector_id = 'click' and f.pos = 0""",
)
def set_unaccounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run claims beyond the first: the addresses told twice."""
    obs = tables.sightings(spark, sf_dir)
    return robust.unaccounted(robust.claims(blind_run(obs)), robust.claims(obs))


@query(
    "set_multiset_included",
    """select count(*) filter (o.connector_id = 'click' and f.pos = 0) = 0 as included,
         count(*) filter (o.connector_id = 'click' and f.pos = 0) as extra
       from all_facts f join obs o using (obs_id)""",
)
def set_multiset_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.sightings(spark, sf_dir)
    return robust.included(robust.claims(blind_run(obs)), robust.claims(obs))


@query("set_distinct_obs", "select distinct obs_id from feed where obs_id is not null")
def set_distinct_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.distinct_observations(tables.feed(spark, sf_dir).where("obs_id is not null"))


@query(
    "set_capability_split",
    """select s.stream, k.kind, s.kinds = 'all' or k.kind in ('Mac', 'IpV4', 'Hostname') as seen
       from (select stream, arg_max(kinds, seq) as kinds from feed where record = 'capability' group by 1) s,
         (select unnest(['Mac','IpV4','Hostname','DhcpLease','Uplink','OuiVendor','Rtt']) as kind) k""",
)
def set_capability_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds each source could and could not see at the end of its stream."""
    caps = tables.feed(spark, sf_dir).where("record = 'capability'")
    last = caps.groupBy("stream").agg(F.max(F.struct("seq", "kinds")).alias("last"))
    return robust.capability_split(last.select("stream", "last.kinds"))


@query(
    "agg_stream_context",
    """select f.stream, arg_min(f.connector_id, case when f.obs_id is not null then f.seq end) as connector_id,
         count(distinct case when f.obs_id is not null then f.l2_domain * 10 + f.vantage end) as scopes,
         (select string_agg(kind, '|' order by kind) from (
            select distinct kind from feed_facts x where x.stream = f.stream
            union select kind from (select unnest(['Mac','IpV4','Hostname','DhcpLease','Uplink',
                'OuiVendor','Rtt']) as kind) k
              where exists (select 1 from feed c where c.stream = f.stream and c.kinds = 'all')
                or (kind in ('Mac', 'IpV4', 'Hostname')
                    and exists (select 1 from feed c where c.stream = f.stream and c.kinds = 'some'))
          )) as kinds,
         min(coalesce(f.observed_at, f.as_of)) as earliest
       from feed f group by 1""",
)
def agg_stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = robust.stream_context(tables.feed(spark, sf_dir))
    return context.withColumn("kinds", ids("kinds"))


@query(
    "rob_order_free",
    """select 0::bigint as lost, 0::bigint as gained, (select count(*) from keys) +
         (select count(*) from obs where obs_id not in (select obs_id from keys)) as kept""",
)
def rob_order_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The desired links from the given order and from a shuffled one, compared both ways."""
    obs = tables.sightings(spark, sf_dir)
    mixed = robust.shuffled(obs, "obs_id", 7)
    none = links.empty_interfaces(obs)
    straight, other = links.desired(obs, none), links.desired(mixed, none)
    return compared(straight, other)


