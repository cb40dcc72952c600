"""Versioned links from sightings to interfaces.

One pass compares what the batch implies with the current engine-made rows on
the slot (observation_id, subject).  The pass is a pure function from
(sightings, interfaces, links) to the next interfaces and links; the actions it
took are a frame of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions.facts import int_div, macs, open_end, uuid_shaped
from sightline.operators.keys import KEY, key_groups, seen_window, witnesses_within
from sightline.plans.lineage import cut
from sightline.plans.skew import lookup

SLOT = ["observation_id", "subject"]
DECISION = ["interface_id", "outcome", "rule_id", "cause", "evidence", "ruleset_version"]


class Refused(ValueError):
    """A pass that must not write."""


def content() -> Column:
    """What a sighting says, as text."""
    return F.to_json(
        F.struct(
            "connector_id", "observed_at", "l2_domain", "vantage",
            F.size("facts").alias("n"), F.sort_array(F.array_distinct("facts")).alias("facts"),
        )
    )


def contradictions(obs: DataFrame) -> DataFrame:
    """Ids sighted more than once with different content.

    Content is source, instant, scope, the number of facts and the fact *set*:
    raw text and fact order do not count, nor which fact of equally many repeats.
    """
    versions = obs.select("obs_id", content().alias("_content")).distinct()
    return (
        versions.groupBy("obs_id").agg(F.count("*").alias("versions")).where("versions > 1")
    )


def slim(obs: DataFrame) -> DataFrame:
    """What a pass needs of each sighting, read once and checkpointed.

    A pass looks at the sightings from several sides; this narrow copy keeps it
    from reading the wide table again for each.  Repeats of a sighting are equal
    up to raw text and fact order, so they collapse here.
    """
    return cut(
        obs.select(
            "obs_id", "observed_at", "l2_domain", F.array_sort(macs()).alias("macs")
        ).distinct()
    )


def keys_of(rows: DataFrame) -> DataFrame:
    """Membership rows of slim sightings; no shuffle, they are distinct already."""
    return rows.select("obs_id", "l2_domain", F.explode("macs").alias("mac"), "observed_at")


def minted_id(domain: Column, mac: Column) -> Column:
    """Id of an interface never met before: a digest of its key, equal on every replay."""
    return uuid_shaped(domain.cast("string"), mac)


def resolved_interfaces(keys: DataFrame, interfaces: DataFrame, by: list[str] = KEY) -> DataFrame:
    """One row per scoped key of the batch (per key and part with a longer ``by``): the interface found or
    minted, and its window."""
    held = interfaces.groupBy(*KEY).agg(
        F.min_by(
            F.struct("interface_id", "first_seen_at", "last_seen_at"), F.col("interface_id")
        ).alias("held")
    )
    return key_groups(keys, by).join(held, KEY, "left").select(
        *by,
        "members",
        "first_id",
        "second_id",
        F.coalesce("held.interface_id", minted_id(F.col("l2_domain"), F.col("mac"))).alias(
            "interface_id"
        ),
        F.col("held.interface_id").isNull().alias("minted"),
        # least and greatest skip NULLs, so an interface without a window takes the batch's.
        F.least("first_seen_at", "held.first_seen_at").alias("first_seen_at"),
        F.greatest("last_seen_at", "held.last_seen_at").alias("last_seen_at"),
    )


def widened_interfaces(interfaces: DataFrame, resolved: DataFrame) -> DataFrame:
    """Next interface table: stored windows widened, never narrowed, and minted rows added."""
    found = resolved.where("not minted").select(
        "interface_id",
        F.col("first_seen_at").alias("_first"),
        F.col("last_seen_at").alias("_last"),
    )
    kept = interfaces.join(found, "interface_id", "left").select(
        "interface_id",
        *KEY,
        F.least("first_seen_at", "_first").alias("first_seen_at"),
        F.greatest("last_seen_at", "_last").alias("last_seen_at"),
    )
    fresh = resolved.where("minted").select(*S.INTERFACE_COLUMNS)
    return kept.select(*S.INTERFACE_COLUMNS).unionByName(fresh)


def _evidence(member: Column, witness: Column) -> Column:
    return F.when(member == witness, F.array(member)).otherwise(
        F.array(F.least(member, witness), F.greatest(member, witness))
    )


def placements(
    keys: DataFrame, resolved: DataFrame, universe: DataFrame | None = None, by: list[str] = KEY
) -> DataFrame:
    """A row per (sighting, interface) the batch places; witnesses agree in ``by``."""
    if universe is None:
        member = F.col("obs_id")
        witness = F.when(
            member == F.col("first_id"), F.coalesce("second_id", "obs_id")
        ).otherwise(F.col("first_id"))
        group = resolved.select(*by, "members", "first_id", "second_id", "interface_id")
        placed = lookup(keys, group, by, "members", "obs_id").withColumn("witness", witness)
    else:
        group = resolved.select(*KEY, "members", "interface_id")
        seen_at = keys.select("obs_id", *KEY, "observed_at")
        within = witnesses_within(keys, universe).join(seen_at, ["obs_id", *KEY])
        placed = lookup(within, group, KEY, "members", "obs_id")
    return placed.select(
        F.col("obs_id").alias("observation_id"),
        F.col("interface_id").alias("subject"),
        "interface_id",
        F.lit(S.MATCH).alias("outcome"),
        F.lit(S.EXACT_MAC).alias("rule_id"),
        F.lit(None).cast("string").alias("cause"),
        _evidence(F.col("obs_id"), F.col("witness")).alias("evidence"),
        F.lit(S.RULESET_VERSION).alias("ruleset_version"),
        F.col("observed_at").alias("valid_from"),
    )


def abstentions(batch: DataFrame, placed: DataFrame) -> DataFrame:
    """Sightings nothing placed: one abstention each."""
    left_over = batch.join(
        placed.select(F.col("observation_id").alias("obs_id")), "obs_id", "left_anti"
    )
    nothing = F.slice(F.array("obs_id"), 1, 0)
    return left_over.select(
        F.col("obs_id").alias("observation_id"),
        F.lit(S.NIL_ID).alias("subject"),
        F.lit(None).cast("string").alias("interface_id"),
        F.lit(S.ABSTAINED).alias("outcome"),
        F.lit(None).cast("string").alias("rule_id"),
        F.lit(S.ABSENCE_OF_PROOF).alias("cause"),
        nothing.alias("evidence"),
        F.lit(S.RULESET_VERSION).alias("ruleset_version"),
        F.col("observed_at").alias("valid_from"),
    )


def desired_of(
    rows: DataFrame, resolved: DataFrame, universe: DataFrame | None = None
) -> DataFrame:
    placed = placements(keys_of(rows), resolved, universe)
    return placed.unionByName(abstentions(rows.select("obs_id", "observed_at"), placed))


def desired(
    obs: DataFrame, interfaces: DataFrame, universe: DataFrame | None = None
) -> DataFrame:
    """Everything the batch implies: placements and abstentions."""
    rows = slim(obs)
    return desired_of(rows, resolved_interfaces(keys_of(rows), interfaces), universe)


def current(links: DataFrame) -> DataFrame:
    return links.where("current_subject is not null")


def engine_current(links: DataFrame) -> DataFrame:
    """Current rows the engine made; an operator's rows are never compared or closed."""
    return current(links).where(F.col("decided_by") == S.ENGINE)


def same_decision(left: str, right: str) -> Column:
    """Equality on the six decision columns, NULL equal to NULL."""
    test = F.lit(True)
    for c in DECISION:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


def _held(links: DataFrame) -> DataFrame:
    return engine_current(links).select(
        "observation_id",
        F.col("current_subject").alias("subject"),
        F.struct(
            "interface_id", "outcome", "rule_id", F.col("abstention_cause").alias("cause"),
            "evidence", "ruleset_version",
        ).alias("held"),
        F.col("valid_from").alias("held_from"),
        F.col("link_id").alias("held_link"),
    )


def diff(wanted: DataFrame, links: DataFrame, batch: DataFrame) -> DataFrame:
    """One action per slot: written, unchanged, superseded or vacated.

    ``batch`` is (obs_id, observed_at), one row per sighting.  A held slot of a
    sighting in the batch that the pass did not revisit is vacated; sightings
    outside the batch are left alone.
    """
    wants = wanted.select(
        *SLOT, F.struct(*DECISION).alias("wants"), F.col("valid_from").alias("wants_from")
    )
    seen = batch.select(
        F.col("obs_id").alias("observation_id"), F.col("observed_at").alias("batch_at")
    )
    held = _held(links).join(seen, "observation_id")
    action = (
        F.when(F.col("held").isNull(), "written")
        .when(F.col("wants").isNull(), "vacated")
        .when(same_decision("wants", "held"), "unchanged")
        .otherwise("superseded")
    )
    return wants.join(held, SLOT, "full_outer").select(
        *SLOT,
        action.alias("action"),
        "wants",
        "held",
        "held_link",
        "held_from",
        F.coalesce("wants_from", "batch_at").alias("at"),
    )


def regressed(actions: DataFrame) -> DataFrame:
    """Replacements dated before the version they would replace."""
    return actions.where("action = 'superseded' and at < held_from").select(
        *SLOT, "held_from", "at"
    )


def operator_collisions(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """Slots the pass wants to write while an operator holds them."""
    owned = current(links).where(F.col("decided_by") == S.OPERATOR)
    return wanted.select(*SLOT).join(
        owned.select("observation_id", F.col("current_subject").alias("subject"), "link_id"), SLOT
    )


def close_refusals(links: DataFrame, closing: DataFrame) -> DataFrame:
    """Why a close is refused: no such link, closed already, the open end, or an end before its start."""
    state = links.select("link_id", "current_subject", "valid_from", F.lit(True).alias("_known"))
    reason = (
        F.when(F.col("close_at") == open_end(), "open_end")
        .when(F.col("_known").isNull(), "unknown_link")
        .when(F.col("current_subject").isNull(), "already_closed")
        .when(F.col("close_at") < F.col("valid_from"), "inverted")
    )
    return (
        closing.join(state, "link_id", "left")
        .select("link_id", reason.alias("reason"))
        .where("reason is not null")
    )


def close(links: DataFrame, closing: DataFrame) -> DataFrame:
    """Set valid_to and clear the subject of the (link_id, close_at) rows given.

    Rows that ``close_refusals`` names change nothing.
    """
    ends = closing.where(F.col("close_at") < open_end()).select("link_id", "close_at")
    ending = F.col("current_subject").isNotNull() & F.coalesce(
        F.col("close_at") >= F.col("valid_from"), F.lit(False)
    )
    return links.join(ends, "link_id", "left").select(
        *[
            F.when(ending, F.lit(None)).otherwise(F.col(c)).alias(c)
            if c == "current_subject"
            else F.when(ending, F.col("close_at")).otherwise(F.col(c)).alias(c)
            if c == "valid_to"
            else F.col(c)
            for c in links.columns
        ]
    )


def fresh_versions(actions: DataFrame, pass_id: str | Column) -> DataFrame:
    """Versions the pass opens."""
    pass_id = F.lit(pass_id) if isinstance(pass_id, str) else pass_id
    return actions.where("action in ('written', 'superseded')").select(
        uuid_shaped(
            pass_id, F.col("observation_id").cast("string"), F.col("subject")
        ).alias("link_id"),
        "observation_id",
        "wants.interface_id",
        F.col("subject").alias("current_subject"),
        "wants.outcome",
        "wants.rule_id",
        F.col("wants.cause").alias("abstention_cause"),
        "wants.evidence",
        "wants.ruleset_version",
        F.lit(S.ENGINE).alias("decided_by"),
        F.col("at").alias("valid_from"),
        open_end().alias("valid_to"),
    )


def endings(actions: DataFrame) -> DataFrame:
    """(link_id, close_at) of the versions the pass ends."""
    return actions.where("action in ('superseded', 'vacated')").select(
        F.col("held_link").alias("link_id"), F.col("at").alias("close_at")
    )


def next_links(links: DataFrame, actions: DataFrame, pass_id: str) -> DataFrame:
    """The link table after the pass: ends closed, new versions appended."""
    kept = close(links, endings(actions)).select(*S.LINK_COLUMNS)
    return kept.unionByName(fresh_versions(actions, pass_id))


def changed_links(links: DataFrame, actions: DataFrame, pass_id: str | Column) -> DataFrame:
    """Only the rows the pass touched, for a table kept as a log of changes."""
    ends = endings(actions)
    ended = links.join(ends.select("link_id"), "link_id", "left_semi")
    return close(ended, ends).select(*S.LINK_COLUMNS).unionByName(fresh_versions(actions, pass_id))


def summary(rows: DataFrame, resolved: DataFrame, actions: DataFrame) -> DataFrame:
    """Eight counts of a pass, as one row; ``abstained`` is a part of ``written``."""
    def of(test: str) -> Column:
        return F.coalesce(F.sum(F.expr(f"case when {test} then 1 else 0 end")), F.lit(0)).cast(
            "bigint"
        )

    n = F.col("observations")
    pairs = rows.agg(F.count("*").alias("observations")).select(
        int_div(n * (n - 1), 2).alias("candidate_pairs")
    )
    met = resolved.agg(of("minted").alias("m"), of("not minted").alias("f"))
    done = actions.agg(
        of("action in ('written', 'superseded')").alias("links_written"),
        of("action in ('written', 'superseded') and wants.outcome = 'abstained'").alias(
            "links_abstained"
        ),
        of("action = 'superseded'").alias("links_superseded"),
        of("action = 'unchanged'").alias("links_unchanged"),
        of("action = 'vacated'").alias("links_vacated"),
    )
    return done.select(
        pairs.scalar().alias("candidate_pairs"),
        met.select("m").scalar().alias("interfaces_minted"),
        met.select("f").scalar().alias("interfaces_found"),
        "links_written",
        "links_abstained",
        "links_superseded",
        "links_unchanged",
        "links_vacated",
    )


@dataclass
class Pass:
    """What a pass yields; every frame is lazy."""

    interfaces: DataFrame
    links: DataFrame
    actions: DataFrame
    summary: DataFrame
    resolved: DataFrame
    late: DataFrame


def resolve(
    obs: DataFrame,
    interfaces: DataFrame,
    links: DataFrame,
    pass_id: str,
    universe: DataFrame | None = None,
    check: bool = True,
    settle: bool = False,
    set_late_aside: bool = False,
    rows: DataFrame | None = None,
    settle_actions: bool = True,
) -> Pass:
    """A whole pass.  With ``check``, refusals are looked for before anything is returned.

    ``rows`` are the slim sightings where the caller has settled them already; without ``settle_actions``
    the actions are left lazy, for a caller that reads them once.

    With ``settle`` the interfaces met and the actions are checkpointed, so the
    tables written from them come from one computation.  With ``set_late_aside``
    a replacement dated before the version it would replace is left out of the
    pass and returned as ``late`` instead of refusing the whole batch.
    """
    if check and not contradictions(obs).isEmpty():
        raise Refused("sightings of one id differ")
    rows = slim(obs) if rows is None else rows
    resolved = resolved_interfaces(keys_of(rows), interfaces)
    if settle:
        resolved = cut(resolved)
    wanted = desired_of(rows, resolved, universe)
    if check and not operator_collisions(wanted, links).isEmpty():
        raise Refused("an operator holds a slot this pass would write")
    actions = diff(wanted, links, rows)
    if settle and settle_actions:
        actions = cut(actions)
    late = regressed(actions)
    if set_late_aside:
        actions = actions.where("action <> 'superseded' or at >= held_from")
    elif check and not late.isEmpty():
        raise Refused("a replacement is dated before the version it replaces")
    return Pass(
        interfaces=widened_interfaces(interfaces, resolved),
        links=next_links(links, actions, pass_id),
        actions=actions,
        summary=summary(rows, resolved, actions),
        resolved=resolved,
        late=late,
    )


@dataclass
class Polls:
    """What the passes over the polls of a batch yield, each poll a pass of its own."""

    interfaces: DataFrame  # one row per key met, its windows over all polls merged
    actions: DataFrame  # as of ``diff``, with the poll and its name
    late: DataFrame
    refused: DataFrame  # (stream, reason)
    summary: DataFrame  # one row per poll


def resolve_polls(landed: DataFrame, interfaces: DataFrame, links: DataFrame) -> Polls:
    """The passes over several polls in one plan, as if each were resolved after those before it.

    ``landed`` has ``poll``, the place in the order of arrival, and ``stream``, its name, beside the
    columns of a sighting; every id stands in one poll.  Witnesses come from the own poll.  What a poll
    finds of the ones before it is whether a key was met, a minimum over the places, and the window,
    which only widens.  A poll that would write a slot held by an operator is refused whole.
    """
    by = [*KEY, "poll"]
    rows = cut(landed.select(
        "obs_id", "poll", "stream", "observed_at", "l2_domain", F.array_sort(macs()).alias("macs")
    ))
    keys = rows.select("obs_id", "l2_domain", F.explode("macs").alias("mac"), "observed_at", "poll")
    resolved = cut(resolved_interfaces(keys, interfaces, by))
    placed = placements(keys, resolved, by=by)
    wanted = placed.unionByName(abstentions(rows.select("obs_id", "observed_at"), placed))
    held = operator_collisions(wanted, links).select(F.col("observation_id").alias("obs_id"))
    # At most one row per poll.
    barred = cut(rows.join(held, "obs_id", "left_semi").select("poll", "stream").distinct())
    if not barred.isEmpty():
        out = F.broadcast(barred.select("poll"))
        rows, resolved = rows.join(out, "poll", "left_anti"), resolved.join(out, "poll", "left_anti")
        wanted = wanted.join(rows.select(F.col("obs_id").alias("observation_id")), "observation_id", "left_semi")
    first = F.min("poll").over(Window.partitionBy(*KEY))  # a row per poll and key
    resolved = resolved.withColumn("minted", F.col("minted") & (F.col("poll") == first))
    told = rows.select(F.col("obs_id").alias("observation_id"), "poll", "stream")
    actions = cut(diff(wanted, links, rows).join(told, "observation_id"))
    late = regressed(actions)
    actions = actions.where("action <> 'superseded' or at >= held_from")
    return Polls(
        interfaces=resolved.groupBy("interface_id", *KEY).agg(
            F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
        ),
        actions=actions,
        late=late,
        refused=barred.select("stream", F.lit("an operator holds a slot this pass would write").alias("reason")),
        summary=summary_by(rows, resolved, actions),
    )


def summary_by(rows: DataFrame, resolved: DataFrame, actions: DataFrame) -> DataFrame:
    """The counts of ``summary`` for each poll of ``rows``."""
    n = F.col("observations")
    polls = rows.groupBy("stream", "poll").agg(F.count("*").alias("observations"))
    met = resolved.groupBy("poll").agg(
        F.count_if("minted").alias("interfaces_minted"), F.count_if(~F.col("minted")).alias("interfaces_found")
    )
    new = F.col("action").isin("written", "superseded")
    done = actions.groupBy("poll").agg(
        F.count_if(new).alias("links_written"),
        F.count_if(new & (F.col("wants.outcome") == S.ABSTAINED)).alias("links_abstained"),
        *[F.count_if(F.col("action") == a).alias(f"links_{a}") for a in ("superseded", "unchanged", "vacated")],
    )
    found = polls.join(met, "poll", "left").join(done, "poll", "left")
    counts = [c for c in (*met.columns, *done.columns) if c != "poll"]
    return found.select(
        "stream", int_div(n * (n - 1), 2).alias("candidate_pairs"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
    )


def purge(links: DataFrame) -> DataFrame:
    """Links without the engine's rows; replaying the pass restores the same decisions."""
    return links.where(F.col("decided_by") != S.ENGINE)


def decisions(links: DataFrame) -> DataFrame:
    """Current decisions without row ids: what two replays must agree on."""
    return current(links).select(
        "observation_id", F.col("current_subject").alias("subject"), "interface_id", "outcome",
        "rule_id", "abstention_cause", "evidence", "ruleset_version",
    )


def snapshot(links: DataFrame) -> DataFrame:
    """Current links, ten decision columns, by sighting and subject."""
    return (
        current(links)
        .select(
            "observation_id", "interface_id", F.col("current_subject").alias("subject"),
            "outcome", "rule_id", "abstention_cause", "evidence", "ruleset_version",
            "decided_by", "valid_from",
        )
        .orderBy("observation_id", "subject")
    )


MOST_CANDIDATES = 8  # a page of them; what makes an ambiguity is told by the first


def best_candidates(found: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(observation_id, candidates): the first ``most`` interfaces of each sighting with their evidence.

    ``found`` is (observation_id, interface_id, evidence).  The rank is limited before the shuffle and
    again behind it, so an ambiguity with any number of candidates sends few rows per task and never
    gathers more than ``most`` of them.
    """
    ranked = Window.partitionBy("observation_id").orderBy("interface_id", "evidence")
    kept = found.withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") <= most)
    each = F.struct("_place", F.struct("interface_id", "evidence").alias("c"))
    return kept.groupBy("observation_id").agg(
        F.transform(F.sort_array(F.collect_list(each)), lambda x: x["c"]).alias("candidates")
    )


def ambiguous_links(
    decided: DataFrame, obs: DataFrame, interfaces: DataFrame, pass_id: str, most: int = MOST_CANDIDATES
) -> DataFrame:
    """Links of the sightings that an ambiguous pair decision leaves open, with their candidates.

    ``decided`` is (low, high, outcome, cause, ...).  The candidates of ``low`` are the interfaces of the
    keys of ``high``, the pair being the evidence.  A sighting without a candidate gets no link: an
    ambiguity has to name what it is between.
    """
    open_ = decided.where((F.col("outcome") == S.ABSTAINED) & (F.col("cause") == S.AMBIGUOUS)).select("low", "high")
    named = interfaces.select(*KEY, "interface_id")
    members = keys_of_obs(obs).select(F.col("obs_id").alias("high"), *KEY)
    pair = F.array(F.least("low", "high"), F.greatest("low", "high"))
    sided = open_.join(members, "high")
    met = lookup(sided, named.join(seen_weights(sided), KEY), KEY, "members", "high")
    found = met.select(F.col("low").alias("observation_id"), "interface_id", pair.alias("evidence")).distinct()
    at = obs.select(F.col("obs_id").alias("observation_id"), F.col("observed_at").alias("valid_from")).distinct()
    best = best_candidates(found, most).join(at, "observation_id")
    return best.select(
        uuid_shaped(F.lit(pass_id), F.col("observation_id").cast("string"), F.lit(S.NIL_ID)).alias("link_id"),
        "observation_id", F.lit(None).cast("string").alias("interface_id"), F.lit(S.NIL_ID).alias("current_subject"),
        F.lit(S.ABSTAINED).alias("outcome"), F.lit(None).cast("string").alias("rule_id"),
        F.lit(S.AMBIGUOUS).alias("abstention_cause"), F.slice(F.array("observation_id"), 1, 0).alias("evidence"),
        F.lit(S.RULESET_VERSION).alias("ruleset_version"), F.lit(S.ENGINE).alias("decided_by"), "valid_from",
        open_end().alias("valid_to"), "candidates",
    )


def seen_weights(sided: DataFrame) -> DataFrame:
    """How many rows of ``sided`` ask for each key."""
    return sided.groupBy(*KEY).agg(F.count("*").alias("members"))


def keys_of_obs(obs: DataFrame) -> DataFrame:
    return obs.select("obs_id", "l2_domain", F.explode(macs()).alias("mac")).distinct()


def candidates_of(links: DataFrame) -> DataFrame:
    """(link_id, observation_id, cause, interface_id, evidence) of stored links, in the order of a page."""
    each = links.where("current_subject is not null").select(
        "link_id", "observation_id", F.col("abstention_cause").alias("cause"), F.explode("candidates").alias("c")
    )
    return each.select("link_id", "observation_id", "cause", "c.interface_id", "c.evidence")


def refused_links(links: DataFrame) -> DataFrame:
    """(link_id, reason) of link rows with candidates that may not be written, by ``guard_refusals``."""
    decided = links.select(
        F.col("link_id").alias("decision_id"), "outcome", "rule_id", F.col("abstention_cause").alias("cause")
    )
    some = links.where("size(candidates) > 0").select(F.col("link_id").alias("decision_id"))
    return guard_refusals(decided, some).withColumnRenamed("decision_id", "link_id")


def guard_refusals(decided: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions that may not be written: ambiguity without candidates, or no rule named.

    ``decided`` is (decision_id, outcome, rule_id, cause); ``candidates`` is
    (decision_id, …) with any number of rows per decision.
    """
    some = candidates.select("decision_id", F.lit(True).alias("_some")).distinct()
    reason = F.when(
        (F.col("outcome") == S.ABSTAINED)
        & (F.col("cause") == S.AMBIGUOUS)
        & F.col("_some").isNull(),
        "ambiguous_without_candidate",
    ).when(
        (F.col("outcome") != S.ABSTAINED) & (F.coalesce("rule_id", F.lit("")) == ""),
        "decision_without_rule",
    )
    return (
        decided.join(some, "decision_id", "left")
        .select("decision_id", reason.alias("reason"))
        .where("reason is not null")
    )


def empty_links(obs: DataFrame) -> DataFrame:
    """A link table with no rows, typed after the sightings' own id and instant."""
    ids, at = obs.schema["obs_id"].dataType, obs.schema["observed_at"].dataType
    types = dict.fromkeys(S.LINK_COLUMNS, "string") | {
        "observation_id": ids.simpleString(),
        "evidence": f"array<{ids.simpleString()}>",
        "ruleset_version": "int",
        "valid_from": at.simpleString(),
        "valid_to": at.simpleString(),
    }
    return _empty(obs.sparkSession, types)


def _empty(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    # Known to be empty when a plan is made, so joins with it fall away.
    return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(t).alias(c) for c, t in types.items()])


def empty_interfaces(obs: DataFrame) -> DataFrame:
    domain, at = obs.schema["l2_domain"].dataType, obs.schema["observed_at"].dataType
    types = dict.fromkeys(S.INTERFACE_COLUMNS, "string") | {
        "l2_domain": domain.simpleString(), "first_seen_at": at.simpleString(), "last_seen_at": at.simpleString()
    }
    return _empty(obs.sparkSession, types)
