"""The verdict algebra: rules speak about a pair, one decision comes out.

A rule is a function ``pairs -> (low, high, rule, verdict, evidence)``; the
verdicts of several rules are unioned and handed to :func:`decide`, whose result
does not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.functions.facts import macs

PAIR = ["low", "high"]


def own_keys(obs: DataFrame) -> DataFrame:
    """One row per sighting: its domain and its distinct macs (bounded by the row itself)."""
    return obs.select("obs_id", "l2_domain", macs().alias("macs"))


def pair_sides(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Attach both sides' keys to given pairs; the pair is first put in id order."""
    ordered = pairs.select(
        F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")
    ).where("low < high")
    side = own_keys(obs)
    low = side.select(
        F.col("obs_id").alias("low"), F.col("l2_domain").alias("low_domain"),
        F.col("macs").alias("low_macs"),
    )
    high = side.select(
        F.col("obs_id").alias("high"), F.col("l2_domain").alias("high_domain"),
        F.col("macs").alias("high_macs"),
    )
    return ordered.distinct().join(low, "low").join(high, "high")


def l1_verdicts(sides: DataFrame) -> DataFrame:
    """Verdict of the scoped-key rules on each pair."""
    keyless = (F.size("low_macs") == 0) | (F.size("high_macs") == 0)
    shared = (F.col("low_domain") == F.col("high_domain")) & F.arrays_overlap(
        "low_macs", "high_macs"
    )
    both = F.array("low", "high")
    return sides.select(
        *PAIR,
        F.when(keyless | shared, S.EXACT_MAC).otherwise(S.DISTINCT_MAC).alias("rule"),
        F.when(keyless, S.NEUTRAL)
        .when(shared, S.DECISIVE)
        .otherwise(S.DISQUALIFYING)
        .alias("verdict"),
        F.when(keyless, F.slice(both, 1, 0)).otherwise(both).alias("evidence"),
    )


def _smallest_rule(verdict: str) -> Column:
    return F.min(F.when(F.col("verdict") == verdict, F.col("rule")))


def _any(verdict: str) -> Column:
    return F.coalesce(F.bool_or(F.col("verdict") == verdict), F.lit(False))


def conclusion(
    disqualifying: Column, decisive: Column, supports: Column, opposes: Column
) -> dict[str, Column]:
    """Outcome, rule and cause from the smallest deciding rules and the two soft flags."""
    clear = decisive.isNotNull() & ~opposes
    return {
        "outcome": F.when(disqualifying.isNotNull(), S.NO_MATCH)
        .when(clear, S.MATCH)
        .otherwise(S.ABSTAINED),
        "rule_id": F.when(disqualifying.isNotNull(), disqualifying).when(clear, decisive),
        "cause": F.when(disqualifying.isNotNull() | clear, F.lit(None)).otherwise(
            F.when(decisive.isNotNull() | supports, S.AMBIGUOUS).otherwise(S.ABSENCE_OF_PROOF)
        ),
    }


def decide(
    verdicts: DataFrame, by: list[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """One decision per pair, with the verdicts it rests on (at most one per rule).

    With ``pairs``, a pair no rule spoke about abstains.
    """
    by = by or PAIR
    summed = verdicts.groupBy(*by).agg(
        _smallest_rule(S.DISQUALIFYING).alias("_dq"),
        _smallest_rule(S.DECISIVE).alias("_dc"),
        _any(S.SUPPORTS).alias("_su"),
        _any(S.OPPOSES).alias("_op"),
        _vector().alias("verdicts"),
    )
    if pairs is not None:
        summed = pairs.select(*by).distinct().join(summed, by, "left")
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("_su", "_op")}
    parts = conclusion(F.col("_dq"), F.col("_dc"), flag["_su"], flag["_op"])
    return summed.select(
        *by,
        *[parts[c].alias(c) for c in ("outcome", "rule_id", "cause")],
        F.lit(S.RULESET_VERSION).alias("ruleset_version"),
        F.coalesce("verdicts", F.array().cast("array<struct<rule:string,verdict:string>>")).alias("verdicts"),
    )


def _vector() -> Column:
    """The verdicts of a pair as one sorted array; bounded by the number of rules."""
    return F.sort_array(F.collect_set(F.struct("rule", "verdict")))


def decide_l1(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Scoped-key decision of given pairs.  One rule speaks per pair, so nothing is grouped."""
    verdicts = l1_verdicts(pair_sides(pairs, obs))
    rule = {v: F.when(F.col("verdict") == v, F.col("rule")) for v in (S.DISQUALIFYING, S.DECISIVE)}
    parts = conclusion(rule[S.DISQUALIFYING], rule[S.DECISIVE], F.lit(False), F.lit(False))
    return verdicts.select(
        *PAIR, *[parts[c].alias(c) for c in ("outcome", "rule_id", "cause")], "evidence"
    )


def decide_alone(groups: DataFrame) -> DataFrame:
    """Lone members of a key group: placed by their own key, evidence themselves."""
    return groups.where("members = 1").select(
        F.col("first_id").alias("obs_id"),
        F.lit(S.MATCH).alias("outcome"),
        F.lit(S.EXACT_MAC).alias("rule_id"),
        F.array("first_id").alias("evidence"),
    )


def decision_rule(outcome: Column, rule_id: Column) -> Column:
    """Rule a decision names; an abstention names none."""
    return F.when(outcome != S.ABSTAINED, rule_id)


def scored_outcome(outcome: Column) -> Column:
    """Decision outcome in the words of the scoring table."""
    return (
        F.when(outcome == S.MATCH, "merged")
        .when(outcome == S.NO_MATCH, "refused")
        .when(outcome == S.ABSTAINED, "abstained")
    )
