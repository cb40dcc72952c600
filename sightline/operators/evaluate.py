"""Scoring a linking run against labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.operators.quality import folded
from sightline.operators.verdicts import decide_l1, scored_outcome

# Why a labelled pair gets no answer at this level.
NO_PAIR, NO_LEVEL, OTHER_LEVEL = "no_pair", "no_level", "level_not_implemented"


def route(labels: DataFrame) -> DataFrame:
    """(case_id, low, high, unanswered): the pair test comes first, then the rule's level."""
    named = F.col("observations")
    pair = (F.size(named) == 2) & (named[0] != named[1])
    cause = (
        F.when(~F.coalesce(pair, F.lit(False)), NO_PAIR)
        .when(F.col("expected_rule").isNull(), NO_LEVEL)
        .when(~F.col("expected_rule").startswith(S.L1_PREFIX), OTHER_LEVEL)
    )
    routed = labels.withColumn("unanswered", cause)
    asked = F.col("unanswered").isNull()
    return routed.select(
        "case_id",
        F.when(asked, F.array_min("observations")).alias("low"),
        F.when(asked, F.array_max("observations")).alias("high"),
        "unanswered",
    )


def answers(labels: DataFrame, obs: DataFrame) -> DataFrame:
    """(case_id, outcome, rule_id, cause, unanswered): what the scoped-key level says."""
    routed = route(labels)
    asked = routed.where("unanswered is null").select("case_id", "low", "high")
    decided = decide_l1(asked.select("low", "high"), obs).select(
        "low", "high", scored_outcome(F.col("outcome")).alias("outcome"), "rule_id", "cause"
    )
    # Unanswered cases have no key to join on: they would all meet in one task.
    answered = asked.join(decided, ["low", "high"], "left").select(
        "case_id", "outcome", "rule_id", "cause", F.lit(None).cast("string").alias("unanswered")
    )
    silent = routed.where("unanswered is not null").select("case_id", "unanswered")
    return answered.unionByName(silent, allowMissingColumns=True)


def passes(expectation: Column, outcome: Column) -> Column:
    """The 3x3 table: only must-not-merge also accepts an abstention."""
    return (
        F.when(expectation == S.MUST_MERGE, outcome == "merged")
        .when(expectation == S.MUST_NOT_MERGE, outcome.isin("refused", "abstained"))
        .when(expectation == S.MUST_ABSTAIN, outcome == "abstained")
    )


def wrong_rule(passed: Column, expected_rule: Column, rule_id: Column) -> Column:
    """Right verdict by another rule; judged only where both sides name one."""
    return passed & F.coalesce(expected_rule != rule_id, F.lit(False))


def joined(labels: DataFrame, given: DataFrame) -> DataFrame:
    """Labels with their answers; a label without an answer keeps NULLs."""
    answer = given.select("case_id", "outcome", "rule_id", "cause", "unanswered").withColumn(
        "_answered", F.lit(True)
    )
    return labels.join(answer, "case_id", "left")


def unknown_answers(labels: DataFrame, given: DataFrame) -> DataFrame:
    """Answers naming no label: an error of the producer."""
    return given.select("case_id").join(labels.select("case_id"), "case_id", "left_anti")


def unaccounted_labels(labels: DataFrame, given: DataFrame) -> DataFrame:
    """Labels no answer was given for, not even a declined one."""
    return labels.select("case_id").join(given.select("case_id"), "case_id", "left_anti")


def scored(labels: DataFrame, given: DataFrame) -> DataFrame:
    """(case_id, expectation, outcome, passed, wrong_rule) of the cases that were decided."""
    rows = joined(labels, given).where("outcome is not null")
    ok = passes(F.col("expectation"), F.col("outcome"))
    return rows.select(
        "case_id", "expectation", "outcome", "expected_rule", "rule_id",
        ok.alias("passed"),
        wrong_rule(ok, F.col("expected_rule"), F.col("rule_id")).alias("wrong_rule"),
    )


def tally(labels: DataFrame, given: DataFrame) -> DataFrame:
    """Scored and failed cases per expectation."""
    return scored(labels, given).groupBy("expectation").agg(
        F.count("*").alias("scored"),
        F.sum(F.when(F.col("passed"), 0).otherwise(1)).cast("bigint").alias("failed"),
    )


def incomplete_families(labels: DataFrame) -> DataFrame:
    """Families, case-folded, lacking a must-merge or a must-not-merge case."""
    wants = F.col("expectation")
    return (
        labels.where("family is not null")
        .groupBy(folded(F.col("family")).alias("family"))
        .agg(
            F.bool_or(wants == S.MUST_MERGE).alias("has_merge"),
            F.bool_or(wants == S.MUST_NOT_MERGE).alias("has_not_merge"),
        )
        .where("not (has_merge and has_not_merge)")
    )


def report(labels: DataFrame, given: DataFrame) -> DataFrame:
    """One row: discovered, scored, failures, wrong rules, declined and missing answers."""
    rows = joined(labels, given)
    ok = passes(F.col("expectation"), F.col("outcome"))

    def n(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("bigint")

    decided, declined = F.col("outcome").isNotNull(), F.col("unanswered").isNotNull()
    counts = rows.agg(
        F.count("*").alias("discovered"),
        n(decided).alias("scored"),
        n(decided & ~ok).alias("failures"),
        n(decided & wrong_rule(ok, F.col("expected_rule"), F.col("rule_id"))).alias("wrong_rules"),
        *[
            n(declined & (F.col("expectation") == e)).alias("unanswered_" + e.replace("-", "_"))
            for e in (S.MUST_MERGE, S.MUST_NOT_MERGE, S.MUST_ABSTAIN)
        ],
        n(F.col("_answered").isNull()).alias("unaccounted"),
    )
    families = incomplete_families(labels).agg(F.count("*")).scalar()
    full = counts.withColumn("incomplete_families", families)
    clear = (
        (F.col("discovered") > 0)
        & (F.col("failures") == 0)
        & (F.col("wrong_rules") == 0)
        & (F.col("incomplete_families") == 0)
        & (F.col("unanswered_must_merge") == 0)
        & (F.col("unanswered_must_not_merge") == 0)
        & (F.col("unanswered_must_abstain") == 0)
        & (F.col("unaccounted") == 0)
    )
    return full.withColumn("passed", clear)


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases of two runs, each in one bucket.

    A run is (case_id, outcome, rule_id, cause, as_of, kinds).  Cases whose
    capability snapshots differ, date included, cannot be compared.
    """
    def side(run: DataFrame, name: str) -> DataFrame:
        return run.select(
            "case_id",
            F.struct(
                F.struct("outcome", "rule_id", "cause").alias("said"),
                F.struct("as_of", F.array_sort("kinds").alias("kinds")).alias("saw"),
            ).alias(name),
        )

    b, a = F.col("b"), F.col("a")
    bucket = (
        F.when(a.isNull(), "only_before")
        .when(b.isNull(), "only_after")
        .when(~b["saw"].eqNullSafe(a["saw"]), "incomparable")
        .when(~b["said"].eqNullSafe(a["said"]), "differing")
        .otherwise("identical")
    )
    return side(before, "b").join(side(after, "a"), "case_id", "full_outer").select(
        "case_id",
        bucket.alias("bucket"),
        F.col("b.said.outcome").alias("before"),
        F.col("a.said.outcome").alias("after"),
    )


def run_buckets(compared: DataFrame) -> DataFrame:
    return compared.groupBy("bucket").agg(F.count("*").alias("cases"))
