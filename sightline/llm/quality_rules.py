"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.stats import with_statistics


class Rule(NamedTuple):
    """``low <= over / under <= high``, asked only of texts with at least ``from_words`` words."""

    name: str
    over: str
    under: str
    low: float | None
    high: float | None
    from_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("marks_per_word", "n_marks", "n_words", None, 0.5),
    Rule("stop_word_ratio", "n_stop", "n_words", 0.03, None, 40),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.6),
    Rule("upper_case_ratio", "n_upper", "n_chars", None, 0.4),
)


def passes(rule: Rule) -> Column:
    ratio = F.col(rule.over) / F.greatest(F.col(rule.under), F.lit(1))
    tests = [F.col("n_words") < rule.from_words] if rule.from_words else []
    inside = F.lit(True)
    if rule.low is not None:
        inside = inside & (ratio >= rule.low)
    if rule.high is not None:
        inside = inside & (ratio <= rule.high)
    return tests[0] | inside if tests else inside


def base_failed() -> Column:
    """Too short, or more than a fifth of the words lie in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(row, statistics, base_failed, failed_rules, kept) for every row of ``docs``.

    ``row`` holds the input's columns as they are, whatever their names.  A null or empty text has
    no words and fails the base test; repeated rows are judged alike; an empty table gives none.
    """
    failed = F.filter(
        F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    return (
        with_statistics(docs, text)
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    return judge(docs, rules, text).where("kept").select("row.*")
