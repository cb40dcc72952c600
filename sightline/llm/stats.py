"""Text statistics as Spark expressions: one row per document, no user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import words

WINDOW = 5

# Common function words of the four languages the rules know.
STOP_WORDS = (
    "the of and to in is it that was for on are as with be by at or an this from "
    "der die das und in zu den von mit ist des auf für nicht sich dem ein eine als auch "
    "de la le et les des un une du en que est pour qui dans par au sur ne pas il elle "
    "el los las y del se por con una su al lo para es como"
)
STOP_FORMS = sorted({f(w) for w in STOP_WORDS.split() for f in (str, str.capitalize, str.upper)})


def repeated_windows(word_list: Column) -> Column:
    """Words that lie in a ``WINDOW``-word window found twice or more, the first one included.

    Windows are compared by a 64-bit hash.  The sorted path is taken only by texts with a repeat,
    and takes n log n steps however often a window repeats.
    """
    n = F.size(word_list) - (WINDOW - 1)
    starts = F.sequence(F.lit(0), n - 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[word_list[i + k] for k in range(WINDOW)]))
    return F.when(n < 2, F.lit(0)).otherwise(_covered(hashes)).cast("bigint")


def _covered(hashes: Column) -> Column:
    """From the window hashes: inner arrays are bound by one-element transforms, so made once."""
    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_spread(h))

    return F.transform(F.array(hashes), of)[0]


def _spread(h: Column) -> Column:
    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(
            s,
            lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]))
            | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"])),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def union(p: Column) -> Column:
        each = F.transform(
            p,
            lambda x, k: F.when(k == F.size(p) - 1, F.lit(WINDOW)).otherwise(
                F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - x)
            ),
        )
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    found = F.transform(F.array(order), starts)
    return F.transform(found, union)[0]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, statistics): every column of ``docs`` packed in ``row``, then the counts of its text.

    A null text counts as an empty one.  Counts: ``n_chars`` code points, ``n_words``, ``word_chars``
    code points in words, ``n_symbols`` of ``#*$%&|<>``, ``n_lines`` lines with a word,
    ``n_dup_lines`` of them equal to an earlier one, ``n_repeat_words``, ``n_stop`` stop words,
    ``n_distinct`` words, ``n_upper`` upper-case ASCII letters, ``n_marks`` of ``!?``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        F.struct("*").alias("row"), body.alias("body"), words(F.col(text)).alias("w"),
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("l"),
    )
    return split.select(
        "row",
        F.char_length("body").cast("bigint").alias("n_chars"),
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        repeated_windows(F.col("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: x.isin(STOP_FORMS))).cast("bigint").alias("n_stop"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
        _removed("body", "[A-Z]+").alias("n_upper"),
        _removed("body", "[!?]+").alias("n_marks"),
    )


def _removed(text: str, pattern: str) -> Column:
    """How many ASCII characters match: what replacing runs of them takes off the length."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("bigint")
