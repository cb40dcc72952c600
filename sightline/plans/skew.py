"""Joining rows to one-row-per-key summaries when a key may hold most rows.

The summary is settled and measured.  A small one is broadcast, so the rows do
not move at all.  Beyond the bound every key gets as many salts as its weight
asks for, without a limit on the keys or on the salts.  Keys are salted from a
share of the rows that keeps their table within the broadcast bound.  None of
this changes a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.plans.lineage import cut

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
ROWS_PER_SALT = 100_000


def _width(df: DataFrame) -> Column:
    """Bytes of a row, from the lengths of its texts; columns of other kinds count what their text would."""
    parts = [F.lit(16 * len(df.columns))]
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "string":
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif "<" in kind:
            parts.append(F.coalesce(F.length(F.to_json(F.struct(f.name))), F.lit(0)))
    return reduce(lambda a, b: a + b, parts)


def measured(summary: DataFrame) -> tuple[DataFrame, bool]:
    """The summary, settled, and whether its rows and bytes are within the broadcast bound.

    A summary is measured once: asked again of the same frame, the answer is kept.
    """
    found = getattr(summary, "_measured", None)
    if found is None:
        settled = cut(summary)
        rows, size = settled.agg(F.count("*"), F.sum(_width(settled))).first()
        found = settled, rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
        summary._measured = settled._measured = found
    return found


def unsent(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, never broadcast.

    Spark guesses the size of settled rows from the files they were once read from, which may be a small
    part of it; a guess under its bound sends every row through the driver.
    """
    return rows.hint("merge")


def heavy_keys(weights: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, _salts) of every key that needs more than one task.

    At most BROADCAST_ROWS keys can hold the share of the rows that counts as heavy.
    """
    total = weights.agg(F.sum(weight)).first()[0] or 0
    share = max(ROWS_PER_SALT, -(-total // BROADCAST_ROWS))
    return weights.where(F.col(weight) > share).select(
        *keys, F.ceil(F.col(weight) / F.lit(share)).cast("bigint").alias("_salts")
    )


def lookup(
    rows: DataFrame,
    summary: DataFrame,
    keys: list[str],
    weight: str,
    spread_on: str,
    how: str = "inner",
    weights: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``summary`` (unique on ``keys``), salting the heavy keys.

    ``weights`` is the frame that holds the row count per key when it is not
    the summary itself.
    """
    summary, small = measured(summary)
    if small:
        return rows.join(F.broadcast(summary), keys, how)
    heavy = F.broadcast(heavy_keys(summary if weights is None else weights, keys, weight))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_on), salts))
    right = summary.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
