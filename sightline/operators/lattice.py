"""Outcomes of pairs under every set of capabilities, as bitmaps.

A set of fact kinds that sources can report is a mask with a bit per kind, in the order of the closed
list; the masks under which something holds are a bitmap of 128 bits, kept as two longs.  Each verdict
carries the masks it holds under, so one pass over the pairs gives all outcomes, and lost capabilities
are followed along the edges of the lattice by shifts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import schemas as S
from sightline.operators import devices as D
from sightline.operators import verdicts as V

WORD = 64
SAID = {"dq": S.DISQUALIFYING, "dc": S.DECISIVE, "op": S.OPPOSES}


def mask_of(kinds: list[str]) -> int:
    return sum(1 << S.FACT_KINDS.index(k) for k in kinds)


def masks_with(needs: list[str], lacks: list[str] | None = None) -> list[Column]:
    """The masks that hold all of ``needs`` and none of ``lacks``, as two literal words."""
    want, shun = mask_of(needs), mask_of(lacks or [])
    words = [0, 0]
    for m in range(1 << len(S.FACT_KINDS)):
        if m & want == want and not m & shun:
            words[m // WORD] |= 1 << m % WORD
    return [F.lit(w - (1 << WORD) if w >> WORD - 1 else w).cast("bigint") for w in words]


def under(verdicts: DataFrame, needs: list[str], lacks: list[str] | None = None) -> DataFrame:
    """(low, high, verdict, w0, w1): verdicts that hold under the masks named."""
    w0, w1 = masks_with(needs, lacks)
    return verdicts.select("low", "high", "verdict", w0.alias("w0"), w1.alias("w1"))


def interface_verdicts(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Scoped keys decide and names support or oppose, each where its kind is reported."""
    keyed = V.l1_verdicts(V.pair_sides(pairs, obs))
    return under(keyed, ["Mac"]).unionByName(under(D.hostname_verdicts(pairs, obs), ["Hostname"]))


def device_verdicts(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """The device rules; a port that names leave undecided decides where no names are reported."""
    named = D.hostname_verdicts(pairs, obs, S.DECISIVE, S.DISQUALIFYING)
    plugged = D.uplink_verdicts(pairs, obs)
    nameless = plugged.where(F.col("verdict") == S.NEUTRAL).withColumn("verdict", F.lit(S.DECISIVE))
    parts = [
        under(named, ["Hostname"]),
        under(plugged.where(F.col("verdict") != S.NEUTRAL), ["Uplink"]),
        under(nameless, ["Uplink"], ["Hostname"]),
        under(D.virtual_verdicts(pairs, obs), ["Mac"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def outcomes(verdicts: DataFrame) -> DataFrame:
    """(low, high, match0, match1, no_match0, no_match1): the masks of each outcome.

    All other masks abstain; a pair that no rule speaks about abstains under every mask and has no row.
    """
    held = {
        f"{name}{w}": F.coalesce(
            F.bit_or(F.when(F.col("verdict") == verdict, F.col(f"w{w}"))), F.lit(0).cast("bigint")
        )
        for name, verdict in SAID.items()
        for w in (0, 1)
    }
    summed = verdicts.groupBy(*V.PAIR).agg(*[c.alias(n) for n, c in held.items()])

    def clear(w: int) -> Column:
        against = F.col(f"dq{w}").bitwiseOR(F.col(f"op{w}"))
        return F.col(f"dc{w}").bitwiseAND(F.bitwise_not(against))

    return summed.select(
        *V.PAIR,
        *[clear(w).alias(f"match{w}") for w in (0, 1)],
        *[F.col(f"dq{w}").alias(f"no_match{w}") for w in (0, 1)],
    )


def _ones(words: list[Column]) -> Column:
    return sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("bigint")


def sets_per_outcome(found: DataFrame) -> DataFrame:
    """(low, high, match_sets, no_match_sets): under how many masks a pair has either outcome."""
    return found.select(
        *V.PAIR,
        *[_ones([F.col(f"{o}0"), F.col(f"{o}1")]).alias(f"{o}_sets") for o in (S.MATCH, S.NO_MATCH)],
    )


def _without(name: str, kind: int) -> list[Column]:
    """For each mask with the kind: whether the outcome holds once the kind is lost."""
    low, high = F.col(f"{name}0"), F.col(f"{name}1")
    step = 1 << kind
    if step == WORD:
        return [F.lit(0).cast("bigint"), low]
    return [F.shiftleft(low, step), F.shiftleft(high, step)]


def violations(found: DataFrame) -> DataFrame:
    """(low, high, lost, edges): kinds whose loss made a pair more certain or turned it over.

    ``edges`` counts the masks with the kind for which that is so, out of 64.
    """
    lost = []
    for i, kind in enumerate(S.FACT_KINDS):
        holding = masks_with([kind])
        words = []
        for w in (0, 1):
            gained = [
                _without(o, i)[w].bitwiseAND(F.bitwise_not(F.col(f"{o}{w}")))
                for o in (S.MATCH, S.NO_MATCH)
            ]
            words.append(gained[0].bitwiseOR(gained[1]).bitwiseAND(holding[w]))
        lost.append(F.struct(F.lit(kind).alias("lost"), _ones(words).alias("edges")))
    return (
        found.select(*V.PAIR, F.explode(F.array(*lost)).alias("v"))
        .select(*V.PAIR, "v.lost", "v.edges")
        .where("edges > 0")
    )
