"""From raw documents to shards: each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last keep the columns of
``documents``; the last adds the shard and the slot in it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from sightline.llm.common import collecting, discard, settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[DataFrame] = []


def stage(work: Stage) -> Stage:
    """A stage starts once the one before it is written, so it removes that one's scratch tables."""

    @wraps(work)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*_scratch)
        _scratch.clear()
        with collecting() as made:
            out = work(spark, docs, sf_dir)
        _scratch.extend(made)
        return out

    return begun


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not reject.

    Null and empty texts stay; repeated rows are judged alike; an empty table gives none.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar ones: that of the smallest id.

    Similar ones share 80 per cent of their five-word shingles; the numbers of op2 are its query's own.
    """
    return ngram_join.first_of_each(docs, words=5, per_cent=80)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts, and repeated rows, stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, to the nearest whole time.

    Null texts and texts without words are never taken; repeated rows are taken each.
    """
    return mixing.mixed(docs)


@stage
def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it; equal texts share a shard.

    A null text has no bytes, repeated rows are dealt each, an empty table gives none.  Where ``docs``
    has a column of that name already, the new one ends with an underscore more.
    """
    return sharding.sharded(docs).select("row.*", *[F.col(c).alias(_free(c, docs.columns)) for c in ("shard", "slot")])


def _free(name: str, taken: list[str]) -> str:
    # Spark's names do not tell upper from lower case.
    lowered = {c.lower() for c in taken}
    while name in lowered:
        name += "_"
    return name


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

# The fitted model of the first stage is beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = settle(work(spark, docs, sf_dir), name)
    return docs
