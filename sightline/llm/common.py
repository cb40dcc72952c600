"""Helpers shared by the operators: words, settled tables, row numbers and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.lineage import scratch_path

# Characters that separate words: the space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read back; a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.settled_at = path
    for made in _collecting:
        made.append(found)
    return found


_collecting: list[list[DataFrame]] = []


@contextmanager
def collecting() -> Iterator[list[DataFrame]]:
    """Lists the tables settled meanwhile, for ``discard`` once what was made of them is written."""
    made: list[DataFrame] = []
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.remove(made)


def discard(*settled: DataFrame) -> None:
    """Removes settled tables that nothing reads any more; one that is gone already is passed over."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_hash(docs: DataFrame) -> Column:
    """128 bits that tell rows apart by all their columns; equal rows share them."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))


def attached(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(row, the columns of ``told``): for each row of ``told`` the row of ``docs`` with its ``row_hash``.

    ``told`` (row_hash, ...) has a row for each row of ``docs`` that is wanted, so equal rows come back
    as often as they are told.  Texts are shuffled once.
    """
    once = docs.select(row_hash(docs).alias("row_hash"), F.struct("*").alias("row")).dropDuplicates(["row_hash"])
    return once.join(told, "row_hash").drop("row_hash")


def words(text: Column | str) -> Column:
    """Array of the words of a text; empty for a null text or one without words."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column | str) -> Column:
    return F.size(words(F.col(text) if isinstance(text, str) else text)).cast("bigint")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def running(df: DataFrame, group: str, order: list[str], value: str, name: str,
            rows_per_part: int = 10_000, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the same ``group``.

    ``order`` starts with a bigint column spread evenly over 0 .. 2^60, which is cut into ranges; sums
    are made inside a range and moved up by those of the earlier ranges, so no group has to fit in one
    task.  ``df`` is read several times, so it should be settled.  Ties in all of ``order`` are broken
    arbitrarily.
    """
    from pyspark.sql import Window

    if parts is None:
        parts = max(1, -(-df.count() // rows_per_part))
    cut = (F.col(order[0]).cast("double") / float(2**60) * parts).cast("int")
    cut = F.greatest(F.lit(0), F.least(cut, F.lit(parts - 1)))
    df = df.withColumn("_range", cut)
    sums = df.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    # One row per group and range: as many as there are tasks.
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    sums = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), "_before")
    inside = (
        Window.partitionBy(group, "_range").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Dealt by range alone, every task gets as many rows, whatever share one group has.
    df = df.repartition("_range").withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = df[group].eqNullSafe(sums["_group"]) & (df["_range"] == sums["_r"])
    return (
        df.join(sums, match)
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_group", "_r", "_range", "_before", "_inside")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node of an edge.

    Alternating large and small stars (Kiveris et al. 2014): only per-node minima and joins on the
    node, so neither a long chain nor a node with very many links lands in one task.
    """
    spark = edges.sparkSession
    edges = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "edges",
    )
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*").where("a <> b").distinct()
        small = settle(small, "edges")
        discard(edges)
        # Done when every node hangs on exactly one root and no root hangs on anything.
        roots = small.select(F.col("b").alias("a")).distinct()
        many = small.groupBy("a").count().where("count > 1").select("a").limit(1)
        deep = small.join(roots, "a", "left_semi").select("a").limit(1)
        edges = small
        if many.union(deep).isEmpty():
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def seeded(seed: str, *columns: str) -> Column:
    """A number spread evenly over 0 .. 2^60, fixed by the seed and the columns' text."""
    parts = [F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("bigint")


def lookup_small(
    rows: DataFrame, small: DataFrame, key: str, bound: int, spread: str, how: str = "inner"
) -> DataFrame:
    """Null-safe join on ``key``, inner or left, to a settled table with one row per key.

    The table is broadcast only where its row count is within ``bound``; beyond it both sides are
    salted, so a key with any share of the rows is spread over 64 tasks or more.
    """
    known = small.withColumnRenamed(key, "_key")
    if known.count() <= bound:
        return rows.join(F.broadcast(known), rows[key].eqNullSafe(known["_key"]), how).drop("_key")
    salts = max(64, rows.sparkSession.sparkContext.defaultParallelism)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_s"])
    return left.join(right, match, how).drop("_key", "_salt", "_s")


def texts_of(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, text) of the bounded table ``labelled``: one row per id, however many rows repeat it."""
    ids = F.broadcast(labelled.select("doc_id").distinct())
    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
