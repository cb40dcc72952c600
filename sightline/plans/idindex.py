"""Which ids are stored already, told without reading all that is stored.

Every batch of ids is a generation of its own.  Its ids are dealt by hash into blocks of about
``BLOCK_IDS``, each with a Bloom filter of ``BITS`` bits, and into files of ``BLOCKS_PER_FILE``
blocks.  To look ids up, their bits are tested against the filters of their blocks, and only files
with a block that may hold one of them are read; what a filter takes for stored by mistake falls out
when the ids themselves are met.  Filters are built and tested by built-in functions.

A generation counts once its line in ``meta`` is written, which comes last, so a batch that was lost
half way is written again over its own files.  Generations are merged by ``compact``, which keeps their
number, and with it the filters an id meets, small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.lineage import cut
from sightline.plans.skew import unsent

BLOCK_IDS = 3_000
BITS = 1 << 15  # of a block's filter, as many as a bitmap of the built-in functions has
PROBES = 6  # bits an id sets; with these numbers one in seventy is taken for stored by mistake
BLOCKS_PER_FILE = 64
GENERATIONS = 16  # more are merged on the next append
META = "batch bigint, blocks bigint, ids bigint, replaces array<bigint>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in any file system."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def generations(spark: SparkSession, root: str, before: int | None = None) -> list[tuple[int, int]]:
    """(batch, blocks) of every generation in force, one per batch or merged batches; no blocks without ids."""
    if not exists(spark, f"{root}/meta"):
        return []
    told = spark.read.schema(META).parquet(f"{root}/meta/*")
    if before is not None:
        told = told.where(F.col("batch") < before)
    rows = told.collect()  # one small row per generation
    gone = {b for r in rows for b in r["replaces"]}
    return sorted((r["batch"], r["blocks"] if r["ids"] else 0) for r in rows if r["batch"] not in gone)


def _hash(seed: int) -> Column:
    return F.xxhash64(F.col("id"), F.lit(seed))


def _bit(i: int) -> Column:
    """The place of an id's i-th bit in the filter of its block."""
    step = F.pmod(_hash(3), F.lit(BITS // 2)) * 2 + 1
    return F.pmod(F.pmod(_hash(2), F.lit(BITS)) + i * step, F.lit(BITS))


def append(ids: DataFrame, root: str, batch: int) -> None:
    """Stores the rows of ``ids`` (id, more columns) as the generation ``batch``, over a lost one of that number.

    No id may be stored already or stand there twice; ``held`` tells.
    """
    spark = ids.sparkSession
    ids = cut(ids)
    _write(ids, root, batch, ids.count(), [])
    # The newest batch may still be written again, so it is never merged.
    earlier = [b for b, blocks in generations(spark, root, batch) if blocks]
    if len(earlier) > GENERATIONS:
        compact(spark, root, earlier)


def _write(ids: DataFrame, root: str, batch: int, n: int, replaces: list[int]) -> None:
    spark = ids.sparkSession
    blocks = max(1, -(-n // BLOCK_IDS))
    block = F.pmod(_hash(1), F.lit(blocks))
    file = F.floor(F.col("block") / BLOCKS_PER_FILE).cast("bigint")
    dealt = ids.withColumn("block", block).withColumn("file", file)
    # A file is one task's: its rows stay together, whatever the number of tasks.
    dealt.repartition("file").drop("block").write.mode("overwrite").partitionBy("file").parquet(f"{root}/ids/batch={batch}")
    bits = dealt.select("block", "file", F.explode(F.array(*[_bit(i) for i in range(PROBES)])).alias("bit"))
    filters = bits.groupBy("block", "file").agg(F.bitmap_construct_agg("bit").alias("filter"))
    filters.write.mode("overwrite").parquet(f"{root}/filters/batch={batch}")
    told = spark.range(1).select(
        F.lit(batch).cast("bigint").alias("batch"), F.lit(blocks).cast("bigint").alias("blocks"),
        F.lit(n).cast("bigint").alias("ids"), F.lit(replaces).cast("array<bigint>").alias("replaces"),
    )
    told.coalesce(1).write.mode("overwrite").parquet(f"{root}/meta/{batch}")


def _set(filter_: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(filter_, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def files(ids: DataFrame, root: str, living: list[tuple[int, int]]) -> DataFrame:
    """(batch, file) of the files whose filters may hold one of ``ids``."""
    spark = ids.sparkSession
    kept = F.array(*[F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(n).cast("bigint").alias("n")) for b, n in living])
    probes = ids.select("id", F.explode(kept).alias("g")).select(
        "id", F.col("g.b").alias("batch"), F.pmod(_hash(1), F.col("g.n")).alias("block")
    )
    filters = spark.read.option("basePath", f"{root}/filters").parquet(
        *[f"{root}/filters/batch={b}" for b, _ in living]
    ).withColumn("batch", F.col("batch").cast("bigint"))
    # A filter meets at most the ids of its block that are asked for.
    met = unsent(probes).join(filters, ["batch", "block"])
    bits = F.array(*[_bit(i) for i in range(PROBES)])
    return met.where(F.forall(bits, lambda b: _set(F.col("filter"), b))).select("batch", "file").distinct()


def held(ids: DataFrame, root: str, before: int | None = None) -> DataFrame | None:
    """The stored rows of ``ids`` (id), from the files that may hold them; None where nothing is stored.

    With ``before`` only generations of smaller numbers count.
    """
    spark = ids.sparkSession
    living = [g for g in generations(spark, root, before) if g[1]]
    if not living:
        return None
    ids = cut(ids.select("id").distinct())
    # The names of the files to read, not their rows.
    asked = [f"{root}/ids/batch={r['batch']}/file={r['file']}" for r in files(ids, root, living).collect()]
    if not asked:
        stored = spark.read.option("basePath", f"{root}/ids").parquet(f"{root}/ids/batch={living[-1][0]}").where("false")
    else:
        stored = spark.read.option("basePath", f"{root}/ids").parquet(*asked)
    return stored.drop("batch", "file").join(unsent(ids), "id", "left_semi")


def compact(spark: SparkSession, root: str, batches: list[int]) -> None:
    """Merges generations into one, which stands in for them from the moment its line is written."""
    stored = spark.read.option("basePath", f"{root}/ids").parquet(*[f"{root}/ids/batch={b}" for b in batches])
    merged = stored.drop("batch", "file")
    # Negative numbers keep merged generations apart from those of batches; they are before all of them.
    _write(merged, root, min(-1, *[b - 1 for b in batches]), merged.count(), batches)
