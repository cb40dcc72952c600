"""Structured Streaming: land each poll, resolve what landed, keep the tables as logs.

Every table is a folder of ``batch=<n>`` partitions holding only what that
micro-batch changed, so no batch rewrites a table.  A retried batch reads the
state before it and overwrites its own partitions, which makes it idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline import schemas as S
from sightline.operators import keys, links
from sightline.operators import quality as Q
from sightline.plans import idindex
from sightline.plans.lineage import cut
from sightline.plans.skew import unsent
from sightline.sources import wire


def _read(spark: SparkSession, path: str, before: int | None) -> DataFrame | None:
    """The partitions written by earlier batches, or None when there is none."""
    if not idindex.exists(spark, path):
        return None
    table = spark.read.option("basePath", path).parquet(f"{path}/*")
    return table if before is None else table.where(F.col("batch") < before)


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_links(
    spark: SparkSession, root: str, before: int | None = None, only: DataFrame | None = None
) -> DataFrame | None:
    """The link table: the newest row of every version; ``only`` (observation_id) narrows the log first."""
    log = _read(spark, f"{root}/links", before)
    if log is None:
        return None
    if only is not None:
        log = log.join(unsent(only), "observation_id", "left_semi")
    row = F.struct(*[c for c in S.LINK_COLUMNS if c != "link_id"])
    newest = log.groupBy("link_id").agg(F.max_by(row, "batch").alias("_row"))
    return newest.select("link_id", "_row.*").select(*S.LINK_COLUMNS)


def read_interfaces(
    spark: SparkSession, root: str, before: int | None = None, only: DataFrame | None = None
) -> DataFrame | None:
    """The interface table: windows widen only, so the log merges by least and greatest.

    ``only`` (l2_domain, mac) narrows the log first.
    """
    log = _read(spark, f"{root}/interfaces", before)
    if log is None:
        return None
    if only is not None:
        log = log.join(unsent(only), ["l2_domain", "mac"], "left_semi")
    return log.groupBy("interface_id", "l2_domain", "mac").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def numbered(poll: DataFrame) -> DataFrame:
    """Lines of a poll with their place in its file; a file is never split over batches."""
    return wire.numbered(poll.withColumn("_in_split", F.monotonically_increasing_id()))


POLLS_PER_BATCH = 10_000  # units a micro-batch may number; more files wait for the next one
COLUMNS = ["obs_id", "connector_id", "observed_at", "l2_domain", "vantage", "facts", "raw"]


def _polls(batch: DataFrame, records: DataFrame) -> DataFrame:
    """(stream, poll, failed, runs_on): the polls of a micro-batch, numbered as they arrived.

    At most POLLS_PER_BATCH rows; a poll runs on when a record follows its failure.
    """
    arrived = batch.groupBy("stream").agg(F.min("_arrived").alias("_arrived"))
    place = F.row_number().over(Window.orderBy("_arrived", "stream"))
    ends = records.groupBy("stream").agg(
        F.max("seq").alias("last"), F.min(F.when(F.col("record") == "failure", F.col("seq"))).alias("end")
    )
    return cut(
        arrived.select("stream", place.cast("bigint").alias("poll"))
        .join(ends, "stream", "left")
        .select(
            "stream", "poll", F.col("end").isNotNull().alias("failed"),
            F.coalesce(F.col("last") > F.col("end"), F.lit(False)).alias("runs_on"),
        )
    )


def _judged(obs: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(obs_id, poll, clashes, lands, said) for each id of each poll, from what came before the poll.

    An id lands with the first poll that says one thing of it and does not fail.  It clashes where its
    poll says several things, or another than the one that landed or is stored.
    """
    said = obs.groupBy("obs_id", "poll", "failed").agg(
        F.min("said").alias("said"), (F.min("said") == F.max("said")).alias("one")
    )
    said = cut(said)
    known = F.lit(None).cast("string").alias("stored")
    if stored is None:
        said = said.select("*", known)
    else:
        told = stored.select(F.col("id").alias("obs_id"), F.col("said").alias("stored"))
        said = said.join(unsent(told), "obs_id", "left")
    may = F.col("one") & ~F.col("failed") & F.col("stored").isNull()
    first = said.where(may).groupBy("obs_id").agg(F.min(F.struct("poll", "said")).alias("first"))
    said = said.join(unsent(first), "obs_id", "left")
    before = F.coalesce("stored", F.when(F.col("poll") > F.col("first.poll"), F.col("first.said")))
    return said.select(
        "obs_id", "poll", "said",
        F.coalesce(~F.col("one") | (F.col("said") != before), F.lit(False)).alias("clashes"),
        F.coalesce(F.col("poll") == F.col("first.poll"), F.lit(False)).alias("lands"),
    )


def land(batch: DataFrame, batch_id: int, root: str) -> None:
    """The polls of a micro-batch, each a unit of its own, in order of arrival, in one plan for all.

    Bad rows are set aside, new sightings appended and resolved, and every poll is counted.  A poll
    with a failure record lands nothing, and neither does one that goes on after it.  A sighting whose
    id is stored or repeated with other content is set aside; one with the same content is counted as a
    repeat.  How files fall into micro-batches decides nothing: a poll is resolved alone, against what
    the polls before it left.
    """
    spark = batch.sparkSession
    lines = cut(numbered(batch))
    bad = cut(Q.line_shape(lines))
    records = cut(wire.parse_lines(lines.join(bad, ["stream", "seq"], "left_anti")))
    polls = F.broadcast(_polls(batch, records))
    obs = wire.observations_only(records).drop("line").join(polls, "stream")
    obs = cut(obs.select("stream", "poll", "failed", "seq", *COLUMNS, F.sha2(links.content(), 256).alias("said")))
    index = f"{root}/ids"
    stored = idindex.held(obs.select(F.col("obs_id").alias("id")), index, batch_id)
    judged = cut(_judged(obs, stored))

    clashing = cut(obs.join(judged.where("clashes").select("obs_id", "poll"), ["obs_id", "poll"], "left_semi").select(
        "stream", "seq", F.lit("contradiction").alias("rule"), F.col("obs_id").alias("line")
    ))
    aside = bad.join(lines, ["stream", "seq"]).select("stream", "seq", "rule", "line").unionByName(clashing)
    _write(aside, f"{root}/quarantine", batch_id)
    landing = judged.where("lands").select("obs_id", "poll")
    fresh = obs.join(unsent(landing), ["obs_id", "poll"]).dropDuplicates(["obs_id"]).select("stream", "poll", *COLUMNS)
    landed = cut(fresh)
    _write(landed.select(*COLUMNS), f"{root}/observations", batch_id)

    def per_poll(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("stream").agg(F.count("*").alias(name))

    state = F.when(F.col("runs_on"), "runs on after its failure").when(F.col("failed"), "failed").otherwise("landed")
    counts = polls.select("stream", state.alias("state"))
    parts = {"lines": lines, "sightings": obs, "ingested": landed, "contradicting": clashing, "malformed": bad}
    for name, rows in parts.items():
        counts = counts.join(per_poll(rows, name), "stream", "left")
    _write(
        counts.select(
            F.col("stream").alias("poll"), *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in parts], "state"
        ),
        f"{root}/counts", batch_id,
    )

    own = landed.select(F.col("obs_id").alias("observation_id"))
    met = keys.scoped_keys(landed).select("l2_domain", "mac").distinct()
    held = read_links(spark, root, batch_id, own)
    known = read_interfaces(spark, root, batch_id, met)
    held = links.empty_links(landed) if held is None else held
    known = links.empty_interfaces(landed) if known is None else known
    done = links.resolve_polls(landed, known, held)
    # A version is named after its poll, so micro-batches do not show in the ids either.
    _write(done.interfaces.select(*S.INTERFACE_COLUMNS), f"{root}/interfaces", batch_id)
    _write(links.changed_links(held, done.actions, F.col("stream")), f"{root}/links", batch_id)
    _write(done.late, f"{root}/late", batch_id)
    _write(done.refused, f"{root}/refused", batch_id)
    _write(done.summary, f"{root}/summary", batch_id)
    # The index tells that the batch is whole, so it comes last.
    idindex.append(judged.where("lands").select(F.col("obs_id").alias("id"), "said"), index, batch_id)


def ingest(spark: SparkSession, source: str, root: str, files_per_batch: int = 16) -> StreamingQuery:
    """Run over the polls (JSON Lines files) that are there, then stop; run again for new ones.

    ``files_per_batch`` is a matter of cost only.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", min(files_per_batch, POLLS_PER_BATCH))
        .text(source)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("stream"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.col("_metadata.file_modification_time").alias("_arrived"),
        )
    )
    return (
        lines.writeStream.foreachBatch(lambda df, n: land(df, n, root))
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def poll_summary(records: DataFrame, initial: list[str] | None = None) -> DataFrame:
    """Per poll that did not fail: kinds in force at its end and scopes covered.

    ``records`` is (poll, seq, record, l2_domain, vantage, kinds).
    """
    start = F.array(*map(F.lit, S.FACT_KINDS if initial is None else initial))
    told = F.when(F.col("kinds").isNotNull(), F.struct("seq", "kinds"))
    ends = records.groupBy("poll").agg(
        F.max(told).alias("told"), F.bool_or(F.col("record") == "failure").alias("failed")
    )
    scopes = (
        records.where("record = 'observation'")
        .select("poll", "l2_domain", "vantage")
        .distinct()
        .groupBy("poll")
        .agg(F.count("*").alias("scopes"))
    )
    return (
        ends.where("not failed")
        .join(scopes, "poll", "left")
        .select(
            "poll",
            F.coalesce("told.kinds", start).alias("kinds"),
            F.coalesce("scopes", F.lit(0)).cast("bigint").alias("scopes"),
        )
    )


def stream_poll_summary(records: DataFrame, root: str) -> StreamingQuery:
    """Logs what each micro-batch tells of its polls; a poll may span any number of them."""
    told = ["poll", "seq", "record", "l2_domain", "vantage", "kinds"]

    def log(batch: DataFrame, n: int) -> None:
        kept = batch.select(*told).groupBy("poll", "record", "l2_domain", "vantage").agg(
            F.max(F.when(F.col("kinds").isNotNull(), F.struct("seq", "kinds"))).alias("told"),
            F.max("seq").alias("last"),
        )
        rows = kept.select(
            "poll", F.coalesce("told.seq", "last").alias("seq"), "record", "l2_domain", "vantage",
            "told.kinds",
        )
        _write(rows, f"{root}/polls", n)

    return (
        records.writeStream.foreachBatch(log)
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def summarised_polls(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of the polls logged so far, whatever batches their records came in."""
    return poll_summary(spark.read.parquet(f"{root}/polls").drop("batch"))


def stream_deduplicated(obs: DataFrame, root: str) -> StreamingQuery:
    """One row per sighting id, however far apart its repeats arrive; ``refused`` counts the repeats.

    A batch looks its ids up in the index of stored ids, whatever day they are dated.  Of several rows
    of an id in one batch the earliest is kept.
    """

    def keep(batch: DataFrame, n: int) -> None:
        row = F.min(F.struct("observed_at", *[c for c in batch.columns if c not in ("obs_id", "observed_at")]))
        once = batch.groupBy("obs_id").agg(row.alias("row"), F.count("*").alias("arrived"))
        once = cut(once.select("obs_id", "row.*", "arrived"))
        held = idindex.held(once.select(F.col("obs_id").alias("id")), f"{root}/ids", n)
        fresh = once.drop("arrived")
        if held is not None:
            fresh = fresh.join(unsent(held.select(F.col("id").alias("obs_id"))), "obs_id", "left_anti")
        fresh = cut(fresh)
        _write(fresh, f"{root}/once", n)
        counts = once.agg(F.coalesce(F.sum("arrived"), F.lit(0)).alias("arrived")).select(
            "arrived", (F.col("arrived") - fresh.agg(F.count("*")).scalar()).alias("refused")
        )
        _write(counts, f"{root}/refused", n)
        idindex.append(fresh.select(F.col("obs_id").alias("id")), f"{root}/ids", n)

    return (
        obs.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def stream_seen_window(obs: DataFrame, root: str) -> StreamingQuery:
    """First and last sighting of each key, kept by the streaming engine's state store."""
    rows = obs.select("l2_domain", F.explode(keys.macs()).alias("mac"), "observed_at")
    windows = rows.groupBy("l2_domain", "mac").agg(
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
        F.count("*").alias("members"),
    )
    return (
        windows.writeStream.outputMode("update")
        .foreachBatch(lambda df, n: _write(df, f"{root}/windows", n))
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def newest_windows(spark: SparkSession, root: str) -> DataFrame:
    """The last update of every key."""
    log = spark.read.parquet(f"{root}/windows")
    row = F.struct("batch", "first_seen_at", "last_seen_at", "members")
    return (
        log.groupBy("l2_domain", "mac")
        .agg(F.max(row).alias("r"))
        .select("l2_domain", "mac", "r.first_seen_at", "r.last_seen_at", "r.members")
    )


def stream_widened(obs: DataFrame, root: str) -> StreamingQuery:
    """Seen windows without state or watermark: each batch logs its own, late ones included."""
    return (
        obs.writeStream.foreachBatch(
            lambda df, n: _write(keys.seen_window(keys.scoped_keys(df)), f"{root}/windows", n)
        )
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def merged_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows merged over all batches: they widen both ways whatever order data came in."""
    return spark.read.parquet(f"{root}/windows").groupBy("l2_domain", "mac").agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("members").alias("members"),
    )
