"""Streaming queries: each writes its input once, streams over it, and reads the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.linking import ids, placed_sql
from sightline.catalog.registry import is_address, query
from sightline.functions.facts import macs
from sightline.plans.lineage import scratch_path
from sightline.sources import tables, wire
from sightline.streaming import ingest as I
from sightline.streaming import presence as P


ROWS_PER_FILE = 5_000  # at least
PER_BATCH = 4  # files, at least
BATCHES = 8  # about; a micro-batch grows with what there is to replay, their number does not


def _replayed(df: DataFrame) -> DataFrame:
    """The rows as a file stream, several micro-batches of them."""
    spark = df.sparkSession
    path = scratch_path(spark, "stream")
    rows = max(ROWS_PER_FILE, -(-df.count() // (BATCHES * PER_BATCH)))
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())  # names; few, however many rows
    return (
        spark.readStream.schema(df.schema)
        .option("maxFilesPerTrigger", max(PER_BATCH, -(-files // BATCHES)))
        .parquet(path)
    )


# A poll per source, day and fate; the fate goes by the sighting's number.
FATE = "case obs_id % 16 when 14 then 'fails' when 15 then 'runs-on' else 'lands' end"
_POLLS = (
    f"""polls as (select *, connector_id || '/' || strftime(observed_at, '%Y-%m-%d') || '/' || {FATE} as poll
       from obs)""",
    f"landed as (select * from polls where obs_id % 16 < 14 and {is_address('ipv4')})",
    "keys_in_polls as (select k.*, o.poll from keys k join landed o using (obs_id))",
    placed_sql("desired_in_polls", "keys_in_polls", "landed", "and a.poll = b.poll"),
)


def _polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poll, obs_id, …): every sighting with the poll it comes in, its id as text."""
    day = F.date_format("observed_at", "yyyy-MM-dd")
    return tables.sightings(spark, sf_dir).select(
        F.concat_ws("_", "connector_id", day, F.expr(FATE)).alias("poll"),
        F.expr(FATE).alias("fate"), "*",
    ).withColumn("obs_id", F.lpad(F.col("obs_id").cast("string"), 19, "0"))


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Lands every sighting as a line of its poll, some of which fail or go on after failing."""
    source, root = scratch_path(spark, "polls"), scratch_path(spark, "store")
    obs = _polled(spark, sf_dir)
    lines = obs.select("poll", F.col("obs_id").alias("at"), wire.observation_json().alias("value"))
    failure = F.lit('{"record":"failure","error":"Timeout"}')
    ends = obs.where("fate <> 'lands'").select(
        "poll", F.when(F.col("fate") == "fails", "9").otherwise("0").alias("at"), failure.alias("value")
    ).distinct()
    # A poll is one file: many polls, each written by one task in order.
    dealt = lines.unionByName(ends).repartition("poll").sortWithinPartitions("poll", "at")
    dealt.select("poll", "value").write.partitionBy("poll").text(source)
    I.ingest(spark, f"{source}/*", root, POLLS_AT_ONCE).awaitTermination()
    return root


POLLS_AT_ONCE = 1_000


@query(
    "stream_ingest_resolve",
    "select observation_id, subject, outcome, rule_id, evidence, valid_from from desired_in_polls",
    *_POLLS,
)
def stream_ingest_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting as a line of a poll of its source and day; some polls fail, some go on after failing."""
    root = _ingested(spark, sf_dir)
    number = F.transform("evidence", lambda e: e.cast("bigint"))
    return I.read_links(spark, root).select(
        F.col("observation_id").cast("bigint").alias("observation_id"),
        F.col("current_subject").alias("subject"),
        "outcome",
        "rule_id",
        ids(number).alias("evidence"),
        "valid_from",
    )


@query(
    "stream_poll_summary",
    """select p.stream || '/' || strftime(p.day, '%Y-%m-%d') as poll,
         case coalesce(p.kinds, 'all') when 'all' then 7 else 3 end as n_kinds, p.scopes
       from (select f.stream, cast(o.observed_at as date) as day, bool_or(record = 'failure') as failed,
               arg_max(f.kinds, f.seq) filter (f.kinds is not null) as kinds,
               count(distinct f.l2_domain * 10 + f.vantage) as scopes
             from feed f join obs o on o.obs_id = f.seq group by 1, 2) p where not p.failed""",
)
def stream_poll_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll per source and day; its records come in several micro-batches."""
    root = scratch_path(spark, "store")
    days = tables.read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    records = (
        tables.feed(spark, sf_dir)
        .join(days, "seq")
        .select(
            F.concat_ws("/", "stream", "day").alias("poll"), "seq", "record", "l2_domain", "vantage",
            "kinds",
        )
    )
    I.stream_poll_summary(_replayed(records), root).awaitTermination()
    return I.summarised_polls(spark, root).select("poll", F.size("kinds").alias("n_kinds"), "scopes")


@query("stream_dedup", "select obs_id, connector_id, observed_at from obs")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting arrives three times, in any order."""
    root = scratch_path(spark, "store")
    obs = tables.sightings(spark, sf_dir).select("obs_id", "connector_id", "observed_at")
    thrice = obs.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("_copy")
    I.stream_deduplicated(_replayed(thrice), root).awaitTermination()
    return spark.read.parquet(f"{root}/once").drop("batch")


@query(
    "stream_dedup_days",
    """select connector_id, count(*) as kept, min(observed_at) as first_seen_at,
         (select count(*) from obs) as refused from obs group by 1""",
)
def stream_dedup_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting arrives again dated three days later, in another batch; the repeats are refused."""
    source, root = scratch_path(spark, "stream"), scratch_path(spark, "store")
    obs = tables.sightings(spark, sf_dir).select("obs_id", "connector_id", "observed_at")
    later = obs.withColumn("observed_at", F.col("observed_at") + F.expr("interval 3 days"))
    for rows in (obs, later):
        rows.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(rows.schema).parquet(source)
        I.stream_deduplicated(arriving, root).awaitTermination()
    refused = spark.read.parquet(f"{root}/refused").agg(F.sum("refused")).scalar()
    return spark.read.parquet(f"{root}/once").groupBy("connector_id").agg(
        F.count("*").alias("kept"), F.min("observed_at").alias("first_seen_at"), F.first(refused).alias("refused")
    )


_WINDOWS = """select l2_domain, mac, min(observed_at) as first_seen_at, max(observed_at) as last_seen_at,
  count(*) as members from keys group by 1, 2"""


@query("stream_seen_window", _WINDOWS)
def stream_seen_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "store")
    obs = tables.sightings(spark, sf_dir).select("l2_domain", "facts", "observed_at")
    I.stream_seen_window(_replayed(obs), root).awaitTermination()
    return I.newest_windows(spark, root)


@query("stream_late", _WINDOWS)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings arrive in no order of time, over several batches, and none is dropped."""
    root = scratch_path(spark, "store")
    obs = tables.sightings(spark, sf_dir).select("obs_id", "l2_domain", "facts", "observed_at")
    I.stream_widened(_replayed(obs), root).awaitTermination()
    return I.merged_windows(spark, root)


PRESENT_ON, SLICES = "2024-01-20", 6


@query(
    "stream_presence",
    f"""select s.stream, s.l2_domain, s.mac, s.day, count(p.day) as missed,
         case when count(p.day) >= 3 then 'gone' when count(p.day) > 0 then 'stale' else 'present' end
           as state
       from (select connector_id as stream, k.l2_domain, k.mac, max(cast(k.observed_at as date)) as day
             from keys k join obs o using (obs_id)
             where cast(k.observed_at as date) <= date '{PRESENT_ON}' group by 1, 2, 3) s
       left join (select connector_id as stream, cast(observed_at as date) as day,
               not bool_or(user_id % 150 = 0) as live
             from obs join events on event_id = obs_id group by 1, 2) p
         on p.stream = s.stream and p.live and p.day > s.day
           and p.day > date '{PRESENT_ON}' - 7 and p.day <= date '{PRESENT_ON}'
       group by 1, 2, 3, 4""",
)
def stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys per source as of 20 January, from the state that the month's polls leave behind."""
    source, root = scratch_path(spark, "stream"), scratch_path(spark, "store")
    obs = tables.sightings(spark, sf_dir)
    sighted = obs.select(
        F.col("connector_id").alias("stream"), F.col("observed_at").alias("at"), F.lit(True).alias("live"),
        F.col("l2_domain").cast("string").alias("l2_domain"), F.explode(macs()).alias("mac"),
    )
    polls = tables.read_table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("stream"), F.col("ts").cast("date").alias("day")
    ).agg(F.max("ts").alias("at"), (~F.bool_or(F.col("user_id") % 150 == 0)).alias("live"))
    rows = sighted.unionByName(polls.drop("day"), allowMissingColumns=True)
    # Slices of five days arrive one after another; inside a slice, rows come in any order.
    for part in range(SLICES):
        own = F.least(F.floor((F.dayofmonth("at") - 1) / 5), F.lit(SLICES - 1)) == part
        rows.where(own).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", PER_BATCH).parquet(source)
    P.stream_presence(arriving, root, 7, "5 days", SHARDS).awaitTermination()
    return P.presence_as_of(spark, root, PRESENT_ON, 3).withColumn(
        "l2_domain", F.col("l2_domain").cast("int")
    )


SHARDS = 4  # of each source's keys
