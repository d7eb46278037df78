"""The four jobs run over the sample tables until all input is read.

Tables arrive as a file stream, pass through the same JSON records as in
production, and end in the jobs' own sinks below the shared work folder; the
result is read back from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import logs
from millrace.operators.dims import user_dim
from millrace.plans import batch
from millrace.schemas import DAU_WIDE, ORDER_WIDE, TOPIC_PAGE
from millrace.session import STATE, settings, work_dir
from millrace.sinks.topics import TopicSink
from millrace.sources import samples
from millrace.sources.streams import TopicSource, read_table_stream, read_topic
from millrace.sources.tables import drop_newest, stored
from millrace.streaming import jobs
from millrace.streaming.jobs import Run
from millrace.streaming.orders import SALTS

ONCE = {"availableNow": True}


def _state(spark: SparkSession) -> dict[str, str]:
    """State settings of the jobs: the partition count is fixed at the first start of a query.

    A local session gets no more partitions than it has use for.
    """
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    useful = 2 * spark.sparkContext.defaultParallelism
    return {
        **STATE,
        "spark.sql.shuffle.partitions": str(min(wanted, useful)),
    }


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table_stream(spark, f"{sf_dir}/{name}.parquet")


def _page_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page topic as a stream, straight from the log split."""
    raw = samples.app_logs(_stream(spark, sf_dir, "events"), keep=("arrived",))
    routed = logs.route(logs.flatten(raw, keep=("arrived",)), keep=("arrived",))
    return routed.where(F.col("topic") == TOPIC_PAGE)


def _dims(sf_dir: str) -> jobs.Dims:
    return lambda spark: (batch.users(spark, sf_dir), batch.provinces(spark, sf_dir))


def stream_log_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 1, read back per topic."""
    work = work_dir(spark, "log-split")
    raw = samples.app_logs(_stream(spark, sf_dir, "events"))
    sink = TopicSink(path=f"{work}/topics")
    jobs.start_log_split(raw, sink, Run(f"{work}/checkpoint", ONCE)).awaitTermination()
    written = spark.read.parquet(f"{work}/topics")
    return written.groupBy("topic").agg(F.count(F.lit(1)).alias("n_rows"))


def stream_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 1, read back record by record: topic, device and time of each."""
    work = work_dir(spark, "log-records")
    sink = TopicSink(path=f"{work}/topics")
    jobs.start_log_split(samples.app_logs(_stream(spark, sf_dir, "events")), sink, Run(f"{work}/checkpoint", ONCE)).awaitTermination()
    record = F.from_json("value", "mid string, common struct<mid: string>, ts bigint")
    written = spark.read.parquet(sink.path).select("topic", record.alias("r"))
    return written.select("topic", F.coalesce("r.mid", "r.common.mid").alias("mid"), F.col("r.ts").alias("ts"))


def stream_change_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 2 over all four tables of the change feed: fact records by topic, and current dimension rows."""
    work = work_dir(spark, "change-feeds")
    no_seq = F.lit(None).cast("bigint").alias("seq")
    raw = (
        samples.order_changes(_stream(spark, sf_dir, "orders"), keep=("appended", no_seq))
        .unionByName(samples.line_changes(_stream(spark, sf_dir, "lineitem"), keep=("appended", no_seq)))
        .unionByName(samples.user_changes(_stream(spark, sf_dir, "customer"), keep=("appended",)))
        .unionByName(samples.province_changes(_stream(spark, sf_dir, "nation"), keep=("appended",)))
    )
    dims, sink = jobs.dim_table(f"{work}/dims"), TopicSink(path=f"{work}/topics")

    def tables(session: SparkSession) -> tuple[DataFrame, DataFrame]:
        return batch.fact_tables(session), batch.dim_tables(session)

    jobs.start_change_split(raw, sink, dims, tables, Run(f"{work}/checkpoint", ONCE)).awaitTermination()
    facts = spark.read.parquet(sink.path).select("topic", F.from_json("value", "id string, create_time string").alias("r"))
    users, provinces = jobs.dims_from(dims)(spark)
    none = F.lit(None).cast("string")
    return (
        facts.select("topic", F.col("r.id").alias("id"), F.col("r.create_time").alias("detail"))
        .unionByName(users.select(F.lit("USER_INFO").alias("topic"), "id", F.concat_ws("|", "gender", "birthday").alias("detail")))
        .unionByName(provinces.select(F.lit("BASE_PROVINCE").alias("topic"), "id", F.coalesce("name", none).alias("detail")))
    )


def stream_change_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 2 over order and customer changes: fact topics and current dimension rows, counted."""
    work = work_dir(spark, "change-split")
    no_seq = F.lit(None).cast("bigint").alias("seq")
    facts = samples.order_changes(_stream(spark, sf_dir, "orders"), keep=("appended", no_seq))
    users = samples.user_changes(_stream(spark, sf_dir, "customer"), keep=("appended",))
    raw = facts.unionByName(users)
    dims = jobs.dim_table(f"{work}/dims")
    sink = TopicSink(path=f"{work}/topics")

    def tables(session: SparkSession) -> tuple[DataFrame, DataFrame]:
        return batch.fact_tables(session), batch.dim_tables(session)

    jobs.start_change_split(raw, sink, dims, tables, Run(f"{work}/checkpoint", ONCE)).awaitTermination()
    written = spark.read.parquet(f"{work}/topics")
    facts_read = written.select(
        "topic", F.get_json_object("value", "$.id").alias("id"), F.lit(None).cast("string").alias("birthday")
    )
    dims_read = user_dim(dims.read(spark)).select(F.lit("USER_INFO").alias("topic"), "id", "birthday")
    return facts_read.unionByName(dims_read)


def _run_dau(spark: SparkSession, sf_dir: str, first: str) -> DataFrame:
    work = work_dir(spark, f"dau-{first}")
    table = jobs.dau_table(f"{work}/table")
    with settings(spark, _state(spark)):
        query = jobs.start_dau(
            _page_topic(spark, sf_dir),
            _dims(sf_dir),
            table,
            Run(f"{work}/checkpoint", ONCE),
            first=first,
            # A backfill reads files in any order, so no day may close early.
            delay="3650 days",
            as_of=samples.AS_OF,
        )
        query.awaitTermination()
    return table.read(spark)


def stream_dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 3, first to arrive: which row wins is open, so only what its device fixes is shown."""
    rows = _run_dau(spark, sf_dir, "arrival")
    return rows.select(
        "dt",
        "mid",
        "user_id",
        "channel",
        "brand",
        "user_gender",
        "user_age",
        "province_name",
        "province_area_code",
        "dim_miss",
    )


def stream_dau_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 3, earliest event: the whole record, equal to the batch result."""
    rows = _run_dau(spark, sf_dir, "event_time")
    return rows.select(*DAU_WIDE.fieldNames(), "dim_miss")


def stream_dau_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 3 over several micro-batches, with a lost checkpoint and a batch that is run twice: the batch result.

    The page topic is written in two halves, each in files for two batches.  The first run reads one half, a batch of files at a time.
    The second has no checkpoint, so it begins anew and reads both; then its last commit is lost, and its last batch runs again.
    """
    work = work_dir(spark, "dau-restart")
    table, topic = jobs.dau_table(f"{work}/table"), f"{work}/pages"
    pages = batch.routed_logs(spark, sf_dir).where(F.col("topic") == TOPIC_PAGE).select("topic", "key", "value")
    pages = stored(pages.withColumn("half", F.pmod(F.xxhash64("key"), F.lit(2))), "dau-restart-pages")
    # Every core has a file of each batch.
    files = max(2, spark.sparkContext.defaultParallelism)

    def publish(half: int) -> None:
        here = pages.where(F.col("half") == half).drop("half")
        here.repartition(2 * files).write.mode("append").parquet(topic)

    def run(checkpoint: str) -> None:
        source = TopicSource(TOPIC_PAGE, path=topic, max_per_trigger=files)
        query = jobs.start_dau(
            read_topic(spark, source), _dims(sf_dir), table, Run(checkpoint, ONCE), first="event_time", delay="3650 days", as_of=samples.AS_OF
        )
        query.awaitTermination()

    with settings(spark, _state(spark)):
        publish(0)
        run(f"{work}/first")
        publish(1)
        run(f"{work}/second")
        drop_newest(spark, f"{work}/second/commits")
        run(f"{work}/second")
    return table.read(spark).select(*DAU_WIDE.fieldNames(), "dim_miss")


def dau_day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of one day, read from the day's folder of a compacted table."""
    work = work_dir(spark, "dau-index")
    table = jobs.dau_table(f"{work}/table")
    table.upsert(batch.dau_wide(spark, sf_dir), 0)
    table.compact(spark)
    return table.read_field(spark, "2024-01-05", "mid")


def _run_order_wide(spark: SparkSession, sf_dir: str, cached: bool, salts: int) -> DataFrame:
    work = work_dir(spark, "order-wide")
    table = jobs.order_table(f"{work}/table")
    raw_headers = samples.order_headers_json(_stream(spark, sf_dir, "orders"), keep=("arrived",))
    raw_lines = samples.order_lines_json(_stream(spark, sf_dir, "lineitem"), keep=("arrived",))
    with settings(spark, _state(spark)):
        query = jobs.start_order_wide(
            raw_headers,
            raw_lines,
            _dims(sf_dir),
            table,
            Run(f"{work}/checkpoint", ONCE),
            cached=cached,
            salts=salts,
            as_of=samples.AS_OF,
        )
        if cached:
            jobs.drain(query, timeout=3600)
        else:
            query.awaitTermination()
    return table.read(spark).select(*ORDER_WIDE.fieldNames(), "dim_miss")


def stream_order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 4 on the built-in stream-stream join."""
    return _run_order_wide(spark, sf_dir, cached=False, salts=SALTS)


def stream_order_wide_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job 4 on the expiring cache."""
    return _run_order_wide(spark, sf_dir, cached=True, salts=2)
