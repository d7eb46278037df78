"""The four streaming jobs.

Each builds one query from pure operators.  Dimensions and table lists are read
anew for every micro-batch, inside ``foreachBatch``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.json import bind
from millrace.operators import cdc, dau, logs, orders
from millrace.operators.dims import province_dim, used_rows, user_dim
from millrace.schemas import DAU_WIDE, ORDER_DETAIL, ORDER_INFO, ORDER_WIDE, PAGE_LOG, record
from millrace.session import adaptive
from millrace.sinks.topics import TopicSink, batch_to_topics, stream_to_topics
from millrace.sinks.upserts import KeyedTable, run_version
from millrace.sources.streams import read_clock
from millrace.sources.tables import exists
from millrace.streaming import dau as dau_state
from millrace.streaming import orders as order_state

#: ST-1: the clock of all jobs; ``{"availableNow": True}`` for backfills.
EVERY_5_SECONDS = {"processingTime": "5 seconds"}

#: Reads the current ``(users, provinces)``.
Dims = Callable[[SparkSession], tuple[DataFrame, DataFrame]]
#: Reads the current ``(fact, dimension)`` table lists.
TableLists = Callable[[SparkSession], tuple[DataFrame, DataFrame]]

_MISS = T.StructField("dim_miss", T.BooleanType())
_SEED = record("mid string, ts bigint, dt string")


@dataclass(frozen=True)
class Run:
    """What every job needs besides its data: checkpoint, clock, name."""

    checkpoint: str
    trigger: dict | None = None
    name: str | None = None
    #: Batches between compactions of the job's table; 0 leaves them to the operator.
    compact_every: int = 200

    def start(self, writer) -> StreamingQuery:
        """ST-3, ST-8..12: offsets, state and progress live in the checkpoint."""
        writer = writer.option("checkpointLocation", self.checkpoint)
        if self.name:
            writer = writer.queryName(self.name)
        return writer.trigger(**(self.trigger or EVERY_5_SECONDS)).start()

    def store(self, table: KeyedTable, rows: DataFrame, generation: int, batch_id: int, pieces: int | None = None) -> None:
        """ST-11: upsert a batch; writing the same batch again replaces it."""
        table.upsert(rows, run_version(generation, batch_id), pieces)
        # Batches without output leave no version, so versions are counted, not batches.
        if self.compact_every and table.versions_since_base(rows.sparkSession) >= self.compact_every:
            table.compact(rows.sparkSession)


def _upsert_batches(
    rows: DataFrame,
    enrich: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
    read_dims: Dims,
    table: KeyedTable,
    run: Run,
    generation: int,
    mode: str,
) -> StreamingQuery:
    """ST-7, SNK-7: look up live dimensions for every batch and upsert the result."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with adaptive(batch.sparkSession) as session:
            # Held, as both its keys and its rows are used; its size is then known.
            batch.persist()
            try:
                if batch.count() == 0:
                    return
                users, provinces = read_dims(session)
                wide = enrich(batch, used_rows(users, batch, "user_id"), provinces)
                pieces = table.pieces(batch) if table.seq else None
                run.store(table, wide, generation, batch_id, pieces)
            finally:
                batch.unpersist()

    return run.start(rows.writeStream.outputMode(mode).foreachBatch(write))


def dau_table(path: str) -> KeyedTable:
    """SNK-8: daily-active rows, one per device and day."""
    return KeyedTable(path, T.StructType([*DAU_WIDE.fields, _MISS]), keys=("mid",), day="dt")


def order_table(path: str) -> KeyedTable:
    """SNK-9: order-wide rows, one per line, filed under the order's date."""
    schema = T.StructType([*ORDER_WIDE.fields, _MISS])
    return KeyedTable(path, schema, keys=("detail_id",), day="create_date", seq="joined_at")


def dim_table(path: str) -> KeyedTable:
    """SNK-6: current dimension rows, one per table and id; nothing expires."""
    schema = record("dim string, id string, data string")
    return KeyedTable(path, schema, keys=("id",), day="dim", seq="seq")


def dims_from(table: KeyedTable) -> Dims:
    """Reader of the user and province dimensions kept by the change-split job."""
    def read(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        current = table.read(spark)
        return user_dim(current), province_dim(current)

    return read


def start_log_split(raw: DataFrame, sink: TopicSink, run: Run) -> StreamingQuery:
    """Job 1: app logs to page, display, action, start, error and reject topics."""
    routed = logs.route(logs.flatten(raw))
    counted = routed.observe("routed", F.count(F.lit(1)).alias("n_rows"))
    return run.start(stream_to_topics(counted, sink))


def start_change_split(
    raw: DataFrame,
    sink: TopicSink,
    dims: KeyedTable,
    tables: TableLists,
    run: Run,
    *,
    rejects: TopicSink | None = None,
) -> StreamingQuery:
    """Job 2: change records to fact topics and to the dimension table (RTE-2, ST-7).

    ``raw`` needs ``appended`` and ``seq`` (null where the source has no offsets).  Unusable records go to the
    topic ``ODS_DB_REJECT`` of ``rejects``: unless given, the same broker, or a folder beside that of ``sink``.
    """
    rejects = rejects or (TopicSink(path=f"{sink.path}-rejects") if sink.path else sink)
    generation = dims.next_run(raw.sparkSession, run.checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        with adaptive(batch.sparkSession) as spark:
            fact_names, dim_names = tables(spark)
            position = F.coalesce("seq", F.monotonically_increasing_id())
            ordered = batch.withColumn("seq", F.struct(F.col("appended").alias("arrived"), position))
            # All outputs come from one read and one parse of the batch.
            records = cdc.judged(ordered, keep=("seq",)).persist()
            try:
                changed = cdc.wanted(records)
                version = run_version(generation, batch_id)
                batch_to_topics(cdc.reject_records(records), rejects, version)
                batch_to_topics(cdc.fact_records(changed, fact_names), sink, version)
                run.store(dims, cdc.dim_changes(changed, dim_names, keep=("seq",)), generation, batch_id)
            finally:
                records.unpersist()

    return run.start(raw.writeStream.foreachBatch(write))


def start_dau(
    raw: DataFrame,
    read_dims: Dims,
    table: KeyedTable,
    run: Run,
    *,
    first: str = "arrival",
    tiebreak: tuple[str, ...] = ("page_id", "page_item", "during_time"),
    delay: str = dau_state.DELAY,
    salts: int = dau_state.SALTS,
    as_of: str | date | None = None,
    on_miss: str = "null",
    ahead: str = dau_state.AHEAD,
    bound: bool = False,
) -> StreamingQuery:
    """Job 3: page-log topic to the daily-active table.

    ``first="arrival"`` emits each device once per day, whichever row came first;
    ``first="event_time"`` converges on the earliest row for any arrival order.
    Rows dated more than ``ahead`` after their arrival are left out and counted (``implausible``): one of them
    would close all real days.  ``bound``: ``raw`` comes from an ingest log, which keeps such rows as rejects.
    """
    spark = raw.sparkSession
    generation = table.next_run(spark, run.checkpoint)
    clock = () if "arrived" not in raw.columns else ("arrived",)
    records = raw if bound else bind(raw, PAGE_LOG, keep=clock)
    pages = dau.session_starts(records)
    no_device = F.count_if(F.col("mid").isNull()).alias("no_device")
    plausible = dau_state.plausible(ahead, F.col("arrived") if clock else read_clock())
    implausible = F.count_if(~plausible).alias("implausible")
    pages = pages.observe("before", F.count(F.lit(1)).alias("n_rows"), no_device, implausible)
    pages = pages.where(plausible).select(*PAGE_LOG.fieldNames())
    if first == "arrival":
        firsts, mode = dau_state.first_arrived(pages, delay=delay, salts=salts), "append"
    elif first == "event_time":
        firsts, mode = dau_state.earliest(pages, list(tiebreak), delay=delay), "update"
    else:
        raise ValueError("first must be 'arrival' or 'event_time'")

    firsts = firsts.observe("after", F.count(F.lit(1)).alias("n_rows"))

    seed = _seed(spark, table, generation)

    def enrich(batch: DataFrame, users: DataFrame, provinces: DataFrame) -> DataFrame:
        if seed:
            dated = dau.with_day(batch)
            days = [r[0] for r in dated.select("dt").distinct().collect()]
            written = batch.sparkSession.read.schema(_SEED).parquet(seed).where(F.col("dt").isin(days))
            batch = dau.not_yet_written(dated, written, unless_earlier=first == "event_time")
        return dau.enrich(batch, users, provinces, as_of=as_of, on_miss=on_miss)

    return _upsert_batches(firsts, enrich, read_dims, table, run, generation, mode)


def _seed(spark: SparkSession, table: KeyedTable, generation: int) -> str | None:
    """ST-3: devices written by earlier runs of a job that lost its checkpoint.

    Noted once, when the new run begins.  The table itself will not do: it also
    holds the run's own batches, and one that is written again would find itself.
    """
    if generation == 0:
        return None
    path = f"{table.path}/seed/run={generation}"
    if not exists(spark, f"{path}/_SUCCESS"):
        keys = table.read(spark).select(*_SEED.fieldNames())
        keys.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dt").parquet(path)
    return path


def start_order_wide(
    raw_headers: DataFrame,
    raw_lines: DataFrame,
    read_dims: Dims,
    table: KeyedTable,
    run: Run,
    *,
    cached: bool = False,
    tolerance: str = order_state.TOLERANCE,
    salts: int = order_state.SALTS,
    as_of: str | date | None = None,
    on_miss: str = "null",
    bound: bool = False,
) -> StreamingQuery:
    """Job 4: order-header and order-line topics to the order-wide table.

    ``bound``: both inputs come from ingest logs.

    ``cached=True`` keeps the sides in an expiring cache (:func:`join_cached`)
    instead of the join's own state.
    """
    spark = raw_headers.sparkSession
    generation = table.next_run(spark, run.checkpoint)
    if not bound:
        raw_headers = bind(raw_headers, ORDER_INFO, keep=("arrived",))
        raw_lines = bind(raw_lines, ORDER_DETAIL, keep=("arrived",))
    headers, lines = orders.with_create_parts(raw_headers), raw_lines
    if cached:
        joined = order_state.join_cached(headers, lines, salts=salts)
    else:
        joined = order_state.join_streams(headers, lines, tolerance=tolerance, salts=salts)

    def enrich(batch: DataFrame, users: DataFrame, provinces: DataFrame) -> DataFrame:
        return orders.with_dims(batch, users, provinces, as_of=as_of, on_miss=on_miss)

    return _upsert_batches(joined, enrich, read_dims, table, run, generation, "append")


def drain(query: StreamingQuery, timeout: float = 600.0) -> None:
    """Stop a query that never ends by itself once it has read all there is.

    Needed for expiring state, which keeps scheduling empty batches.
    """
    deadline = time.monotonic() + timeout
    while query.isActive and time.monotonic() < deadline:
        progress = query.lastProgress
        if progress and progress["batchId"] > 0 and progress["numInputRows"] == 0:
            query.stop()
            return
        if query.awaitTermination(1):
            return
    failed = query.exception()
    query.stop()
    if failed:
        raise failed
    raise TimeoutError("query did not run dry in time")


def dropped_late(query: StreamingQuery) -> int:
    """D9: rows refused because their day was closed."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def observed(query: StreamingQuery, name: str, metric: str = "n_rows") -> int:
    """SNK-11: total of an observed counter over the recent batches."""
    return sum(
        p["observedMetrics"][name][metric] for p in query.recentProgress if name in p["observedMetrics"]
    )
