"""Joining order headers and lines that arrive in different micro-batches."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.json import record_to_json
from millrace.operators.orders import join_lines_on, salted, wide_columns
from millrace.schemas import ORDER_DETAIL
from millrace.streaming import arrival_cache
from millrace.streaming.arrival_cache import ArrivalFrames

TOLERANCE = "24 hours"
#: Copies of a header in the state: each one divides the load of a hot order, and is
#: paid for by all orders.
SALTS = 4
#: Neighbouring order ids that share a group of the cache: orders that arrive together share its cost.
GROUP = 256
_DAY_MS = 24 * 3600 * 1000

# Python workers get the processor itself and need no installed package.
cloudpickle.register_pickle_by_value(arrival_cache)


def join_streams(
    headers: DataFrame, lines: DataFrame, *, tolerance: str = TOLERANCE, salts: int = SALTS
) -> DataFrame:
    """JN-9, ST-4, ST-6: inner join of two streams within ``tolerance`` of arrival.

    Both sides carry ``arrived``, the append time of the record.  Time runs by
    arrival, so a late event is never refused; a row leaves the state once the
    other side can no longer arrive in time.  ``salts`` spreads the lines of an
    order over that many tasks, at the price of that many copies of a header.
    """
    headers, lines = salted(headers, lines, salts)
    headers = headers.withColumnRenamed("arrived", "header_arrived").withColumnRenamed("salt", "header_salt")
    headers = headers.withWatermark("header_arrived", tolerance)
    lines = lines.withWatermark("arrived", tolerance)
    near = F.expr(
        f"salt = header_salt"
        f" AND arrived >= header_arrived - INTERVAL {tolerance}"
        f" AND arrived <= header_arrived + INTERVAL {tolerance}"
    )
    joined = join_lines_on(headers, lines, near, extra=("header_arrived", "arrived"))
    newest = F.greatest("header_arrived", "arrived")
    return joined.withColumn("joined_at", newest).drop("header_arrived", "arrived")


def join_cached(
    headers: DataFrame, lines: DataFrame, *, ttl_ms: int | None = _DAY_MS, salts: int = SALTS
) -> DataFrame:
    """ST-5, JN-7, JN-8, AGG-2: the same join by cache, expiring a day after the last write.

    A line is cached only while its header is missing, and stays cached after it
    is matched, so a header sent again is joined to it again.  Orders are cached in
    groups of ``GROUP`` neighbouring ids.  Needs the RocksDB
    state store.  A query with an expiry schedules empty batches for ever: stop
    it with :func:`millrace.streaming.jobs.drain`.
    """
    headers, lines = salted(headers, lines, salts)
    kept = T.StructType([f for f in headers.schema.fields if f.name not in ("salt", "arrived")])
    arrived = F.unix_micros("arrived").alias("arrived_us")
    left = headers.select(
        F.col("id").alias("order_key"),
        "salt",
        F.lit(None).cast("string").alias("line_id"),
        record_to_json(*kept.fieldNames(), arrived).alias("record"),
    )
    right = lines.select(
        F.col("order_id").alias("order_key"),
        "salt",
        F.col("id").cast("string").alias("line_id"),
        record_to_json(*ORDER_DETAIL.fieldNames(), arrived).alias("record"),
    )
    group = F.concat_ws("/", F.expr(f"order_key div {GROUP}").cast("string"), F.col("salt").cast("string"))
    pairs = (
        left.unionByName(right)
        .select(group.alias("orders"), F.col("order_key").cast("string").alias("order_key"), "line_id", "record")
        .groupBy("orders")
        .transformWithStateInPandas(
            ArrivalFrames(ttl_ms),
            outputStructType="header string, line string",
            outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )
    stamp = T.StructField("arrived_us", T.LongType())
    records = pairs.select(
        F.from_json("header", T.StructType([*kept.fields, stamp])).alias("header"),
        F.from_json("line", T.StructType([*ORDER_DETAIL.fields, stamp])).alias("line"),
    )
    newest = F.timestamp_micros(F.greatest("header.arrived_us", "line.arrived_us"))
    return records.select(*wide_columns(kept.fieldNames(), "header", "line"), newest.alias("joined_at"))
