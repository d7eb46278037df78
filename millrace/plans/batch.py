"""Batch twins of the jobs over the sample warehouse tables.

Every function takes ``(spark, sf_dir)`` and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import as_of_date, date_part, hour_part, whole_years
from millrace.functions.json import as_long, bind
from millrace.operators import cdc, dau, keyed, logs, orders
from millrace.operators.dims import miss_report, province_dim, user_dim
from millrace.schemas import (
    ORDER_DETAIL,
    ORDER_INFO,
    PAGE_LOG,
    TOPIC_PAGE,
)
from millrace.sources import samples
from millrace.sources.tables import stored, table, table_names
from millrace.streaming import ingest


# -- inputs --------------------------------------------------------------------


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.app_logs(table(spark, sf_dir, "events"))


def flat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.flatten(log_stream(spark, sf_dir), keep=("key",))


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.page_rows(flat_logs(spark, sf_dir), keep=("key",))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_dim(samples.users_json(table(spark, sf_dir, "customer")))


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return province_dim(samples.provinces_json(table(spark, sf_dir, "nation")))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(samples.order_headers_json(table(spark, sf_dir, "orders")), ORDER_INFO)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(samples.order_lines_json(table(spark, sf_dir, "lineitem")), ORDER_DETAIL)


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All change records: ``(key, seq, value)``."""
    no_seq = F.lit(None).cast("bigint").alias("seq")
    return (
        samples.order_changes(table(spark, sf_dir, "orders"), keep=(no_seq,))
        .unionByName(samples.line_changes(table(spark, sf_dir, "lineitem"), keep=(no_seq,)))
        .unionByName(samples.user_changes(table(spark, sf_dir, "customer")))
        .unionByName(samples.province_changes(table(spark, sf_dir, "nation")))
    )


def fact_tables(spark: SparkSession) -> DataFrame:
    return table_names(spark, samples.FACT_TABLES)


def dim_tables(spark: SparkSession) -> DataFrame:
    return table_names(spark, samples.DIM_TABLES)


# -- log split -------------------------------------------------------------------


def log_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records; the whole record is kept, so its parts can still be read."""
    errors = logs.error_rows(flat_logs(spark, sf_dir), keep=("key",))
    return errors.select(
        "key",
        F.get_json_object("value", "$.err.error_code").alias("error_code"),
        F.get_json_object("value", "$.common.mid").alias("mid"),
        F.get_json_object("value", "$.page.page_id").alias("page_id"),
    )


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_log(spark, sf_dir)


def log_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.display_rows(flat_logs(spark, sf_dir), keep=("key",))


def log_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.action_rows(flat_logs(spark, sf_dir), keep=("key",))


def log_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.start_rows(flat_logs(spark, sf_dir), keep=("key",))


def routed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.route(flat_logs(spark, sf_dir), keep=("key",))


def log_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_logs(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n_rows"))


def log_page_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page topic as its reader sees it: routed to JSON and bound again."""
    topic = routed_logs(spark, sf_dir).where(F.col("topic") == TOPIC_PAGE)
    return bind(topic, PAGE_LOG, keep=("key",))


def log_parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", as_long(F.get_json_object("props", "$.k")).alias("k"))


def log_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = samples.with_damage(log_stream(spark, sf_dir))
    flat = logs.flatten(damaged, keep=("key",))
    return logs.reject_rows(flat, keep=("key",)).select("key", "reject")


# -- change split ------------------------------------------------------------------


def cdc_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = samples.order_changes(table(spark, sf_dir, "orders"))
    return cdc.changes(feed, keep=("key",)).select("key", "op")


def cdc_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 of job 2: order changes that cannot be routed, with the reason."""
    feed = samples.with_faults(samples.order_changes(table(spark, sf_dir, "orders")), samples.CHANGE_FAULTS)
    return cdc.judged(feed, keep=("key",)).where("reject IS NOT NULL").select("key", "reject")


def page_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D9 of job 3: page records that do not bind or are dated ahead of their arrival."""
    topic = routed_logs(spark, sf_dir).where(F.col("topic") == TOPIC_PAGE)
    return _quarantine(samples.with_faults(topic, samples.PAGE_FAULTS), PAGE_LOG, [ingest.not_ahead()])


def order_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 of job 4: order headers that do not bind."""
    feed = samples.order_headers_json(table(spark, sf_dir, "orders"))
    return _quarantine(samples.with_faults(feed, samples.HEADER_FAULTS), ORDER_INFO)


def _quarantine(records: DataFrame, schema: T.StructType, gates: Sequence[ingest.Gate] = ()) -> DataFrame:
    judged = ingest.ingested(records.withColumn("arrived", F.current_timestamp()), schema, gates)
    return judged.where(F.col("kind") == ingest.REJECTED).select("key", "reject")


def cdc_fact_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cdc.changes(change_feed(spark, sf_dir))
    facts = cdc.fact_records(feed, fact_tables(spark), key="id", fields=("create_time",))
    return facts.select("topic", "key", "create_time")


def cdc_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cdc.changes(change_feed(spark, sf_dir))
    facts = cdc.fact_records(feed, fact_tables(spark))
    return facts.groupBy("topic").agg(F.count(F.lit(1)).alias("n_rows"))


def cdc_dim_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cdc.changes(change_feed(spark, sf_dir), keep=("seq",))
    log = cdc.dim_changes(feed, dim_tables(spark), keep=("seq",))
    current = cdc.current_dims(log, ["seq"])
    return user_dim(current)


# -- daily-active devices --------------------------------------------------------------


def dau_session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dau.session_starts(page_log(spark, sf_dir)).select("key", "mid", "page_id", "ts")


def dau_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page view per device and day, without the session-entry filter."""
    firsts = dau.first_of_day(page_log(spark, sf_dir), [F.col("key").cast("bigint")])
    return firsts.select("dt", "mid", "ts", "key", "page_id")


def dau_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = dau.session_starts(page_log(spark, sf_dir))
    return dau.first_of_day(starts, [F.col("key").cast("bigint")])


def dau_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dau.enrich(
        dau_firsts(spark, sf_dir), users(spark, sf_dir), provinces(spark, sf_dir), as_of=samples.AS_OF
    )


def dau_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page views of devices that are not yet on record for the day.

    On record are the devices of the start log.
    """
    firsts = dau_firsts(spark, sf_dir)
    written = dau.with_day(logs.start_rows(flat_logs(spark, sf_dir)))
    return dau.not_yet_written(firsts, written).select("dt", "mid", "ts", "page_id")


def dau_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = dau.session_starts(page_log(spark, sf_dir))
    return keyed.row_counts(starts, dau.first_of_day(starts, ["page_id"]))


def dim_user_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = whole_years("birthday", as_of_date(samples.AS_OF))
    return users(spark, sf_dir).select("id", "gender", "birthday", age.alias("age"))


def dim_miss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and provinces of orders that smaller dimensions lack: suppliers and regions."""
    few_users = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    few_provinces = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"))
    return miss_report(headers(spark, sf_dir), few_users, few_provinces)


# -- order wide --------------------------------------------------------------------


def order_header_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir)


def order_line_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


def enriched_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.enrich_headers(
        headers(spark, sf_dir), users(spark, sf_dir), provinces(spark, sf_dir), as_of=samples.AS_OF
    )


def order_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_headers(spark, sf_dir)


def order_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and hour of text timestamps that do have a time of day."""
    events = table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(
        "event_id", date_part(text).alias("create_date"), hour_part(text).alias("create_hour")
    )


def _bound_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Headers and lines, bound and written as typed records, for operators that read them more than once."""
    return stored(headers(spark, sf_dir), "order-headers"), stored(lines(spark, sf_dir), "order-lines")


def order_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = orders.full_outer(*_bound_once(spark, sf_dir))
    return joined.select(
        "header_id", "user_id", "header_create_time", "detail_id", "order_id", "sku_id", "detail_create_time"
    )


def order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = orders.join_lines(enriched_headers(spark, sf_dir), lines(spark, sf_dir))
    return orders.in_record_order(joined, ("dim_miss",))


def order_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without lines and lines without headers."""
    return orders.unmatched(*_bound_once(spark, sf_dir))


def order_wide_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line delivered twice; the second delivery has a new quantity and wins."""
    first = lines(spark, sf_dir)
    # Both deliveries come from one parse of the line.
    delivered = first.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    delivered = delivered.withColumn("sku_num", F.when(F.col("delivery") == 2, F.col("sku_num") + 100).otherwise(F.col("sku_num")))
    joined = orders.join_lines_on(
        orders.with_create_parts(headers(spark, sf_dir)), delivered, extra=("delivery",)
    )
    newest = orders.one_per_detail(joined, ["delivery"])
    return newest.select("create_date", "detail_id", "order_id", "sku_num", "create_time")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event per device and day, as a keyed table would keep it."""
    pages = dau.with_day(page_log(spark, sf_dir)).withColumn("seq", F.col("key").cast("bigint"))
    return keyed.latest_per_key(pages, ["dt", "mid"], ["seq"]).select(
        "dt", "mid", "seq", "page_id", "during_time"
    )
