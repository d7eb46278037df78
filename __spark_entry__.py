"""

Queries read whole tables.  The SQL states the same results on plain columns,
without the JSON records the queries pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import batch, streams

_HERE = Path(__file__).resolve().parent
if (_HERE / "millrace/llm/queries.py").exists() and (_HERE / "corpus_pipeline.py").exists():
    import corpus_pipeline
    from millrace.llm import queries as llm
else:  # the training-data operators are an optional part; a library they lack is an error
    corpus_pipeline = llm = None

SAMPLE = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Daily-active devices with user and province attributes."""
    return _utc(batch.dau_wide)(spark, SAMPLE)


def _utc(query: Query) -> Query:
    """Days and hours are those of UTC, whatever zone the caller's session has."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    registered = [
        batch.log_error,
        batch.log_page,
        batch.log_display,
        batch.log_action,
        batch.log_start,
        batch.log_route_counts,
        batch.log_page_topic,
        batch.log_parse_props,
        batch.log_quarantine,
        batch.cdc_quarantine,
        batch.page_quarantine,
        batch.order_quarantine,
        batch.cdc_ops,
        batch.cdc_fact_route,
        batch.cdc_fact_counts,
        batch.cdc_dim_latest,
        batch.dau_session_start,
        batch.dau_dedup,
        batch.dau_bootstrap,
        batch.dau_wide,
        batch.dau_counters,
        batch.dim_user_age,
        batch.dim_miss_report,
        batch.order_header_bind,
        batch.order_line_bind,
        batch.order_enrich,
        batch.order_time_parts,
        batch.order_full_outer,
        batch.order_wide,
        batch.order_unmatched,
        batch.order_wide_replay,
        batch.upsert_latest,
        streams.dau_day_index,
        streams.stream_log_split,
        streams.stream_log_records,
        streams.stream_change_split,
        streams.stream_change_feeds,
        streams.stream_dau,
        streams.stream_dau_earliest,
        streams.stream_dau_restart,
        streams.stream_order_wide,
        streams.stream_order_wide_cached,
    ]
    more = llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {}
    return {query.__name__: _utc(query) for query in registered} | {name: _utc(query) for name, query in more.items()}


# -- SQL ---------------------------------------------------------------------------

_COMMON = """
    CAST(e.user_id % 25 AS VARCHAR) AS province_id,
    CAST(e.user_id AS VARCHAR) AS user_id,
    CASE WHEN e.user_id % 2 = 0 THEN 'Android' ELSE 'iOS' END AS operate_system,
    'ch' || CAST(e.user_id % 5 AS VARCHAR) AS channel,
    CAST(e.user_id % 2 AS VARCHAR) AS is_new,
    'model-' || CAST(e.user_id % 7 AS VARCHAR) AS model,
    'm' || CAST(e.user_id AS VARCHAR) AS mid,
    'v2.1.' || CAST(e.user_id % 10 AS VARCHAR) AS version_code,
    'brand-' || CAST(e.user_id % 6 AS VARCHAR) AS brand"""

_PAGE = """
    e.event_type AS page_id,
    CAST(e.event_id % 500 AS VARCHAR) AS page_item,
    e.event_id % 1000 AS during_time,
    'sku_id' AS page_item_type,
    CASE WHEN e.event_id % 3 <> 0 THEN 'home' END AS last_page_id,
    'promotion' AS source_type"""

_KEY = "CAST(e.event_id AS VARCHAR) AS key"
_ON_PAGE = "e.event_type IN ('view', 'click', 'purchase')"

_PAGE_LOG = f"SELECT {_KEY}, {_COMMON}, {_PAGE}, epoch_us(e.ts) // 1000 AS ts FROM events e WHERE {_ON_PAGE}"

_ROUTED = """
    SELECT 'DWD_ERROR_LOG_TOPIC' AS topic, event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'DWD_START_LOG_TOPIC', event_id FROM events WHERE event_type = 'signup'
    UNION ALL SELECT 'DWD_PAGE_LOG_TOPIC', event_id FROM events WHERE event_type IN ('view', 'click', 'purchase')
    UNION ALL SELECT 'DWD_PAGE_DISPLAY_TOPIC', event_id FROM events, range(3) t(i)
        WHERE event_type = 'view' AND i < event_id % 4
    UNION ALL SELECT 'DWD_PAGE_ACTION_TOPIC', event_id FROM events, range(3) t(i)
        WHERE event_type = 'click' AND i < event_id % 4"""
_ROUTE_COUNTS = f"SELECT topic, count(*) AS n_rows FROM ({_ROUTED}) GROUP BY topic"

_USERS = """
    SELECT CAST(c_custkey AS VARCHAR) AS id,
           CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
           strftime(DATE '1970-01-01' + CAST(c_custkey % 12000 AS INTEGER), '%Y-%m-%d') AS birthday
    FROM customer"""


def _age(born: str) -> str:
    """Full years on 2024-02-01."""
    return (
        f"CAST(date_diff('year', CAST({born} AS DATE), DATE '2024-02-01')"
        f" - CASE WHEN strftime(CAST({born} AS DATE), '%m%d') > '0201' THEN 1 ELSE 0 END AS INTEGER)"
    )


_DAU_FIRST = f"""
    SELECT *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt,
           strftime(make_timestamp(ts * 1000), '%H') AS hr
    FROM ({_PAGE_LOG})
    WHERE last_page_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY strftime(make_timestamp(ts * 1000), '%Y-%m-%d'), mid
                               ORDER BY ts, CAST(key AS BIGINT)) = 1"""

_DAU_WIDE = f"""
    SELECT d.mid, d.user_id, d.province_id, d.channel, d.is_new, d.model, d.operate_system,
           d.version_code, d.brand, d.page_id, d.page_item, d.page_item_type, d.source_type,
           d.during_time, u.gender AS user_gender, CAST({_age("u.birthday")} AS VARCHAR) AS user_age,
           n.n_name AS province_name,
           'ISO-' || CAST(n.n_nationkey AS VARCHAR) AS province_iso_code,
           'CN-' || CAST(n.n_nationkey AS VARCHAR) AS province_3166_2,
           CAST(100000 + n.n_nationkey AS VARCHAR) AS province_area_code,
           d.dt, d.hr, d.ts, (u.id IS NULL OR n.n_nationkey IS NULL) AS dim_miss
    FROM ({_DAU_FIRST}) d
    LEFT JOIN ({_USERS}) u ON u.id = d.user_id
    LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = d.province_id"""

_HEADERS = """
    SELECT o_orderkey AS id, o_custkey % 25 AS province_id, o_orderstatus AS order_status,
           o_custkey AS user_id, o_totalprice AS total_amount,
           CAST(0 AS DOUBLE) AS activity_reduce_amount, CAST(0 AS DOUBLE) AS coupon_reduce_amount,
           CAST(0 AS DOUBLE) AS original_total_amount, CAST(0 AS DOUBLE) AS feight_fee,
           CAST(0 AS DOUBLE) AS feight_fee_reduce, CAST(NULL AS VARCHAR) AS expire_time,
           CAST(NULL AS VARCHAR) AS refundable_time,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS create_time,
           CAST(NULL AS VARCHAR) AS operate_time
    FROM orders"""

_LINES = """
    SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                                             strftime(l_shipdate, '%Y-%m-%d'))), 1, 15) AS BIGINT) AS id,
           l_orderkey AS order_id, l_partkey AS sku_id, l_extendedprice AS order_price,
           CAST(l_quantity AS BIGINT) AS sku_num, CAST(NULL AS VARCHAR) AS sku_name,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS create_time,
           l_extendedprice * (1 - l_discount) AS split_total_amount,
           CAST(0 AS DOUBLE) AS split_activity_amount, CAST(0 AS DOUBLE) AS split_coupon_amount
    FROM lineitem"""

_ENRICHED = f"""
    SELECT h.*, substr(h.create_time, 1, 10) AS create_date, substr(h.create_time, 12, 2) AS create_hour,
           u.gender AS user_gender, {_age("u.birthday")} AS user_age, n.n_name AS province_name,
           'ISO-' || CAST(n.n_nationkey AS VARCHAR) AS province_iso_code,
           'CN-' || CAST(n.n_nationkey AS VARCHAR) AS province_3166_2_code,
           CAST(100000 + n.n_nationkey AS VARCHAR) AS province_area_code,
           (u.id IS NULL OR n.n_nationkey IS NULL) AS dim_miss
    FROM ({_HEADERS}) h
    LEFT JOIN ({_USERS}) u ON u.id = CAST(h.user_id AS VARCHAR)
    LEFT JOIN nation n ON n.n_nationkey = h.province_id"""

_ORDER_WIDE = f"""
    SELECT l.id AS detail_id, l.order_id, l.sku_id, l.order_price, l.sku_num, l.sku_name,
           l.split_total_amount, l.split_activity_amount, l.split_coupon_amount,
           h.province_id, h.order_status, h.user_id, h.total_amount, h.activity_reduce_amount,
           h.coupon_reduce_amount, h.original_total_amount, h.feight_fee, h.feight_fee_reduce,
           h.expire_time, h.refundable_time, l.create_time, h.operate_time, h.create_date,
           h.create_hour, h.province_name, h.province_area_code, h.province_3166_2_code,
           h.province_iso_code, h.user_age, h.user_gender, h.dim_miss
    FROM ({_ENRICHED}) h JOIN ({_LINES}) l ON h.id = l.order_id"""


def _op(key: str) -> str:
    return f"CASE {key} % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'I' WHEN 2 THEN 'U' WHEN 3 THEN 'D' END"


_FACTS = f"""
    SELECT 'DWD_ORDER_INFO_' || {_op("id")} AS topic, CAST(id AS VARCHAR) AS key, create_time
    FROM ({_HEADERS}) WHERE {_op("id")} IS NOT NULL
    UNION ALL
    SELECT 'DWD_ORDER_DETAIL_' || {_op("order_id")}, CAST(id AS VARCHAR), create_time
    FROM ({_LINES}) WHERE {_op("order_id")} IS NOT NULL"""

_DIM_LATEST = """
    SELECT CAST(c_custkey AS VARCHAR) AS id,
           CASE WHEN (c_custkey + v) % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
           strftime(DATE '1970-01-01' + CAST((c_custkey + v) % 12000 AS INTEGER), '%Y-%m-%d') AS birthday
    FROM customer, range(3) t(v)
    WHERE NOT (v = 2 AND c_custkey % 3 = 1)
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC) = 1"""


def oracle_sql() -> dict[str, str]:
    return (llm.oracle_sql() if llm else {}) | {
        "log_error": """
            SELECT CAST(event_id AS VARCHAR) AS key, CAST(event_id % 100 AS VARCHAR) AS error_code,
                   'm' || CAST(user_id AS VARCHAR) AS mid, event_type AS page_id
            FROM events WHERE event_type = 'error'""",
        "log_page": _PAGE_LOG,
        "log_display": f"""
            SELECT {_KEY}, {_COMMON}, {_PAGE}, 'query' AS display_type,
                   CAST((e.event_id * 7 + i) % 1000 AS VARCHAR) AS display_item,
                   'sku_id' AS display_item_type, CAST(i % 5 AS VARCHAR) AS display_pos_id,
                   CAST(i AS VARCHAR) AS display_order, epoch_us(e.ts) // 1000 AS ts
            FROM events e, range(1, 4) t(i)
            WHERE e.event_type = 'view' AND i <= e.event_id % 4""",
        "log_action": f"""
            SELECT {_KEY}, {_COMMON}, {_PAGE}, CAST((e.event_id * 3 + i) % 1000 AS VARCHAR) AS item,
                   'act' || CAST(i AS VARCHAR) AS action_id, 'sku_id' AS item_type,
                   epoch_us(e.ts) // 1000 + i * 1000 AS action_ts, epoch_us(e.ts) // 1000 AS ts
            FROM events e, range(1, 4) t(i)
            WHERE e.event_type = 'click' AND i <= e.event_id % 4""",
        "log_start": f"""
            SELECT {_KEY}, {_COMMON}, 'icon' AS entry, e.event_id % 100 AS open_ad_skip_ms,
                   e.event_id % 5000 AS open_ad_ms, e.event_id % 3000 AS loading_time,
                   e.event_id % 20 AS open_ad_id, epoch_us(e.ts) // 1000 AS ts
            FROM events e WHERE e.event_type = 'signup'""",
        "log_route_counts": _ROUTE_COUNTS,
        "log_page_topic": _PAGE_LOG,
        "log_parse_props": """
            SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
        "log_quarantine": """
            SELECT * FROM (
                SELECT CAST(event_id AS VARCHAR) AS key,
                       CASE WHEN event_id % 7 = 0 THEN 'bad_json'
                            WHEN event_id % 11 = 0 THEN 'no_value'
                            WHEN event_type = 'error' THEN NULL
                            WHEN event_id % 13 = 0 THEN 'no_common'
                            WHEN event_id % 17 = 0 AND event_type IN ('view', 'click', 'purchase')
                                THEN 'bad_number'
                       END AS reject
                FROM events) WHERE reject IS NOT NULL""",
        "cdc_quarantine": """
            SELECT * FROM (
                SELECT CAST(o_orderkey AS VARCHAR) AS key,
                       CASE WHEN o_orderkey % 7 = 0 THEN 'bad_json'
                            WHEN o_orderkey % 11 = 0 THEN 'no_value'
                            WHEN o_orderkey % 5 = 4 THEN NULL
                            WHEN o_orderkey % 13 = 0 THEN 'no_table'
                            WHEN o_orderkey % 17 = 0 THEN 'no_data'
                       END AS reject
                FROM orders) WHERE reject IS NOT NULL""",
        "page_quarantine": f"""
            SELECT * FROM (
                SELECT CAST(e.event_id AS VARCHAR) AS key,
                       CASE WHEN e.event_id % 7 = 0 THEN 'bad_json'
                            WHEN e.event_id % 11 = 0 THEN 'no_value'
                            WHEN e.event_id % 13 = 0 THEN 'bad_number'
                            WHEN e.event_id % 17 = 0 THEN 'future_ts'
                       END AS reject
                FROM events e WHERE {_ON_PAGE}) WHERE reject IS NOT NULL""",
        "order_quarantine": """
            SELECT * FROM (
                SELECT CAST(o_orderkey AS VARCHAR) AS key,
                       CASE WHEN o_orderkey % 7 = 0 THEN 'bad_json'
                            WHEN o_orderkey % 11 = 0 THEN 'no_value'
                            WHEN o_orderkey % 13 = 0 THEN 'bad_number'
                       END AS reject
                FROM orders) WHERE reject IS NOT NULL""",
        "cdc_ops": f"""
            SELECT CAST(o_orderkey AS VARCHAR) AS key, {_op("o_orderkey")} AS op
            FROM orders WHERE o_orderkey % 5 <> 4""",
        "cdc_fact_route": _FACTS,
        "cdc_fact_counts": f"SELECT topic, count(*) AS n_rows FROM ({_FACTS}) GROUP BY topic",
        "cdc_dim_latest": _DIM_LATEST,
        "dau_session_start": f"""
            SELECT key, mid, page_id, ts FROM ({_PAGE_LOG}) WHERE last_page_id IS NULL""",
        "dau_dedup": f"""
            SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt, mid, ts, key, page_id
            FROM ({_PAGE_LOG})
            QUALIFY row_number() OVER (PARTITION BY strftime(make_timestamp(ts * 1000), '%Y-%m-%d'), mid
                                       ORDER BY ts, CAST(key AS BIGINT)) = 1""",
        "dau_bootstrap": f"""
            SELECT f.dt, f.mid, f.ts, f.page_id FROM ({_DAU_FIRST}) f
            WHERE NOT EXISTS (SELECT 1 FROM events e
                              WHERE e.event_type = 'signup' AND strftime(e.ts, '%Y-%m-%d') = f.dt
                                AND 'm' || CAST(e.user_id AS VARCHAR) = f.mid)""",
        "dau_wide": _DAU_WIDE,
        "dau_counters": f"""
            SELECT 'before' AS stage, count(*) AS n_rows FROM ({_PAGE_LOG}) WHERE last_page_id IS NULL
            UNION ALL SELECT 'after', count(*) FROM ({_DAU_FIRST})""",
        "dim_user_age": f"""
            SELECT id, gender, birthday, {_age("birthday")} AS age FROM ({_USERS})""",
        "dim_miss_report": """
            SELECT 'USER_INFO' AS dim, CAST(o_custkey AS VARCHAR) AS id, count(*) AS n_rows
            FROM orders
            WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)
            GROUP BY o_custkey
            UNION ALL
            SELECT 'BASE_PROVINCE', CAST(o_custkey % 25 AS VARCHAR), count(*) FROM orders
            WHERE o_custkey % 25 NOT IN (SELECT r_regionkey FROM region)
            GROUP BY o_custkey % 25""",
        "order_header_bind": _HEADERS,
        "order_line_bind": _LINES,
        "order_enrich": _ENRICHED,
        "order_time_parts": """
            SELECT event_id, strftime(ts, '%Y-%m-%d') AS create_date, strftime(ts, '%H') AS create_hour
            FROM events""",
        "order_full_outer": f"""
            SELECT h.id AS header_id, h.user_id, h.create_time AS header_create_time,
                   l.id AS detail_id, l.order_id, l.sku_id, l.create_time AS detail_create_time
            FROM ({_HEADERS}) h FULL JOIN ({_LINES}) l ON h.id = l.order_id""",
        "order_wide": _ORDER_WIDE,
        "order_unmatched": f"""
            WITH h AS ({_HEADERS}), l AS ({_LINES})
            SELECT 'header' AS side, h.id AS order_id, CAST(NULL AS BIGINT) AS detail_id
            FROM h WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.order_id = h.id)
            UNION ALL
            SELECT 'line', l.order_id, l.id FROM l
            WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = l.order_id)""",
        "order_wide_replay": f"""
            SELECT substr(h.create_time, 1, 10) AS create_date, l.id AS detail_id, l.order_id,
                   l.sku_num + 100 AS sku_num, l.create_time
            FROM ({_HEADERS}) h JOIN ({_LINES}) l ON h.id = l.order_id""",
        "upsert_latest": f"""
            SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt, mid,
                   CAST(key AS BIGINT) AS seq, page_id, during_time
            FROM ({_PAGE_LOG})
            QUALIFY row_number() OVER (PARTITION BY strftime(make_timestamp(ts * 1000), '%Y-%m-%d'), mid
                                       ORDER BY CAST(key AS BIGINT) DESC) = 1""",
        "dau_day_index": f"SELECT mid FROM ({_DAU_FIRST}) WHERE dt = '2024-01-05'",
        "stream_log_split": _ROUTE_COUNTS,
        "stream_log_records": f"""
            SELECT r.topic, 'm' || CAST(e.user_id AS VARCHAR) AS mid, epoch_us(e.ts) // 1000 AS ts
            FROM ({_ROUTED}) r JOIN events e ON e.event_id = r.event_id""",
        "stream_change_feeds": f"""
            SELECT topic, key AS id, create_time AS detail FROM ({_FACTS})
            UNION ALL SELECT 'USER_INFO', id, gender || '|' || birthday FROM ({_DIM_LATEST})
            UNION ALL SELECT 'BASE_PROVINCE', CAST(n_nationkey AS VARCHAR), n_name FROM nation""",
        "stream_change_split": f"""
            SELECT topic, key AS id, CAST(NULL AS VARCHAR) AS birthday FROM ({_FACTS})
            WHERE topic LIKE 'DWD_ORDER_INFO%'
            UNION ALL SELECT 'USER_INFO', id, birthday FROM ({_DIM_LATEST})""",
        "stream_dau": f"""
            SELECT dt, mid, user_id, channel, brand, user_gender, user_age, province_name,
                   province_area_code, dim_miss
            FROM ({_DAU_WIDE})""",
        "stream_dau_earliest": _DAU_WIDE,
        "stream_dau_restart": _DAU_WIDE,
        "stream_order_wide": _ORDER_WIDE,
        "stream_order_wide_cached": _ORDER_WIDE,
    }
