"""Record schemas and fixed names.

Inputs are read with these explicit schemas; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
}


def record(columns: str) -> T.StructType:
    """A flat record from ``name type, name type, ...``; needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def _texts(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# ---------------------------------------------------------------------------
# Topic, table-list and column names shared with producers and
# consumers outside this package.
# ---------------------------------------------------------------------------
TOPIC_ODS_LOG = "ODS_BASE_LOG"
TOPIC_ODS_DB = "ODS_BASE_DB_M"
TOPIC_PAGE = "DWD_PAGE_LOG_TOPIC"
TOPIC_DISPLAY = "DWD_PAGE_DISPLAY_TOPIC"
TOPIC_ACTION = "DWD_PAGE_ACTION_TOPIC"
TOPIC_START = "DWD_START_LOG_TOPIC"
TOPIC_ERROR = "DWD_ERROR_LOG_TOPIC"
TOPIC_ORDER_INFO_INSERT = "DWD_ORDER_INFO_I"
TOPIC_ORDER_DETAIL_INSERT = "DWD_ORDER_DETAIL_I"

# Change types that are kept, with the letter used in topic names.
CHANGE_OPS = {
    "bootstrap-insert": "I",
    "insert": "I",
    "update": "U",
    "delete": "D",
}

# Raw name in the log -> column name in every flattened record.
COMMON_FIELDS = {
    "ar": "province_id",
    "uid": "user_id",
    "os": "operate_system",
    "ch": "channel",
    "is_new": "is_new",
    "md": "model",
    "mid": "mid",
    "vc": "version_code",
    "ba": "brand",
}
PAGE_FIELDS = {
    "page_id": "page_id",
    "item": "page_item",
    "during_time": "during_time",
    "item_type": "page_item_type",
    "last_page_id": "last_page_id",
    "source_type": "source_type",
}
DISPLAY_FIELDS = {
    "display_type": "display_type",
    "item": "display_item",
    "item_type": "display_item_type",
    "pos_id": "display_pos_id",
    "order": "display_order",
}
ACTION_FIELDS = {
    "item": "item",
    "action_id": "action_id",
    "item_type": "item_type",
    "ts": "action_ts",
}
START_FIELDS = {
    "entry": "entry",
    "open_ad_skip_ms": "open_ad_skip_ms",
    "open_ad_ms": "open_ad_ms",
    "loading_time": "loading_time",
    "open_ad_id": "open_ad_id",
}

# Output of this package only: records that could not be split.
TOPIC_LOG_REJECT = "ODS_LOG_REJECT"
TOPIC_DB_REJECT = "ODS_DB_REJECT"

# ---------------------------------------------------------------------------
# Raw inputs
# ---------------------------------------------------------------------------
CORRUPT = "_corrupt"

# Leaves are text so that numbers sent as text (and text sent as numbers) are
# both accepted; numeric columns are cast when the record is flattened.
RAW_LOG = T.StructType(
    [
        T.StructField("common", _texts(COMMON_FIELDS)),
        T.StructField("page", _texts(PAGE_FIELDS)),
        T.StructField("displays", T.ArrayType(_texts(DISPLAY_FIELDS))),
        T.StructField("actions", T.ArrayType(_texts(ACTION_FIELDS))),
        T.StructField("start", _texts(START_FIELDS)),
        T.StructField("err", T.StringType()),
        T.StructField("ts", T.StringType()),
    ]
)

CHANGE_ENVELOPE = record("type string, table string, data string")

USER_DIM = record("id string, gender string, birthday string")
PROVINCE_DIM = record(
    "id string, name string, iso_code string, iso_3166_2 string, area_code string"
)

# ---------------------------------------------------------------------------
# Flattened records
# ---------------------------------------------------------------------------
_COMMON_DDL = ", ".join(f"{c} string" for c in COMMON_FIELDS.values())
_PAGE_DDL = (
    "page_id string, page_item string, during_time bigint, page_item_type string, "
    "last_page_id string, source_type string"
)

PAGE_LOG = record(f"{_COMMON_DDL}, {_PAGE_DDL}, ts bigint")
DISPLAY_LOG = record(
    f"{_COMMON_DDL}, {_PAGE_DDL}, display_type string, display_item string, "
    "display_item_type string, display_pos_id string, display_order string, ts bigint"
)
ACTION_LOG = record(
    f"{_COMMON_DDL}, {_PAGE_DDL}, item string, action_id string, item_type string, "
    "action_ts bigint, ts bigint"
)
START_LOG = record(
    f"{_COMMON_DDL}, entry string, open_ad_skip_ms bigint, open_ad_ms bigint, "
    "loading_time bigint, open_ad_id bigint, ts bigint"
)

DAU_WIDE = record(
    """
    mid string, user_id string, province_id string, channel string, is_new string,
    model string, operate_system string, version_code string, brand string,
    page_id string, page_item string, page_item_type string, source_type string,
    during_time bigint, user_gender string, user_age string, province_name string,
    province_iso_code string, province_3166_2 string, province_area_code string,
    dt string, hr string, ts bigint
    """
)

ORDER_INFO = record(
    """
    id bigint, province_id bigint, order_status string, user_id bigint,
    total_amount double, activity_reduce_amount double, coupon_reduce_amount double,
    original_total_amount double, feight_fee double, feight_fee_reduce double,
    expire_time string, refundable_time string, create_time string,
    operate_time string
    """
)
ORDER_DETAIL = record(
    """
    id bigint, order_id bigint, sku_id bigint, order_price double, sku_num bigint,
    sku_name string, create_time string, split_total_amount double,
    split_activity_amount double, split_coupon_amount double
    """
)
ORDER_WIDE = record(
    """
    detail_id bigint, order_id bigint, sku_id bigint, order_price double,
    sku_num bigint, sku_name string, split_total_amount double,
    split_activity_amount double, split_coupon_amount double, province_id bigint,
    order_status string, user_id bigint, total_amount double,
    activity_reduce_amount double, coupon_reduce_amount double,
    original_total_amount double, feight_fee double, feight_fee_reduce double,
    expire_time string, refundable_time string, create_time string,
    operate_time string, create_date string, create_hour string,
    province_name string, province_area_code string, province_3166_2_code string,
    province_iso_code string, user_age int, user_gender string
    """
)
