"""Adapter: the records of this package, derived from the sample warehouse tables.

Each record is written as JSON text, as it would arrive from a topic, so the
parsing paths are the ones production data takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.json import record_to_json

AS_OF = "2024-02-01"
#: The tables of the change feed, by kind.
FACT_TABLES = ["order_info", "order_detail"]
DIM_TABLES = ["user_info", "base_province"]

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), _text(number))


def app_logs(events: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``events`` as nested app logs: ``(key, value)`` with the event id as key."""
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    common = F.struct(
        _text(user % 25).alias("ar"),
        _text(user).alias("uid"),
        F.when(user % 2 == 0, "Android").otherwise("iOS").alias("os"),
        _cat("ch", user % 5).alias("ch"),
        _text(user % 2).alias("is_new"),
        _cat("model-", user % 7).alias("md"),
        _cat("m", user).alias("mid"),
        _cat("v2.1.", user % 10).alias("vc"),
        _cat("brand-", user % 6).alias("ba"),
    )
    page = F.struct(
        kind.alias("page_id"),
        _text(n % 500).alias("item"),
        (n % 1000).alias("during_time"),
        F.lit("sku_id").alias("item_type"),
        F.when(n % 3 != 0, "home").alias("last_page_id"),
        F.lit("promotion").alias("source_type"),
    )
    steps = F.when(n % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), n % 4))
    displays = F.transform(
        steps,
        lambda i: F.struct(
            F.lit("query").alias("display_type"),
            _text((n * 7 + i) % 1000).alias("item"),
            F.lit("sku_id").alias("item_type"),
            _text(i % 5).alias("pos_id"),
            i.alias("order"),
        ),
    )
    actions = F.transform(
        steps,
        lambda i: F.struct(
            _cat("act", i).alias("action_id"),
            _text((n * 3 + i) % 1000).alias("item"),
            F.lit("sku_id").alias("item_type"),
            (ts + i * 1000).alias("ts"),
        ),
    )
    start = F.struct(
        F.lit("icon").alias("entry"),
        (n % 100).alias("open_ad_skip_ms"),
        (n % 5000).alias("open_ad_ms"),
        (n % 3000).alias("loading_time"),
        (n % 20).alias("open_ad_id"),
    )
    err = F.struct((n % 100).alias("error_code"), F.lit("failed").alias("msg"))
    on_page = kind.isin("view", "click", "purchase", "error")
    value = record_to_json(
        common.alias("common"),
        F.when(on_page, page).alias("page"),
        F.when(kind == "view", displays).alias("displays"),
        F.when(kind == "click", actions).alias("actions"),
        F.when(kind.isin("signup", "error"), start).alias("start"),
        F.when(kind == "error", err).alias("err"),
        ts.alias("ts"),
    )
    return events.select(*keep, _text(n).alias("key"), value.alias("value"))


def with_damage(logs: DataFrame) -> DataFrame:
    """The same logs with records of every kind that cannot be split."""
    n = F.col("key").cast("bigint")
    cut = F.expr("substr(value, 1, length(value) - 5)")
    value = (
        F.when(n % 7 == 0, cut)
        .when(n % 11 == 0, F.lit(None).cast("string"))
        .when(n % 13 == 0, F.replace("value", F.lit('"common":'), F.lit('"other":')))
        .when(n % 17 == 0, F.replace("value", F.lit('"during_time":'), F.lit('"during":')))
        .otherwise(F.col("value"))
    )
    return logs.withColumn("value", value)


def with_faults(records: DataFrame, faults: dict[int, tuple[str, str]]) -> DataFrame:
    """The same records, some without a value or cut short; a fault puts a text for a pattern where its number divides the key."""
    n = F.col("key").cast("bigint")
    value = F.when(n % 7 == 0, F.expr("substr(value, 1, length(value) - 5)")).when(n % 11 == 0, F.lit(None).cast("string"))
    for number, (pattern, text) in faults.items():
        value = value.when(n % number == 0, F.regexp_replace("value", pattern, text))
    return records.withColumn("value", value.otherwise(F.col("value")))


CHANGE_FAULTS = {13: ('"table":', '"tbl":'), 17: ('"data":', '"row":')}
PAGE_FAULTS = {13: ('"during_time":[0-9]+', '"during_time":"long"'), 17: ('"ts":[0-9]+', '"ts":99999999999999')}
HEADER_FAULTS = {13: ('"total_amount":[^,}]+', '"total_amount":"much"')}


def users_json(customers: DataFrame) -> DataFrame:
    """``customer`` as rows of the user dimension: ``(dim, id, data)``."""
    return _dim("USER_INFO", customers, "c_custkey", _user_image(F.col("c_custkey")))


def _user_image(key: Column) -> list[Column]:
    return [
        _text(key).alias("id"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        _text(F.date_add(F.lit("1970-01-01").cast("date"), (key % 12000).cast("int"))).alias("birthday"),
    ]


def provinces_json(nations: DataFrame) -> DataFrame:
    """``nation`` as rows of the province dimension: ``(dim, id, data)``."""
    return _dim("BASE_PROVINCE", nations, "n_nationkey", _province_image())


def _province_image() -> list[Column]:
    key = F.col("n_nationkey")
    return [
        _text(key).alias("id"),
        F.col("n_name").alias("name"),
        _cat("ISO-", key).alias("iso_code"),
        _cat("CN-", key).alias("iso_3166_2"),
        _text(key + 100000).alias("area_code"),
    ]


def _dim(name: str, df: DataFrame, key: str, image: list[Column]) -> DataFrame:
    return df.select(F.lit(name).alias("dim"), _text(key).alias("id"), record_to_json(*image).alias("data"))


def _header_image() -> list[Column]:
    return [
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 25).alias("province_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("total_amount"),
        F.date_format("o_orderdate", _STAMP).alias("create_time"),
    ]


def _line_image() -> list[Column]:
    return [
        line_id().alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_extendedprice").alias("order_price"),
        F.col("l_quantity").alias("sku_num"),
        F.date_format("l_shipdate", _STAMP).alias("create_time"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("split_total_amount"),
    ]


def line_id() -> Column:
    """A number for a line, from the five columns that identify it.

    A digest, so that no order has to be gathered to number its lines.
    """
    digest = F.md5(
        F.concat_ws(
            "|",
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            F.date_format("l_shipdate", "yyyy-MM-dd"),
        ).cast("binary")
    )
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def order_headers_json(orders: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``orders`` as order-header records: ``(key, value)``."""
    return orders.select(*keep, _text("o_orderkey").alias("key"), record_to_json(*_header_image()).alias("value"))


def order_lines_json(lines: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``lineitem`` as order-line records: ``(key, value)``."""
    return lines.select(*keep, _text("l_orderkey").alias("key"), record_to_json(*_line_image()).alias("value"))


def _change(kind: Column, table: str, image: list[Column]) -> Column:
    return record_to_json(kind.alias("type"), F.lit(table).alias("table"), F.struct(*image).alias("data"))


def _change_type(key: Column) -> Column:
    step = key % 5
    return (
        F.when(step == 0, "bootstrap-insert")
        .when(step == 1, "insert")
        .when(step == 2, "update")
        .when(step == 3, "delete")
        .otherwise("bootstrap-start")
    )


def order_changes(orders: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``orders`` as change records; every change type occurs."""
    key = F.col("o_orderkey")
    value = _change(_change_type(key), "order_info", _header_image())
    return orders.select(*keep, _text(key).alias("key"), value.alias("value"))


def line_changes(lines: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``lineitem`` as change records; every change type occurs."""
    value = _change(_change_type(F.col("l_orderkey")), "order_detail", _line_image())
    return lines.select(*keep, _text("l_orderkey").alias("key"), value.alias("value"))


def user_changes(customers: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Three changes per customer, ``seq`` in arrival order; every third ends in a delete.

    The image of change ``v`` is that of key ``c_custkey + v``, under the same id.
    """
    versions = customers.select(
        *keep, "c_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v")
    )
    key, v = F.col("c_custkey"), F.col("v")
    kind = (
        F.when(v == 0, "insert")
        .when((v == 2) & (key % 3 == 0), "delete")
        .when((v == 2) & (key % 3 == 1), "bootstrap-complete")
        .otherwise("update")
    )
    image = [_text(key).alias("id"), *_user_image(key + v)[1:]]
    return versions.select(
        *keep,
        _text(key).alias("key"),
        (key * 3 + v).alias("seq"),
        _change(kind, "user_info", image).alias("value"),
    )


def province_changes(nations: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One bootstrap change per nation."""
    value = _change(F.lit("bootstrap-insert"), "base_province", _province_image())
    return nations.select(
        *keep,
        _text("n_nationkey").alias("key"),
        F.col("n_nationkey").cast("bigint").alias("seq"),
        value.alias("value"),
    )
