"""Order wide table: enriched order headers joined to order lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import date_part, hour_part
from millrace.operators.dims import settle_misses, with_provinces, with_users
from millrace.operators.keyed import latest_per_key
from millrace.schemas import ORDER_DETAIL, ORDER_WIDE

#: Headers and lines are both unbounded, and Spark judges a side by its compressed
#: files, before JSON is unfolded; so neither is ever broadcast to the other.
_NO_BROADCAST = "merge"

#: Columns both records have; the line's value wins in the wide record (F8).
_SHARED = {"id", "create_time"}
_LINE_ONLY = [c for c in ORDER_DETAIL.fieldNames() if c not in _SHARED]


def with_create_parts(headers: DataFrame) -> DataFrame:
    """FN-10: adds ``create_date`` and ``create_hour``."""
    return headers.withColumns(
        {"create_date": date_part("create_time"), "create_hour": hour_part("create_time")}
    )


def with_dims(
    df: DataFrame,
    users: DataFrame,
    provinces: DataFrame,
    *,
    as_of: str | date | None = None,
    on_miss: str = "null",
) -> DataFrame:
    """JN-3, JN-4: adds user and province columns and ``dim_miss``."""
    joined = with_provinces(
        with_users(df, users, as_of=as_of), provinces, iso_3166_2="province_3166_2_code"
    )
    return settle_misses(joined, on_miss)


def enrich_headers(
    headers: DataFrame,
    users: DataFrame,
    provinces: DataFrame,
    *,
    as_of: str | date | None = None,
    on_miss: str = "null",
) -> DataFrame:
    """JN-3, JN-4, FN-10: headers with date parts, user and province columns."""
    return with_dims(with_create_parts(headers), users, provinces, as_of=as_of, on_miss=on_miss)


def wide_columns(header_names: list[str], header: str, line: str) -> list[Column]:
    """PRJ-13: wide columns in record order, from the structs ``header`` and ``line``.

    ``order_id`` and ``create_time`` are the line's own.
    """
    columns = {c: F.col(f"{header}.{c}") for c in header_names if c not in _SHARED}
    columns |= {c: F.col(f"{line}.{c}") for c in ("create_time", *_LINE_ONLY)}
    columns["detail_id"] = F.col(f"{line}.id")
    return [columns[c].alias(c) for c in ORDER_WIDE.fieldNames() if c in columns]


def join_lines_on(
    headers: DataFrame, lines: DataFrame, condition: Column | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """JN-6, JN-9: inner join on the order id and ``condition``; keeps ``extra`` columns."""
    same = F.col("header.id") == F.col("line.order_id")
    joined = headers.alias("header").join(
        lines.alias("line").hint(_NO_BROADCAST), same if condition is None else same & condition, "inner"
    )
    return joined.select(*wide_columns(headers.columns, "header", "line"), *extra)


def join_lines(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """JN-6, JN-9, PRJ-13: one wide row per line whose header exists.

    Inner, so adaptive execution may split the lines of a hot order.
    """
    extra = ("dim_miss",) if "dim_miss" in headers.columns else ()
    return join_lines_on(headers, lines, extra=extra)


def in_record_order(wide: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return wide.select(*ORDER_WIDE.fieldNames(), *extra)


def full_outer(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """JN-5: headers and lines side by side, either side empty if unmatched.

    Written as lines-left-header plus headers without lines.  A direct full outer
    join cannot be split on a hot key; here the lines of a hot order are, and
    the second part meets one distinct key per order.
    """
    left = headers.select(
        F.col("id").alias("header_id"),
        F.col("create_time").alias("header_create_time"),
        *[c for c in headers.columns if c not in _SHARED],
    )
    right = lines.select(
        F.col("id").alias("detail_id"), F.col("create_time").alias("detail_create_time"), *_LINE_ONLY
    )
    matched = right.join(left.hint(_NO_BROADCAST), right["order_id"] == left["header_id"], "left")
    alone = left.join(_order_keys(lines), F.col("header_id") == F.col("_key"), "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def _order_keys(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("order_id").alias("_key")).distinct().hint(_NO_BROADCAST)


def unmatched(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """headers without lines and lines without a header."""
    alone = headers.join(_order_keys(lines), F.col("id") == F.col("_key"), "left_anti").select(
        F.lit("header").alias("side"), F.col("id").alias("order_id"), F.lit(None).cast("bigint").alias("detail_id")
    )
    keys = headers.select(F.col("id").alias("_key")).hint(_NO_BROADCAST)
    orphans = lines.join(keys, F.col("order_id") == F.col("_key"), "left_anti").select(
        F.lit("line").alias("side"), "order_id", F.col("id").alias("detail_id")
    )
    return alone.unionAll(orphans)


def one_per_detail(wide: DataFrame, order: list[str]) -> DataFrame:
    """SNK-9, AGG-3, F10: one wide row per ``(create_date, detail_id)``."""
    return latest_per_key(wide, ["create_date", "detail_id"], order)


def salted(headers: DataFrame, lines: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Spread the lines of an order over ``salts`` join keys, with a header for each.

    For joins that adaptive execution cannot split: stateful streaming joins.
    """
    if salts <= 1:
        one = F.lit(0)
        return headers.withColumn("salt", one), lines.withColumn("salt", one)
    spread = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    every: Column = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    return headers.withColumn("salt", every), lines.withColumn("salt", spread)

