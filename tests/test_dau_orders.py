from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.json import project_by_name
from millrace.operators import dau, orders
from millrace.schemas import ORDER_DETAIL, ORDER_INFO, ORDER_WIDE

HOUR = 3_600_000
DAY = 24 * HOUR


def pages(spark, *rows):
    return spark.createDataFrame(rows, "mid string, last_page_id string, ts bigint, page_id string")


def test_only_a_null_previous_page_starts_a_session(spark):
    df = pages(spark, ("a", None, 1, "p"), ("b", "", 1, "p"), ("c", "home", 1, "p"))
    assert [r.mid for r in dau.session_starts(df).collect()] == ["a"]


def test_first_per_device_and_day(spark):
    df = pages(
        spark,
        ("a", None, DAY + 5, "later"),
        ("a", None, DAY + 1, "x"),
        ("a", None, DAY + 1, "b"),
        ("a", None, 2 * DAY, "next day"),
        ("b", None, 0, "other"),
    )
    got = {(r.dt, r.mid, r.page_id) for r in dau.first_of_day(df, ["page_id"]).collect()}
    assert got == {("1970-01-02", "a", "b"), ("1970-01-03", "a", "next day"), ("1970-01-01", "b", "other")}


def test_written_devices_are_left_out_for_their_day_only(spark):
    df = dau.with_day(pages(spark, ("a", None, 0, "p"), ("a", None, DAY, "p"), ("b", None, 0, "p")))
    written = spark.createDataFrame([("1970-01-01", "a", 5)], "dt string, mid string, ts bigint")
    rest = {("1970-01-02", "a"), ("1970-01-01", "b")}
    assert {(r.dt, r.mid) for r in dau.not_yet_written(df, written).collect()} == rest
    earlier = dau.not_yet_written(df, written, unless_earlier=True).collect()
    assert {(r.dt, r.mid) for r in earlier} == rest | {("1970-01-01", "a")}


def test_project_by_name_skips_what_is_missing(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert project_by_name(df, ["b", "c", "a"], {"a": F.lit(9)}).columns == ["b", "a"]
    assert project_by_name(df, ["a"], {"a": F.lit(9)}).first().a == 9


def header(id, create_time="2024-01-01 10:00:00", **more):
    row = {f.name: None for f in ORDER_INFO}
    return {**row, "id": id, "user_id": 1, "province_id": 1, "create_time": create_time, **more}


def line(id, order_id, create_time="2024-01-02 11:00:00", **more):
    row = {f.name: None for f in ORDER_DETAIL}
    return {**row, "id": id, "order_id": order_id, "create_time": create_time, **more}


@pytest.fixture
def sides(spark):
    headers = spark.createDataFrame([header(1), header(2), header(3)], ORDER_INFO)
    lines = spark.createDataFrame([line(11, 1), line(12, 1), line(21, 2), line(91, 9)], ORDER_DETAIL)
    return headers, lines


def test_wide_takes_line_time_and_header_date(sides):
    headers, lines = sides
    rows = orders.join_lines(orders.with_create_parts(headers), lines).collect()
    assert {(r.detail_id, r.order_id) for r in rows} == {(11, 1), (12, 1), (21, 2)}
    assert {(r.create_time, r.create_date, r.create_hour) for r in rows} == {
        ("2024-01-02 11:00:00", "2024-01-01", "10")
    }
    assert set(rows[0].asDict()) <= set(ORDER_WIDE.fieldNames())


def test_full_outer_equals_the_built_in_join(sides):
    headers, lines = sides
    got = orders.full_outer(headers, lines).select("header_id", "detail_id")
    built_in = headers.alias("h").join(lines.alias("l"), F.col("h.id") == F.col("l.order_id"), "full_outer")
    expected = built_in.select(F.col("h.id").alias("header_id"), F.col("l.id").alias("detail_id"))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_unmatched_sides(sides):
    rows = {tuple(r) for r in orders.unmatched(*sides).collect()}
    assert rows == {("header", 3, None), ("line", 9, 91)}


@pytest.mark.parametrize("salts", [1, 2, 8])
def test_salting_keeps_the_join_whole(sides, salts):
    headers, lines = sides
    left, right = orders.salted(headers, lines, salts)
    joined = left.alias("h").join(
        right.alias("l"), (F.col("h.id") == F.col("l.order_id")) & (F.col("h.salt") == F.col("l.salt"))
    )
    assert sorted(r.id for r in joined.select("l.id").collect()) == [11, 12, 21]


def test_one_row_per_detail_after_replay(spark):
    rows = [("2024-01-01", 1, 1, "old"), ("2024-01-01", 1, 2, "new"), ("2024-01-02", 1, 1, "other day")]
    df = spark.createDataFrame(rows, "create_date string, detail_id bigint, seq int, v string")
    assert {r.v for r in orders.one_per_detail(df, ["seq"]).collect()} == {"new", "other day"}
