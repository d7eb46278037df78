from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.dates import as_of_date, date_part, day_of_millis, hour_of_millis, hour_part, whole_years
from millrace.operators import dims
from millrace.operators.dims import miss_report, settle_misses, used_rows, with_provinces, with_users


@pytest.mark.parametrize(
    "born, on, years",
    [
        ("2000-02-29", "2001-02-28", 0),
        ("2000-02-29", "2001-03-01", 1),
        ("1985-08-16", "2024-08-15", 38),
        ("1985-08-16", "2024-08-16", 39),
        ("2030-06-01", "2026-11-30", -3),
        ("2021-02-30", "2024-01-01", None),
        ("", "2024-01-01", None),
        (None, "2024-01-01", None),
    ],
)
def test_whole_years(spark, born, on, years):
    df = spark.createDataFrame([(born,)], "born string")
    assert df.select(whole_years("born", as_of_date(on)).alias("y")).first().y == years


def test_today_is_the_default(spark):
    df = spark.range(1).select((as_of_date(None) == F.current_date()).alias("same"))
    assert df.first().same


def test_day_and_hour(spark):
    df = spark.createDataFrame([(1704067199999, "2020-06-10 17:46:33")], "ts bigint, text string")
    row = df.select(
        day_of_millis("ts").alias("d"),
        hour_of_millis("ts").alias("h"),
        date_part("text").alias("td"),
        hour_part("text").alias("th"),
        hour_part(F.lit("2020-06-10")).alias("none"),
    ).first()
    assert tuple(row) == ("2023-12-31", "23", "2020-06-10", "17", None)


@pytest.fixture
def tables(spark):
    facts = spark.createDataFrame([("1", 10), ("2", 10), ("1", 99), (None, 10)], "user_id string, province_id bigint")
    users = spark.createDataFrame([("1", "F", "2000-01-01")], "id string, gender string, birthday string")
    provinces = spark.createDataFrame(
        [("10", "P", "iso", "cn", "area")],
        "id string, name string, iso_code string, iso_3166_2 string, area_code string",
    )
    return facts, users, provinces


def joined(facts, users, provinces):
    return with_provinces(with_users(facts, users, as_of="2024-06-01"), provinces, iso_3166_2="code")


def test_misses_are_flagged(tables):
    rows = settle_misses(joined(*tables)).collect()
    assert len(rows) == 4
    assert [(r.user_age, r.user_gender, r.code) for r in rows if not r.dim_miss] == [(24, "F", "cn")]
    assert sum(r.dim_miss for r in rows) == 3


def test_miss_policies(tables):
    assert settle_misses(joined(*tables), "drop").count() == 1
    with pytest.raises(Exception, match="dimension row missing"):
        settle_misses(joined(*tables), "error").collect()
    with pytest.raises(ValueError):
        settle_misses(joined(*tables), "other")


def test_miss_report(tables):
    rows = {(r.dim, r.id, r.n_rows) for r in miss_report(*tables).collect()}
    assert rows == {("USER_INFO", "2", 1), ("USER_INFO", None, 1), ("BASE_PROVINCE", "99", 1)}


def test_used_rows_change_no_lookup(tables):
    facts, users, provinces = tables
    more = users.unionAll(users.select(F.lit("55").alias("id"), "gender", "birthday"))
    assert [r.id for r in used_rows(more, facts, "user_id").collect()] == ["1"]
    full = joined(facts, more, provinces).collect()
    assert sorted(map(str, joined(facts, used_rows(more, facts, "user_id"), provinces).collect())) == sorted(map(str, full))


def test_too_many_used_keys_leave_the_dimension_whole(tables, monkeypatch):
    facts, users, _ = tables
    more = users.unionAll(users.select(F.lit("55").alias("id"), "gender", "birthday"))
    monkeypatch.setattr(dims, "MAX_USED_KEYS", 1)
    assert used_rows(more, facts, "user_id").count() == 2
