from __future__ import annotations

import json

import pytest

from millrace.operators import cdc
from millrace.operators.dims import user_dim
from millrace.sources.tables import table_names


def change(kind, table, **data):
    return json.dumps({"type": kind, "table": table, "data": data or None})


def feed(spark, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq bigint, value string")


@pytest.mark.parametrize(
    "kind, op",
    [("bootstrap-insert", "I"), ("insert", "I"), ("update", "U"), ("delete", "D"), ("bootstrap-start", None), (None, None)],
)
def test_ops(spark, kind, op):
    rows = cdc.changes(feed(spark, change(kind, "t", id=1))).collect()
    assert [r.op for r in rows] == ([op] if op else [])


def test_bad_changes_are_listed(spark):
    values = ["{bad", None, change("insert", None, id=1), change("insert", "t"), change("bootstrap-start", "t")]
    bad = cdc.bad_changes(feed(spark, *values)).collect()
    assert {r.value for r in bad} == set(values[:4])
    assert cdc.changes(feed(spark, *values)).count() == 0


def test_fact_topics_and_payload(spark):
    data = {"id": 12345678901234567890123, "note": None, "nested": {"a": [1, 2]}}
    changed = cdc.changes(feed(spark, change("update", "order_info", **data)))
    row = cdc.fact_records(changed, table_names(spark, ["order_info"]), key="id").first()
    assert row.topic == "DWD_ORDER_INFO_U"
    assert row.key == "12345678901234567890123"
    assert json.loads(row.value) == data


def test_table_in_both_lists_goes_both_ways(spark):
    changed = cdc.changes(feed(spark, change("insert", "t", id=1)), keep=("seq",))
    both = table_names(spark, ["t"])
    assert cdc.fact_records(changed, both).count() == cdc.dim_changes(changed, both).count() == 1


def test_table_names_are_case_sensitive(spark):
    changed = cdc.changes(feed(spark, change("insert", "ORDER_INFO", id=1)))
    assert cdc.fact_records(changed, table_names(spark, ["order_info"])).count() == 0


def test_empty_list_keeps_nothing(spark):
    changed = cdc.changes(feed(spark, change("insert", "t", id=1)))
    assert cdc.fact_records(changed, table_names(spark, ["x"]).where("false")).count() == 0


def test_long_list_is_joined_with_the_same_result(spark, monkeypatch):
    values = [change("insert", t, id=1) for t in ("a", "b", "c", "a")]
    changed = cdc.changes(feed(spark, *values))
    names = table_names(spark, ["a", "c", "d"])
    short = sorted(r.topic for r in cdc.fact_records(changed, names).collect())
    monkeypatch.setattr(cdc, "MAX_LITERAL_NAMES", 2)
    assert sorted(r.topic for r in cdc.fact_records(changed, names).collect()) == short == [
        "DWD_A_I",
        "DWD_A_I",
        "DWD_C_I",
    ]


def test_delete_stores_the_image_and_the_last_one_wins(spark):
    values = [
        change("insert", "user_info", id=7, gender="F", birthday="2000-01-01"),
        change("delete", "user_info", id=7, gender="M", birthday="2000-01-02"),
        change("insert", "user_info", id=8, gender="F", birthday="2001-01-01"),
    ]
    changed = cdc.changes(feed(spark, *values), keep=("seq",))
    log = cdc.dim_changes(changed, table_names(spark, ["user_info"]), keep=("seq",))
    users = user_dim(cdc.current_dims(log, ["seq"])).collect()
    assert {(r.id, r.gender, r.birthday) for r in users} == {("7", "M", "2000-01-02"), ("8", "F", "2001-01-01")}


def test_key_and_fields_come_from_one_parse_of_the_image(spark):
    values = [change("insert", "t", id=7, create_time="2024-01-01", extra={"id": 1}), change("update", "t", extra=None, create_time=None)]
    facts = cdc.fact_records(cdc.changes(feed(spark, *values)), table_names(spark, ["t"]), key="id", fields=("create_time",))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("json_tuple(") == 1 and "get_json_object" not in plan
    assert {(r.topic, r.key, r.create_time) for r in facts.collect()} == {("DWD_T_I", "7", "2024-01-01"), ("DWD_T_U", None, None)}
