from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.functions.json import bind, unbound
from millrace.operators import logs
from millrace.schemas import ACTION_LOG, DISPLAY_LOG, PAGE_LOG, START_LOG

COMMON = {"ar": "1", "uid": "u1", "os": "iOS", "ch": "web", "is_new": "1", "md": "x", "mid": "m1", "vc": "v1", "ba": "b"}
PAGE = {"page_id": "home", "during_time": 7}
START = {"entry": "icon", "open_ad_skip_ms": 1, "open_ad_ms": 2, "loading_time": 3, "open_ad_id": 4}


def record(**parts) -> str:
    return json.dumps({"common": COMMON, "ts": 1000, **parts})


def flat(spark, *values):
    rows = [(str(i), v) for i, v in enumerate(values)]
    return logs.flatten(spark.createDataFrame(rows, "key string, value string"), keep=("key",))


def topics(spark, *values):
    return sorted(r.topic for r in logs.route(flat(spark, *values)).collect())


def test_error_wins_and_keeps_the_record(spark):
    value = record(err={"code": 1}, page=PAGE, start=START)
    f = flat(spark, value)
    assert [r.value for r in logs.error_rows(f).collect()] == [value]
    assert topics(spark, value) == ["DWD_ERROR_LOG_TOPIC"]
    assert logs.page_rows(f).count() == logs.start_rows(f).count() == 0


def test_error_needs_no_other_part(spark):
    assert topics(spark, '{"err":{"code":1}}', '{"err":{},"common":"text"}') == ["DWD_ERROR_LOG_TOPIC"] * 2


def test_null_error_is_no_error(spark):
    assert topics(spark, record(err=None, page=PAGE)) == ["DWD_PAGE_LOG_TOPIC"]


def test_page_and_start_are_independent(spark):
    assert topics(spark, record(page=PAGE, start=START)) == ["DWD_PAGE_LOG_TOPIC", "DWD_START_LOG_TOPIC"]


def test_items_count_only_inside_a_page(spark):
    items = {"displays": [{"item": "1"}], "actions": [{"action_id": "a", "ts": 1}]}
    assert topics(spark, record(**items)) == []
    assert topics(spark, record(page=PAGE, **items)) == [
        "DWD_PAGE_ACTION_TOPIC",
        "DWD_PAGE_DISPLAY_TOPIC",
        "DWD_PAGE_LOG_TOPIC",
    ]


def test_empty_and_absent_arrays_give_no_rows(spark):
    assert topics(spark, record(page=PAGE, displays=[], actions=None)) == ["DWD_PAGE_LOG_TOPIC"]


def test_numbers_and_text_are_coerced(spark):
    value = record(page={**PAGE, "during_time": "12"}, displays=[{"order": 1, "pos_id": 2}], ts="1500")
    row = logs.display_rows(flat(spark, value)).first()
    assert (row.display_order, row.display_pos_id, row.during_time, row.ts) == ("1", "2", 12, 1500)
    value = record(page={**PAGE, "during_time": 3.0})
    assert logs.page_rows(flat(spark, value)).first().during_time == 3


def test_rejects_name_the_reason_and_keep_the_record(spark):
    values = [
        "{bad",
        None,
        "[1]",
        json.dumps({"ts": 1, "page": PAGE}),
        json.dumps({"common": COMMON, "page": PAGE}),
        record(page={"page_id": "home"}),
        record(start={"entry": "icon"}),
        record(page=PAGE, actions=[{"action_id": "a"}]),
        record(page=PAGE, displays=[None]),
        record(page="text"),
    ]
    rows = logs.reject_rows(flat(spark, *values), keep=("key",)).collect()
    got = {int(r.key): (r.reject, r.value) for r in rows}
    reasons = [
        "bad_json",
        "no_value",
        "bad_json",
        "no_common",
        "no_ts",
        "bad_number",
        "bad_number",
        "bad_item",
        "bad_item",
        "bad_json",
    ]
    assert got == {i: (reason, values[i]) for i, reason in enumerate(reasons)}
    assert topics(spark, *values) == ["ODS_LOG_REJECT"] * len(values)


def test_record_columns(spark):
    f = flat(spark, record(page=PAGE, start=START))
    for rows, schema in (
        (logs.page_rows(f), PAGE_LOG),
        (logs.display_rows(f), DISPLAY_LOG),
        (logs.action_rows(f), ACTION_LOG),
        (logs.start_rows(f), START_LOG),
    ):
        assert [(x.name, x.dataType) for x in rows.schema] == [(x.name, x.dataType) for x in schema]


def test_routed_page_binds_to_the_same_row(spark):
    f = flat(spark, record(page={**PAGE, "item": "9", "last_page_id": ""}))
    routed = logs.route(f).where(F.col("topic") == "DWD_PAGE_LOG_TOPIC")
    assert bind(routed, PAGE_LOG).collect() == logs.page_rows(f).collect()
    assert bind(routed, PAGE_LOG).first().last_page_id == ""


def test_bind_defaults_and_refusals(spark):
    df = spark.createDataFrame([('{"mid":"m"}',), ('{"ts":"x"}',), ("{bad",), (None,), ('{"ts":""}',)], "value string")
    rows = bind(df, PAGE_LOG).collect()
    assert [(r.mid, r.ts, r.during_time) for r in rows] == [("m", 0, 0), (None, 0, 0)]
    assert {r.value for r in unbound(df, PAGE_LOG).collect()} == {'{"ts":"x"}', "{bad", None}
