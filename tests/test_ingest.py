"""Arrival clock, ingest logs, rejects of the jobs, clocks that run ahead."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions.json import judged
from millrace.schemas import ORDER_DETAIL, ORDER_INFO, PAGE_LOG, TOPIC_DB_REJECT
from millrace.sinks.topics import TopicSink
from millrace.sources.streams import TopicSource, read_topic
from millrace.sources.tables import drop_newest, table_names
from millrace.streaming import ingest, jobs
from millrace.streaming.ingest import IngestLog, start_ingest
from millrace.streaming.jobs import Run
from tests.test_streams import AS_OF, BASE, DAY, HOUR, ONCE, dims, header, line, page, run_dau, source

YEAR_5138 = 99_999_999_999_999


def put_back(path, days):
    """Files of ``path`` as if written ``days`` ago, each a day after the other."""
    for n, name in enumerate(sorted(os.listdir(path))):
        then = time.time() - (days - n) * 86_400
        os.utime(os.path.join(path, name), (then, then))
    return path


def orders_of(spark, headers, lines, tmp_path, name, clock):
    table = jobs.order_table(str(tmp_path / f"{name}-table"))
    query = jobs.start_order_wide(
        source(spark, headers, clock=clock), source(spark, lines, clock=clock), dims, table, Run(str(tmp_path / f"{name}-cp"), ONCE), as_of=AS_OF
    )
    assert query.awaitTermination(180)
    return sorted(r.detail_id for r in table.read(spark).collect())


def test_join_by_reading_takes_files_days_apart(spark, drop_files, tmp_path):
    headers = put_back(drop_files("h", [header(1)], [header(2)]), 20)
    lines = put_back(drop_files("l", [line(11, 1), line(21, 2)], [line(12, 1)]), 3)
    assert orders_of(spark, headers, lines, tmp_path, "read", "read") == [11, 12, 21]
    # by the files' own times, both sides are too far apart
    assert orders_of(spark, headers, lines, tmp_path, "append", "append") == []


def test_unknown_clock(spark, tmp_path):
    with pytest.raises(ValueError, match="clock"):
        read_topic(spark, TopicSource("t", path=str(tmp_path), text=True, clock="guess"))


def test_reasons(spark):
    values = ['{"ts":1}', '{"ts":"x"}', "{bad", None, '{"ts":""}', '{"mid":7}']
    rows = judged(spark.createDataFrame([(v,) for v in values], "value string"), PAGE_LOG).collect()
    assert [(r.value, r.reject) for r in rows] == list(zip(values, [None, "bad_number", "bad_json", "no_value", None, None], strict=True))


@pytest.mark.parametrize("first", ["arrival", "event_time"])
def test_one_clock_ahead_closes_no_real_day(spark, drop_files, tmp_path, first):
    ahead = json.dumps({"mid": "z", "user_id": "1", "province_id": "1", "page_id": "p", "ts": YEAR_5138})
    path = drop_files("in", [page("a", 0), ahead], [page("b", HOUR)], [page("c", 2 * DAY)], [page("d", DAY + HOUR)])
    table, query = run_dau(spark, path, tmp_path, first, first=first, delay="72 hours")
    assert sorted(r.mid for r in table.read(spark).collect()) == ["a", "b", "c", "d"]
    assert jobs.dropped_late(query) == 0 and jobs.observed(query, "before", "implausible") == 1


def test_watermark_drops_are_counted(spark, drop_files, tmp_path):
    path = drop_files("in", [page("a", 9 * DAY)], [page("b", 9 * DAY)], [page("late", 0)])
    table, query = run_dau(spark, path, tmp_path, "late", salts=1)
    assert sorted(r.mid for r in table.read(spark).collect()) == ["a", "b"] and jobs.dropped_late(query) == 1


PAGES = [
    [page("a", 0), "{bad", page("b", 0)],
    [json.dumps({"mid": "c", "ts": "soon"}), page("a", HOUR)],
    [json.dumps({"mid": "d", "ts": YEAR_5138}), page("e", HOUR, last="home"), json.dumps({"ts": BASE})],
]


def ingest_pages(spark, drop_files, tmp_path):
    log = IngestLog(str(tmp_path / "log"), PAGE_LOG)
    path = drop_files("in", *PAGES)
    run = Run(str(tmp_path / "ingest-cp"), ONCE)

    def start():
        query = start_ingest(source(spark, path), log, run, [ingest.not_ahead()])
        assert query.awaitTermination(120)
        return query

    return log, start


def test_every_record_is_usable_or_rejected(spark, drop_files, tmp_path):
    log, start = ingest_pages(spark, drop_files, tmp_path)
    query = start()
    lines = [v for file in PAGES for v in file]
    assert jobs.observed(query, "ingested") == len(lines) and jobs.observed(query, "ingested", "n_rejected") == 3
    assert {(r.value, r.reject) for r in log.rejected(spark).collect()} == {
        ("{bad", "bad_json"), (PAGES[1][0], "bad_number"), (PAGES[2][0], "future_ts")}
    assert sorted(r.mid or "" for r in log.usable(spark).collect()) == ["", "a", "a", "b", "e"]
    counts = log.accounts(spark).orderBy("arrived").collect()
    assert [(r.n_read, r.n_usable, r.n_rejected) for r in counts] == [(3, 2, 1), (2, 1, 1), (3, 2, 1)]
    assert all(r.n_read == r.n_usable + r.n_rejected for r in counts)


def test_a_batch_that_runs_again_adds_nothing_and_keeps_its_stamp(spark, drop_files, tmp_path):
    log, start = ingest_pages(spark, drop_files, tmp_path)
    start()
    before = sorted(map(str, log.usable(spark).collect()))
    stamps = sorted(r.arrived for r in log.accounts(spark).collect())
    drop_newest(spark, str(tmp_path / "ingest-cp" / "commits"))
    start()
    assert sorted(map(str, log.usable(spark).collect())) == before
    assert sorted(r.arrived for r in log.accounts(spark).collect()) == stamps


def test_daily_active_from_a_log_twice(spark, drop_files, tmp_path):
    log, start = ingest_pages(spark, drop_files, tmp_path)
    start()
    table = jobs.dau_table(str(tmp_path / "dau"))
    for checkpoint in ("one", "two"):  # the second has lost its checkpoint
        query = jobs.start_dau(log.stream(spark, max_files=1), dims, table, Run(str(tmp_path / checkpoint), ONCE), as_of=AS_OF, bound=True)
        assert query.awaitTermination(120)
        assert sorted(r.mid for r in table.read(spark).collect()) == ["a", "b"]


def test_order_wide_from_logs(spark, drop_files, tmp_path):
    logs = {}
    feeds = {"h": (ORDER_INFO, [[header(1), "{"], [header(2)]]), "l": (ORDER_DETAIL, [[line(21, 2), line(31, 3)], [line(11, 1), line(12, "x")]])}
    for name, (schema, files) in feeds.items():
        logs[name] = IngestLog(str(tmp_path / f"{name}-log"), schema)
        raw = source(spark, put_back(drop_files(name, *files), 40))
        assert start_ingest(raw, logs[name], Run(str(tmp_path / f"{name}-in"), ONCE)).awaitTermination(120)
    table = jobs.order_table(str(tmp_path / "wide"))
    query = jobs.start_order_wide(
        logs["h"].stream(spark, max_files=1), logs["l"].stream(spark, max_files=1), dims, table, Run(str(tmp_path / "cp"), ONCE), as_of=AS_OF, bound=True)
    assert query.awaitTermination(180)
    assert sorted(r.detail_id for r in table.read(spark).collect()) == [11, 21]
    assert [r.reject for n in "hl" for r in logs[n].rejected(spark).collect()] == ["bad_json", "bad_number"]


@pytest.mark.parametrize("given", [True, False])
def test_change_split_keeps_its_rejects(spark, drop_files, tmp_path, given):
    good = json.dumps({"type": "insert", "table": "order_info", "data": {"id": 5}})
    bad = ["{bad", json.dumps({"type": "insert", "data": {"id": 6}}), json.dumps({"type": "update", "table": "order_info"})]
    unwanted = json.dumps({"type": "bootstrap-start"})
    path = drop_files("in", [good, bad[0]], [bad[1], unwanted, bad[2]])
    sink, rejects = TopicSink(path=str(tmp_path / "topics")), TopicSink(path=str(tmp_path / "bad"))
    query = jobs.start_change_split(
        source(spark, path), sink, jobs.dim_table(str(tmp_path / "dims")),
        lambda s: (table_names(s, ["order_info"]), table_names(s, ["user_info"])), Run(str(tmp_path / "cp"), ONCE), rejects=rejects if given else None)
    assert query.awaitTermination(120)
    assert spark.read.parquet(sink.path).count() == 1
    kept = spark.read.parquet(rejects.path if given else f"{sink.path}-rejects")
    assert sorted((r.topic, r.key, r.value) for r in kept.select("topic", "key", "value").collect()) == sorted(
        (TOPIC_DB_REJECT, k, v) for k, v in zip(["bad_json", "no_table", "no_data"], bad, strict=True))


def test_log_without_rows(spark, tmp_path):
    log = IngestLog(str(tmp_path / "none"), PAGE_LOG)
    os.makedirs(log.path)
    assert log.usable(spark).count() == log.rejected(spark).count() == log.accounts(spark).count() == 0
    assert log.stream(spark).isStreaming
    assert ingest.ingested(spark.createDataFrame([], "key string, value string, arrived timestamp"), PAGE_LOG).select(F.count(F.lit(1))).first()[0] == 0
