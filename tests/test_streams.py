from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import Row

from millrace.functions.json import bind
from millrace.operators import dau
from millrace.plans import streams
from millrace.schemas import DAU_WIDE, PAGE_LOG, TOPIC_LOG_REJECT, TOPIC_PAGE
from millrace.session import ROCKSDB, settings
from millrace.sinks.topics import TopicSink
from millrace.sources.streams import TopicSource, read_topic
from millrace.sources.tables import table_names
from millrace.streaming import jobs
from millrace.streaming.arrival_cache import ArrivalCache
from millrace.streaming.jobs import Run

ONCE = {"availableNow": True}
HOUR = 3_600_000
DAY = 24 * HOUR
BASE = 19_800 * DAY
AS_OF = "2024-06-01"


def source(spark, path, **options):
    return read_topic(spark, TopicSource("t", path=path, text=True, max_per_trigger=1, **options))


def dims(spark):
    users = spark.createDataFrame(
        [(str(i), "F", "2000-01-01") for i in range(5)], "id string, gender string, birthday string"
    )
    provinces = spark.createDataFrame(
        [("1", "P", "iso", "cn", "area")],
        "id string, name string, iso_code string, iso_3166_2 string, area_code string",
    )
    return users, provinces


def page(mid, ts, page_id="p", user="1", last=None):
    row = {"mid": mid, "user_id": user, "province_id": "1", "page_id": page_id, "ts": BASE + ts}
    return json.dumps({**row, **({"last_page_id": last} if last is not None else {})})


def run_dau(spark, path, tmp_path, name, **options):
    table = jobs.dau_table(str(tmp_path / f"{name}-table"))
    query = jobs.start_dau(
        source(spark, path), dims, table, Run(str(tmp_path / f"{name}-cp"), ONCE), as_of=AS_OF, **options
    )
    assert query.awaitTermination(120)
    return table, query


# -- daily-active ------------------------------------------------------------------


def session_pages():
    rng = random.Random(3)
    return [
        page(f"m{rng.randrange(4)}", rng.randrange(3 * DAY), f"p{i}", last=rng.choice([None, None, "home", ""]))
        for i in range(60)
    ]


def test_earliest_equals_batch_in_any_arrival_order(spark, drop_files, tmp_path):
    lines = session_pages()
    values = spark.createDataFrame([(v,) for v in lines], "value string")
    starts = dau.session_starts(bind(values, PAGE_LOG))
    firsts = dau.first_of_day(starts, ["page_id"])
    expected = dau.enrich(firsts, *dims(spark), as_of=AS_OF).select(*DAU_WIDE.fieldNames(), "dim_miss").collect()
    for order in range(2):
        shuffled = random.Random(order).sample(lines, len(lines))
        path = drop_files(f"in{order}", shuffled[:20], shuffled[20:40], shuffled[40:])
        table, _ = run_dau(spark, path, tmp_path, f"e{order}", first="event_time", delay="30 days")
        got = table.read(spark).select(*DAU_WIDE.fieldNames(), "dim_miss").collect()
        assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("salts", [1, 4])
def test_first_to_arrive_is_kept_once_per_day(spark, drop_files, tmp_path, salts):
    path = drop_files(
        "in",
        [page("a", 2 * HOUR, "first"), page("b", 0, "b1")],
        [page("a", 1 * HOUR, "second"), page("b", DAY, "b2"), page("c", 0, "late c", last="home")],
        [page("a", 3 * HOUR, "third")],
    )
    table, query = run_dau(spark, path, tmp_path, "a", salts=salts)
    assert {(r.mid, r.page_id) for r in table.read(spark).collect()} == {("a", "first"), ("b", "b1"), ("b", "b2")}
    # AGG-5: counters before and after the choice.
    assert (jobs.observed(query, "before"), jobs.observed(query, "after")) == (5, 3)
    assert jobs.observed(query, "before", "no_device") == 0


def test_one_hot_device_still_gives_one_row(spark, drop_files, tmp_path):
    path = drop_files("in", *[[page("hot", i * 1000 + j, f"p{i}-{j}") for j in range(200)] for i in range(3)])
    table, query = run_dau(spark, path, tmp_path, "hot", salts=8)
    assert table.read(spark).count() == 1
    final = query.recentProgress[-1]["stateOperators"]
    assert sum(s["numRowsTotal"] for s in final) <= 1 + 8


def test_row_of_a_closed_day_is_dropped_and_counted(spark, drop_files, tmp_path):
    # A day closes for arrivals one batch after its state may go, so none is seen twice.
    path = drop_files(
        "in",
        [page("a", 0)],
        [page("a", 5 * DAY)],
        [page("a", 0, "again"), page("b", 5 * DAY)],
        [page("late", 1 * DAY), page("a", 0, "once more")],
    )
    table, query = run_dau(spark, path, tmp_path, "late", salts=1)
    got = sorted((r.dt, r.mid, r.page_id) for r in table.read(spark).collect())
    assert got == [("2024-03-18", "a", "p"), ("2024-03-23", "a", "p"), ("2024-03-23", "b", "p")]
    assert jobs.dropped_late(query) == 2
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2


def test_restart_from_checkpoint_goes_on(spark, drop_files, tmp_path):
    path = drop_files("in", [page("a", 0, "first")])
    table, _ = run_dau(spark, path, tmp_path, "r")
    drop_files("in", [page("a", HOUR, "second"), page("b", HOUR, "b")])
    table, query = run_dau(spark, path, tmp_path, "r")
    assert {(r.mid, r.page_id) for r in table.read(spark).collect()} == {("a", "first"), ("b", "b")}
    assert query.recentProgress[0]["numInputRows"] == 2


def restarted(spark, path, tmp_path, table, **options):
    run = Run(str(tmp_path / "other-cp"), ONCE)
    query = jobs.start_dau(source(spark, path), dims, table, run, as_of=AS_OF, **options)
    assert query.awaitTermination(120)
    return {(r.mid, r.page_id) for r in table.read(spark).collect()}


def test_restart_without_checkpoint_is_seeded_from_the_table(spark, drop_files, tmp_path):
    path = drop_files("in", [page("a", 2 * HOUR, "first")])
    table, _ = run_dau(spark, path, tmp_path, "s")
    drop_files("in", [page("a", HOUR, "second"), page("a", DAY, "next day"), page("b", HOUR, "b")])
    expected = {("a", "first"), ("a", "next day"), ("b", "b")}
    assert restarted(spark, path, tmp_path, table) == expected
    # The last batch is run again, as after a crash between writing and committing.
    for n in (1, 2):
        (tmp_path / "other-cp" / "commits" / str(n)).unlink(missing_ok=True)
        (tmp_path / "other-cp" / "commits" / f".{n}.crc").unlink(missing_ok=True)
    assert restarted(spark, path, tmp_path, table) == expected


def test_seeded_restart_still_takes_earlier_rows(spark, drop_files, tmp_path):
    path = drop_files("in", [page("a", 2 * HOUR, "late"), page("b", 2 * HOUR, "b")])
    table, _ = run_dau(spark, path, tmp_path, "s", first="event_time")
    path = drop_files("more", [page("a", HOUR, "early"), page("b", 3 * HOUR, "later b")])
    assert restarted(spark, path, tmp_path, table, first="event_time") == {("a", "early"), ("b", "b")}


def test_dimensions_are_read_for_every_batch(spark, drop_files, tmp_path):
    path = drop_files("in", [page("a", 0, user="77")], [page("b", 0, user="77")])
    seen = []

    def changing(session):
        users, provinces = dims(session)
        seen.append(1)
        if len(seen) > 1:
            late = session.createDataFrame([("77", "M", "1990-01-01")], users.schema)
            users = users.unionAll(late)
        return users, provinces

    table = jobs.dau_table(str(tmp_path / "live"))
    query = jobs.start_dau(source(spark, path), changing, table, Run(str(tmp_path / "live-cp"), ONCE), as_of=AS_OF)
    assert query.awaitTermination(120)
    assert {(r.mid, r.dim_miss) for r in table.read(spark).collect()} == {("a", True), ("b", False)}


def test_table_is_compacted_on_the_way(spark, drop_files, tmp_path):
    path = drop_files("in", *[[page("a", n * DAY), page(f"m{n}", n * DAY)] for n in range(4)])
    table = jobs.dau_table(str(tmp_path / "c"))
    run = Run(str(tmp_path / "c-cp"), ONCE, compact_every=3)
    assert jobs.start_dau(source(spark, path), dims, table, run, as_of=AS_OF).awaitTermination(120)
    assert [f.name for f in (tmp_path / "c" / "base").iterdir()] == ["upto=2"]
    assert table.read(spark).count() == 8


def test_batches_without_output_do_not_put_off_compaction(spark, drop_files, tmp_path):
    files = [[page(f"m{n // 2}", n * DAY)] if n % 2 else [page("a", 0)] for n in range(6)]
    table = jobs.dau_table(str(tmp_path / "e"))
    run = Run(str(tmp_path / "e-cp"), ONCE, compact_every=2)
    assert jobs.start_dau(source(spark, drop_files("in", *files)), dims, table, run, as_of=AS_OF).awaitTermination(120)
    assert (tmp_path / "e" / "base").exists()
    assert table.read(spark).count() == 4


def test_unknown_choice_is_refused(spark, drop_files, tmp_path):
    with pytest.raises(ValueError):
        run_dau(spark, drop_files("in", [page("a", 0)]), tmp_path, "x", first="other")


# -- order wide --------------------------------------------------------------------


def header(id, **more):
    return json.dumps(
        {"id": id, "user_id": 1, "province_id": 1, "create_time": "2024-01-01 10:00:00", "total_amount": 5.5, **more}
    )


def line(id, order_id, **more):
    return json.dumps(
        {"id": id, "order_id": order_id, "sku_num": 2, "create_time": "2024-01-02 11:00:00", **more}
    )


def run_orders(spark, headers, lines, tmp_path, name, cached=False, **options):
    table = jobs.order_table(str(tmp_path / f"{name}-table"))
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        query = jobs.start_order_wide(
            source(spark, headers),
            source(spark, lines),
            dims,
            table,
            Run(str(tmp_path / f"{name}-cp"), ONCE),
            cached=cached,
            as_of=AS_OF,
            **options,
        )
        if cached:
            jobs.drain(query, timeout=180)
        else:
            assert query.awaitTermination(180)
    return table


@pytest.mark.parametrize("cached, salts", [(False, 1), (False, 4), (True, 1), (True, 3)])
def test_sides_meet_across_batches(spark, drop_files, tmp_path, cached, salts):
    # Order 1: header first.  Order 2: lines first.  Order 3: together.  4 and 9: alone.
    headers = drop_files("h", [header(1), header(4)], [header(3)], [header(2)])
    lines = drop_files(
        "l", [line(21, 2), line(22, 2)], [line(31, 3), line(11, 1)], [line(12, 1), line(23, 2), line(91, 9)]
    )
    table = run_orders(spark, headers, lines, tmp_path, "o", cached=cached, salts=salts)
    rows = table.read(spark).collect()
    assert sorted((r.order_id, r.detail_id) for r in rows) == [(1, 11), (1, 12), (2, 21), (2, 22), (2, 23), (3, 31)]
    assert {(r.create_date, r.create_hour, r.create_time, r.user_age, r.province_name, r.dim_miss) for r in rows} == {
        ("2024-01-01", "10", "2024-01-02 11:00:00", 24, "P", False)
    }
    assert {(r.total_amount, r.sku_num, r.split_total_amount, r.feight_fee) for r in rows} == {(5.5, 2, 0.0, 0.0)}


def test_result_does_not_depend_on_the_order_of_files(spark, drop_files, tmp_path):
    files = [[header(1)], [header(2)]]
    line_files = [[line(11, 1)], [line(21, 2), line(12, 1)]]
    results = set()
    arrivals = list(itertools.product(itertools.permutations(files), itertools.permutations(line_files)))
    for n, (hs, ls) in enumerate(arrivals[1:3]):
        h, l = drop_files(f"h{n}", *hs), drop_files(f"l{n}", *ls)
        table = run_orders(spark, h, l, tmp_path, f"p{n}", salts=2)
        results.add(tuple(sorted(str(r) for r in table.read(spark).collect())))
    assert len(results) == 1 and len(next(iter(results))) == 3


def test_replayed_lines_change_nothing_by_key(spark, drop_files, tmp_path):
    headers = drop_files("h", [header(1)], [header(1)])
    lines = drop_files("l", [line(11, 1)], [line(11, 1), line(12, 1)])
    table = run_orders(spark, headers, lines, tmp_path, "re")
    assert sorted(r.detail_id for r in table.read(spark).collect()) == [11, 12]


def test_table_streams_store_the_changes_of_a_join_not_copies_of_its_state(spark, drop_files, tmp_path):
    headers, lines = drop_files("h", [header(1)], [header(2)]), drop_files("l", [line(21, 2)], [line(11, 1)])
    table = jobs.order_table(str(tmp_path / "t"))
    with settings(spark, streams._state(spark)):
        query = jobs.start_order_wide(
            source(spark, headers), source(spark, lines), dims, table, Run(str(tmp_path / "cp"), ONCE), as_of=AS_OF
        )
        assert query.awaitTermination(180)
    assert sorted((r.order_id, r.detail_id) for r in table.read(spark).collect()) == [(1, 11), (2, 21)]
    state = tmp_path / "cp" / "state"
    # The first batch is kept whole as well.
    assert list(state.rglob("2.changelog")) and {f.name for f in state.rglob("*.zip")} == {"1.zip"}


def test_header_sent_again_reaches_its_cached_lines(spark, drop_files, tmp_path):
    headers = drop_files("h", [], [header(1, total_amount=1.0)], [header(1, total_amount=2.0)])
    lines = drop_files("l", [line(11, 1), line(12, 1)])
    table = run_orders(spark, headers, lines, tmp_path, "again", cached=True, salts=2)
    assert {(r.detail_id, r.total_amount) for r in table.read(spark).collect()} == {(11, 2.0), (12, 2.0)}


# -- log and change split ---------------------------------------------------------------


def log(mid, **parts):
    return json.dumps({"common": {"mid": mid, "uid": "1", "ar": "1"}, "ts": BASE, **parts})


def test_log_topics_feed_the_daily_active_job(spark, drop_files, tmp_path):
    home = {"page_id": "home", "during_time": 1}
    path = drop_files(
        "in", [log("a", page=home), "{bad"], [log("a", page=home), log("b", page={**home, "last_page_id": "x"})]
    )
    sink = TopicSink(path=str(tmp_path / "topics"))
    query = jobs.start_log_split(source(spark, path), sink, Run(str(tmp_path / "cp"), ONCE))
    assert query.awaitTermination(120)
    assert jobs.observed(query, "routed") == 4
    counts = {r.topic: r["count"] for r in spark.read.parquet(sink.path).groupBy("topic").count().collect()}
    assert counts == {TOPIC_PAGE: 3, TOPIC_LOG_REJECT: 1}

    table = jobs.dau_table(str(tmp_path / "dau"))
    read = read_topic(spark, TopicSource(TOPIC_PAGE, path=sink.path))
    query = jobs.start_dau(read, dims, table, Run(str(tmp_path / "dau-cp"), ONCE), as_of=AS_OF)
    assert query.awaitTermination(120)
    assert [r.mid for r in table.read(spark).collect()] == ["a"]


def test_change_split_feeds_facts_and_dimensions(spark, drop_files, tmp_path):
    def change(kind, table, **data):
        return json.dumps({"type": kind, "table": table, "data": data})

    path = drop_files(
        "in",
        [
            change("insert", "user_info", id=1, gender="F", birthday="2000-01-01"),
            change("update", "user_info", id=1, gender="M", birthday="2000-01-01"),
            change("insert", "order_info", id=5),
            change("bootstrap-start", "order_info", id=6),
            "{bad",
        ],
        [
            change("delete", "user_info", id=1, gender="M", birthday="2000-01-09"),
            change("bootstrap-insert", "base_province", id=1, name="P", iso_code="i", iso_3166_2="c", area_code="a"),
            change("delete", "order_info", id=5),
            change("insert", "added_later", id=1),
        ],
    )
    calls = []

    def tables(session):
        calls.append(1)
        facts = ["order_info"] if len(calls) == 1 else ["order_info", "added_later"]
        return table_names(session, facts), table_names(session, ["user_info", "base_province"])

    sink = TopicSink(path=str(tmp_path / "topics"))
    table = jobs.dim_table(str(tmp_path / "dims"))
    query = jobs.start_change_split(source(spark, path), sink, table, tables, Run(str(tmp_path / "cp"), ONCE))
    assert query.awaitTermination(120)
    facts = {(r.topic, json.loads(r.value)["id"]) for r in spark.read.parquet(sink.path).collect()}
    assert facts == {("DWD_ORDER_INFO_I", 5), ("DWD_ORDER_INFO_D", 5), ("DWD_ADDED_LATER_I", 1)}
    users, provinces = jobs.dims_from(table)(spark)
    assert [tuple(r) for r in users.collect()] == [("1", "M", "2000-01-09")]
    assert [r.name for r in provinces.collect()] == ["P"]
    table.compact(spark)
    assert [r.birthday for r in jobs.dims_from(table)(spark)[0].collect()] == ["2000-01-09"]


def test_state_functions_keep_rows_without_device_out(spark, drop_files, tmp_path):
    path = drop_files("in", [json.dumps({"ts": BASE, "page_id": "p"}), page("a", 0)])
    table, query = run_dau(spark, path, tmp_path, "nodev")
    assert [r.mid for r in table.read(spark).collect()] == ["a"]
    assert jobs.observed(query, "before", "no_device") == 1


def test_cached_join_takes_plain_rows_in_chunks(monkeypatch):
    """An order costs no frame of its own, and one of any size is not gathered."""
    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, new):
            self.kept = new

    class Lines(dict):
        def iterator(self):
            return iter(list(self.items()))

        updateValue = dict.__setitem__

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return Lines()

    taken = []

    def rows(*records):
        for line_id, record in records:
            taken.append(record)
            yield Row(order_key=1, salt=0, line_id=line_id, record=record)

    monkeypatch.setattr(ArrivalCache, "CHUNK", 2)
    cache = ArrivalCache(None)
    cache.init(Handle())
    pairs = cache.handleInputRows((1, 0), rows(("1", "l1"), ("2", "l2"), ("3", "l3"), (None, "h1"), ("4", "l4")), None)
    assert next(pairs) == Row(header="h1", line="l1")
    assert taken == ["l1", "l2", "l3", "h1"]
    assert [r.line for r in pairs] == ["l2", "l3", "l4"]
    assert list(cache.handleInputRows((1, 0), rows(("5", "l5"), (None, "h2")), None)) == [
        Row(header="h2", line=n) for n in ("l1", "l2", "l5")]


class Maps:
    """Map states of one group, with the requests that change them counted."""

    def __init__(self):
        self.made, self.requests = {}, []

    def getMapState(self, name, *_):
        def update(key, value):
            self.requests.append(name)
            state[key] = value

        state = self.made.setdefault(name, {})
        return type("State", (), {"iterator": lambda _: iter(list(state.items())), "updateValue": lambda _, *a: update(*a)})()


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def arrivals(*rows):
    return (Row(order_key=order, line_id=line_id, record=record) for order, line_id, record in rows)


def test_orders_of_a_group_share_its_cost_and_nothing_else():
    maps = Maps()
    cache = ArrivalCache(None)
    cache.init(maps)
    headers = [(order, None, f"h{order}") for order in range(160)]
    early = [(order, f"{order}", f"l{order}") for order in (7, 8, 500)]
    assert list(cache.handleInputRows(("0",), arrivals(*early), None)) == []
    got = list(cache.handleInputRows(("0",), arrivals(*headers, (7, "x", "lx"), (159, "y", "ly"), (None, "z", "lz")), None))
    assert sorted(got) == [("h159", "ly"), ("h7", "l7"), ("h7", "lx"), ("h8", "l8")]
    # A request for each page of headers, not for each header.
    assert maps.requests.count("headers") == 10 and maps.requests.count("lines") == 4
    got = list(cache.handleInputRows(("0",), arrivals((3, "a", "la"), (500, None, "h500"), (7, None, "new"), (8, "b", "lb")), None))
    assert sorted(got) == [("h3", "la"), ("h500", "l500"), ("h8", "lb"), ("new", "l7")]


def test_a_header_expires_a_day_after_its_own_last_write():
    cache = ArrivalCache(DAY)
    cache.init(Maps())
    assert list(cache.handleInputRows(("0",), arrivals((1, None, "h1"), (2, None, "h2"), (3, None, "h3")), At(BASE))) == []
    assert list(cache.handleInputRows(("0",), arrivals((2, None, "again")), At(BASE + 20 * HOUR))) == []
    lines = [(order, f"{order}", f"l{order}") for order in (1, 2, 3)]
    late = list(cache.handleInputRows(("0",), arrivals(*lines), At(BASE + 23 * HOUR)))
    assert sorted(late) == [("again", "l2"), ("h1", "l1"), ("h3", "l3")]
    assert list(cache.handleInputRows(("0",), arrivals(*lines), At(BASE + 25 * HOUR))) == [("again", "l2")]


def test_cached_join_over_many_orders_and_batches(spark, drop_files, tmp_path):
    ids = [*range(1, 40), 2**53 + 1, 2**53 + 2]
    headers = drop_files("h", [header(i, total_amount=float(i % 97)) for i in ids[::2]], [], [header(i, total_amount=float(i % 97)) for i in ids[1::2]])
    lines = drop_files("l", [line(10 * n, i) for n, i in enumerate(ids)], [line(10 * n + 1, i) for n, i in enumerate(ids)])
    table = run_orders(spark, headers, lines, tmp_path, "many", cached=True, salts=2)
    got = sorted((r.order_id, r.detail_id, r.total_amount) for r in table.read(spark).collect())
    assert got == sorted((i, 10 * n + k, float(i % 97)) for n, i in enumerate(ids) for k in (0, 1))
