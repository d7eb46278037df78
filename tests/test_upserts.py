from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter

from millrace.schemas import record
from millrace.sinks import upserts
from millrace.sinks.topics import TopicSink, batch_to_topics, kafka_sink_options
from millrace.sinks.upserts import KeyedTable, run_version
from millrace.sources.streams import TopicSource, kafka_options, read_topic

SCHEMA = record("dt string, id string, v int")


@pytest.fixture
def table(tmp_path):
    return KeyedTable(str(tmp_path / "t"), SCHEMA, keys=("id",), day="dt")


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def content(spark, table):
    return {tuple(r) for r in table.read(spark).select("dt", "id", "v").collect()}


def test_new_table_is_empty(spark, table):
    assert table.read(spark).count() == 0
    assert table.last_version(spark) == -1
    assert table.read_field(spark, "2024-01-01", "id").count() == 0
    assert table.compact(spark) is None


def test_later_versions_win_and_days_stay_apart(spark, table):
    table.upsert(rows(spark, ("d1", "a", 1), ("d2", "a", 2), ("d1", "b", 3)), 0)
    table.upsert(rows(spark, ("d1", "a", 9)), 1)
    assert content(spark, table) == {("d1", "a", 9), ("d2", "a", 2), ("d1", "b", 3)}


def test_writing_a_batch_again_changes_nothing(spark, table):
    for _ in range(2):
        table.upsert(rows(spark, ("d1", "a", 1), ("d1", "b", 2)), 5)
    assert content(spark, table) == {("d1", "a", 1), ("d1", "b", 2)}


def test_compaction_keeps_the_content(spark, table):
    table.upsert(rows(spark, ("d1", "a", 1), ("d2", "b", 1), (None, "n", 1)), 0)
    table.upsert(rows(spark, ("d1", "a", 2)), 1)
    before = content(spark, table)
    assert table.compact(spark) == 1
    assert content(spark, table) == before
    assert table.compact(spark) is None
    table.upsert(rows(spark, ("d2", "b", 7), ("d2", "c", 7), (None, "n", 8)), 2)
    expected = {("d1", "a", 2), ("d2", "b", 7), ("d2", "c", 7), (None, "n", 8)}
    assert content(spark, table) == expected
    assert table.compact(spark) == 2
    assert content(spark, table) == expected


def test_unfinished_compaction_is_ignored(spark, table, tmp_path):
    table.upsert(rows(spark, ("d1", "a", 1)), 0)
    (tmp_path / "t" / "base" / "upto=0").mkdir(parents=True)
    assert content(spark, table) == {("d1", "a", 1)}


def test_seq_orders_rows_of_one_batch(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "s"), SCHEMA, keys=("id",), day="dt", seq="n")
    df = spark.createDataFrame([("d1", "a", 1, 1), ("d1", "a", 2, 2)], "dt string, id string, v int, n int")
    table.upsert(df, 0)
    assert content(spark, table) == {("d1", "a", 2)}


def test_runs_without_checkpoint_get_higher_versions(spark, table, tmp_path):
    """A lost checkpoint is one whose folder, and the note of the run in it, is gone."""
    assert table.next_run(spark, str(tmp_path / "first")) == 0
    table.upsert(rows(spark, ("d1", "a", 1)), run_version(0, 7))
    assert table.next_run(spark, str(tmp_path / "second")) == 1
    table.upsert(rows(spark, ("d1", "a", 2)), run_version(1, 0))
    assert content(spark, table) == {("d1", "a", 2)}
    (tmp_path / "cp").mkdir()
    (tmp_path / "cp" / "metadata").write_text("{}")
    assert table.next_run(spark, str(tmp_path / "cp")) == 1


def test_run_is_kept_over_restarts_without_output(spark, table, tmp_path):
    """A new run whose first batches have no output, restarted: earlier batches stay."""
    first, second = str(tmp_path / "cp0"), str(tmp_path / "cp1")
    run = table.next_run(spark, first)
    for batch, key in enumerate("abc"):
        table.upsert(rows(spark, ("d1", key, 1)), run_version(run, batch))
    assert table.next_run(spark, second) == 1
    (tmp_path / "cp1" / "metadata").write_text("{}")  # batch 0 ran and wrote nothing
    assert table.next_run(spark, second) == 1
    table.upsert(rows(spark, ("d1", "new", 1)), run_version(table.next_run(spark, second), 1))
    assert content(spark, table) == {("d1", k, 1) for k in ("a", "b", "c", "new")}
    assert table.next_run(spark, first) == 0


def test_new_rows_are_seen_after_a_compaction_and_a_restart(spark, table, tmp_path):
    run = table.next_run(spark, str(tmp_path / "cp0"))
    for batch, key in enumerate("abc"):
        table.upsert(rows(spark, ("d1", key, 1)), run_version(run, batch))
    table.compact(spark)
    second = str(tmp_path / "cp1")
    table.next_run(spark, second)
    (tmp_path / "cp1" / "metadata").write_text("{}")
    table.upsert(rows(spark, ("d1", "new", 1)), run_version(table.next_run(spark, second), 1))
    assert content(spark, table) == {("d1", k, 1) for k in ("a", "b", "c", "new")}


def test_batch_being_written_is_not_seen(spark, table, tmp_path):
    table.upsert(rows(spark, ("d1", "a", 1)), 0)
    table.upsert(rows(spark, ("d1", "b", 1)), 1)
    (tmp_path / "t" / "log" / "version=1" / "_SUCCESS").unlink()
    assert content(spark, table) == {("d1", "a", 1)}
    assert table.versions_since_base(spark) == 1
    assert table.compact(spark) == 0
    table.upsert(rows(spark, ("d1", "b", 2)), 1)
    assert content(spark, table) == {("d1", "a", 1), ("d1", "b", 2)}


def test_day_filter_reads_one_folder(spark, table):
    table.upsert(rows(spark, ("d1", "a", 1), ("d2", "a", 2)), 0)
    table.compact(spark)
    plan = table.read_field(spark, "d1", "id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert [r.id for r in table.read_field(spark, "d1", "id").collect()] == ["a"]


def test_topic_folder_replays_in_place(spark, tmp_path):
    sink = TopicSink(path=str(tmp_path / "topics"))
    df = spark.createDataFrame([("T1", "a"), ("T2", "b")], "topic string, value string")
    for _ in range(2):
        batch_to_topics(df, sink, 3)
    read = spark.read.parquet(sink.path)
    assert {(r.topic, r.key, r.value) for r in read.collect()} == {("T1", None, "a"), ("T2", None, "b")}
    assert read.count() == 2


def test_kafka_sink_is_durable():
    options = kafka_sink_options(TopicSink(servers="b:9092", options={"kafka.linger.ms": "5"}))
    assert options == {
        "kafka.bootstrap.servers": "b:9092",
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        "kafka.linger.ms": "5",
    }


def test_kafka_source_positions():
    assert kafka_options(TopicSource("t", servers="b"))["startingOffsets"] == "latest"
    options = kafka_options(
        TopicSource("t", servers="b", offsets={1: 20, 0: 10}, max_per_trigger=5, min_partitions=9)
    )
    assert options["startingOffsets"] == '{"t": {"0": 10, "1": 20}}'
    assert options["subscribe"] == "t"
    assert (options["maxOffsetsPerTrigger"], options["minPartitions"]) == ("5", "9")


def test_a_source_or_sink_needs_a_place(spark):
    with pytest.raises(ValueError):
        read_topic(spark, TopicSource("t"))
    with pytest.raises(ValueError):
        batch_to_topics(spark.createDataFrame([("t", "v")], "topic string, value string"), TopicSink(), 0)


def test_small_log_does_not_shuffle_the_base(spark, table):
    table.upsert(rows(spark, *[("d1", f"k{i}", i) for i in range(100)]), 0)
    table.compact(spark)
    table.upsert(rows(spark, ("d1", "k5", -5)), 1)
    read = table.read(spark)
    text = read._jdf.queryExecution().executedPlan().toString()
    # Only the log is gathered by key; the base meets its keys in a broadcast.
    assert text.count("BroadcastHashJoin") == 1 and "LeftAnti" in text and "SortMergeJoin" not in text
    assert read.count() == 100 and read.where("id = 'k5'").first().v == -5


NUMBERED = "dt string, id string, v int, n int"


def test_rows_of_a_batch_are_chosen_where_they_are_written(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def noted(writer, *args, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    monkeypatch.setattr(upserts, "PIECE_ROWS", 20)
    table = KeyedTable(str(tmp_path / "p"), SCHEMA, keys=("id",), day="dt", seq="n")
    values = [(f"d{i % 2}", f"k{i % 45}", i, i) for i in range(150)]
    values += [(None, "n", 1, 1), (None, "n", 2, 2), ("d0", None, 3, 3), ("d0", None, 4, None), ("d1", "k1", -1, None)]
    df = spark.createDataFrame(values, NUMBERED).repartition(3).persist()
    pieces = table.pieces(df)
    assert pieces == 4
    table.upsert(df, 0, pieces)
    assert plans[-1].count("hashpartitioning") == 1 and "Window" in plans[-1]
    newest = {(d, k): v for d, k, v, n in sorted(values, key=lambda r: -1 if r[3] is None else r[3])}
    assert content(spark, table) == {(*key, v) for key, v in newest.items()}
    assert table.read(spark).count() == len(newest)
    for day in ("d0", "d1"):
        assert 1 <= len(list((tmp_path / "p" / "log" / "version=0" / f"dt={day}").glob("*.parquet"))) <= pieces
    assert table.pieces(df.where("false")) == 1


def test_a_single_batch_is_read_without_a_shuffle(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "one"), SCHEMA, keys=("id",), day="dt", seq="n")
    table.upsert(spark.createDataFrame([("d1", "a", 1, 1), ("d1", "a", 2, 2), ("d2", "a", 3, 1)], NUMBERED), 0)
    assert "Exchange" not in table.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert content(spark, table) == {("d1", "a", 2), ("d2", "a", 3)}
    assert table.read(spark).count() == 2
    table.upsert(spark.createDataFrame([("d1", "a", 5, 1)], NUMBERED), 1)
    assert content(spark, table) == {("d1", "a", 5), ("d2", "a", 3)}
