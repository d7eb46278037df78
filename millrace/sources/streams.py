"""Streaming sources: topics of a broker, or folders that stand for them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import is_folder, spread

#: Columns every stream is normalised to.  ``arrived`` is the clock of the 24 hour tolerance.
#: ``appended`` is the time the source noted (broker time stamp or file time) and only orders records.
#: ``seq`` is the offset within a broker partition, null for folders.
RECORD_COLUMNS = ("key", "value", "arrived", "appended", "seq")


#: ``timestampType`` of records that the broker stamped itself.
LOG_APPEND_TIME = 1


@dataclass(frozen=True)
class TopicSource:
    """Where the records of one topic come from.

    ``servers`` selects the broker; otherwise ``path`` names a folder written by
    :mod:`millrace.sinks.topics` (parquet with ``topic``) or, with ``text=True``,
    a folder of JSON lines.
    """

    topic: str
    servers: str | None = None
    path: str | None = None
    text: bool = False
    #: SRC-2: explicit offsets by partition; used only without a checkpoint.
    offsets: dict[int, int] | None = None
    #: SRC-1: where to start without offsets and without a checkpoint.
    start: str = "latest"
    max_per_trigger: int | None = None
    #: Least number of read tasks; more than the topic's partitions splits large ones.
    min_partitions: int | None = None
    options: dict[str, str] = field(default_factory=dict)
    #: JN-9, ST-6: what ``arrived`` is.  ``read``: the micro-batch that first read the record.
    #: ``append``: its append time, where the source vouches for it; a time stamp that the producer set does not count.
    clock: str = "read"


def read_clock() -> Column:
    """The time of the micro-batch: one for all its records, noted beside its offsets, so a batch that is run again keeps it."""
    return F.current_timestamp()


def _arrived(clock: str, appended: Column, vouched: Column | None = None) -> Column:
    if clock == "read":
        return read_clock()
    if clock != "append":
        raise ValueError("clock must be 'read' or 'append'")
    return appended if vouched is None else F.when(vouched, appended).otherwise(read_clock())


def kafka_options(source: TopicSource) -> dict[str, str]:
    """SRC-1, SRC-2: reader options.

    SRC-3 needs no code: a checkpoint, when present, overrides the start position.
    """
    start = source.start
    if source.offsets:
        start = json.dumps({source.topic: {str(p): o for p, o in sorted(source.offsets.items())}})
    options = {
        "kafka.bootstrap.servers": source.servers or "",
        "subscribe": source.topic,
        "startingOffsets": start,
        "failOnDataLoss": "true",
    }
    if source.max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(source.max_per_trigger)
    if source.min_partitions:
        options["minPartitions"] = str(source.min_partitions)
    return {**options, **source.options}


def read_topic(spark: SparkSession, source: TopicSource) -> DataFrame:
    """SRC-1..5: a stream of ``RECORD_COLUMNS`` with text key and value."""
    if source.servers:
        records = spark.readStream.format("kafka").options(**kafka_options(source)).load()
        return records.select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            _arrived(source.clock, F.col("timestamp"), F.col("timestampType") == LOG_APPEND_TIME).alias("arrived"),
            F.col("timestamp").alias("appended"),
            F.col("offset").alias("seq"),
        )
    if not source.path:
        raise ValueError("a topic source needs servers or a path")
    reader = spark.readStream.options(**source.options)
    if source.max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", source.max_per_trigger)
    written = F.col("_metadata.file_modification_time")
    times = _arrived(source.clock, written).alias("arrived"), written.alias("appended")
    seq = F.lit(None).cast("bigint").alias("seq")
    if source.text:
        lines = reader.text(source.path)
        return lines.select(F.lit(None).cast("string").alias("key"), "value", *times, seq)
    records = reader.schema("key string, value string, topic string").parquet(source.path)
    return records.where(F.col("topic") == source.topic).select("key", "value", *times, seq)


def read_table_stream(
    spark: SparkSession, path: str, *, max_files: int | None = None
) -> DataFrame:
    """A parquet table as a stream, with ``arrived`` (when it was read) and ``appended``; its schema is read once."""
    read = spark.read.parquet(path)
    reader = spark.readStream.schema(read.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if not is_folder(spark, path):
        # A file stream watches folders; a table of one file is picked by name.
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    written = F.col("_metadata.file_modification_time")
    rows = reader.parquet(path).withColumns({"arrived": read_clock(), "appended": written})
    return spread(rows, read)
