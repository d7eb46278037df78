"""Topic sinks: a broker, or a folder partitioned by topic."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


@dataclass(frozen=True)
class TopicSink:
    """Where ``(topic, key, value)`` rows go: ``servers`` of a broker or a ``path``."""

    servers: str | None = None
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def kafka_sink_options(sink: TopicSink) -> dict[str, str]:
    """SNK-5: writes are acknowledged by all replicas and not repeated on retry."""
    return {
        "kafka.bootstrap.servers": sink.servers or "",
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        **sink.options,
    }


def records(rows: DataFrame) -> DataFrame:
    """SNK-1, SNK-2: rows as ``(topic, key, value)``; the key may be absent."""
    key = F.col("key").cast("string") if "key" in rows.columns else F.lit(None).cast("string")
    return rows.select("topic", key.alias("key"), F.col("value").cast("string").alias("value"))


def stream_to_topics(rows: DataFrame, sink: TopicSink) -> DataStreamWriter:
    """SNK-3, SNK-4: one query feeds all topics, by the ``topic`` column."""
    out = records(rows).writeStream.outputMode("append")
    if sink.servers:
        return out.format("kafka").options(**kafka_sink_options(sink))
    if not sink.path:
        raise ValueError("a topic sink needs servers or a path")
    return out.format("parquet").option("path", sink.path).partitionBy("topic")


def batch_to_topics(rows: DataFrame, sink: TopicSink, version: int) -> None:
    """The same for one batch inside ``foreachBatch``.

    A folder sink keeps each batch under its own version, so writing a batch again
    replaces it; a broker gets it at least once.
    """
    out = records(rows)
    if sink.servers:
        out.write.format("kafka").options(**kafka_sink_options(sink)).save()
        return
    if not sink.path:
        raise ValueError("a topic sink needs servers or a path")
    target = f"{sink.path}/version={version}"
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("topic")
        .parquet(target)
    )
