"""Ingest logs: the records of a topic, read and parsed once, judged, and kept with the time of their arrival.

The log is what a job with state reads.  The stamp of a record is that of the micro-batch that first read it and stays with
it, so a job that starts again, without its checkpoint or days later, sees the arrivals it saw before.  Usable and
rejected records leave one query through one sink that commits each batch once, so a batch that is run again adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.json import computed_once, judged
from millrace.sources.tables import make_folder
from millrace.streaming import dau as dau_state
from millrace.streaming.jobs import Run

USABLE, REJECTED = "usable", "rejected"

#: A reason and the condition, on the typed fields and ``arrived``, under which an otherwise usable record is rejected for it.
Gate = tuple[str, Column]


def not_ahead(ahead: str = dau_state.AHEAD) -> Gate:
    """ST-2, D9: rows dated after their arrival by more than ``ahead``."""
    return "future_ts", ~dau_state.plausible(ahead, F.col("arrived"))


@dataclass(frozen=True)
class IngestLog:
    """A folder of one topic's records; ``schema`` is that of a usable one."""

    path: str
    schema: T.StructType

    @property
    def _stored(self) -> T.StructType:
        fixed = T._parse_datatype_string("key string, value string, reject string, arrived timestamp")
        return T.StructType([*fixed.fields, *[T.StructField(f"r_{f.name}", f.dataType) for f in self.schema.fields],
                             T.StructField("kind", T.StringType())])

    def _usable(self, rows: DataFrame) -> DataFrame:
        fields = [F.col(f"r_{n}").alias(n) for n in self.schema.fieldNames()]
        return rows.where(F.col("kind") == USABLE).select("arrived", *fields)

    def stream(self, spark: SparkSession, *, max_files: int | None = None) -> DataFrame:
        """ST-6: usable records with ``arrived``; rejects are another folder, which is not listed for reading."""
        make_folder(spark, self.path)
        reader = spark.readStream.schema(self._stored)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return self._usable(reader.parquet(self.path))

    def usable(self, spark: SparkSession) -> DataFrame:
        return self._usable(self._read(spark))

    def rejected(self, spark: SparkSession) -> DataFrame:
        """D1: ``key, value, reject, arrived`` of the records that no job takes."""
        return self._read(spark).where(F.col("kind") == REJECTED).select("key", "value", "reject", "arrived")

    def accounts(self, spark: SparkSession) -> DataFrame:
        """Records read, usable and rejected by micro-batch: what was read is one of the two."""
        n = F.count(F.lit(1))
        return self._read(spark).groupBy("arrived").agg(
            n.alias("n_read"), F.count_if(F.col("kind") == USABLE).alias("n_usable"), F.count_if(F.col("kind") == REJECTED).alias("n_rejected"))

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._stored).parquet(self.path)


def ingested(raw: DataFrame, schema: T.StructType, gates: Sequence[Gate] = ()) -> DataFrame:
    """``key, value, reject, arrived``, the typed fields as ``r_<name>``, and ``kind``; ``raw`` has ``key, value, arrived``.

    A usable record's text is not kept, nor a rejected one's fields.
    """
    records = judged(raw, schema, keep=("key", "arrived"))
    reason = F.when(F.col("reject").isNotNull(), F.col("reject"))
    for name, refused in gates:
        reason = reason.when(refused, name)
    reason = computed_once(records.withColumn("reject", reason), through=("key", "arrived", "value"))
    good = F.col("reject").isNull()
    return reason.select(
        "key", F.when(~good, F.col("value")).alias("value"), "reject", "arrived",
        *[F.when(good, F.col(n)).alias(f"r_{n}") for n in schema.fieldNames()],
        F.when(good, USABLE).otherwise(REJECTED).alias("kind"))


def start_ingest(raw: DataFrame, log: IngestLog, run: Run, gates: Sequence[Gate] = ()) -> StreamingQuery:
    """PRJ-1, PRJ-2, ST-6: reads a topic into its log: one parse, no shuffle, rejects with their reason."""
    rows = ingested(raw, log.schema, gates)
    reasons = F.count_if(F.col("kind") == REJECTED).alias("n_rejected")
    counted = rows.observe("ingested", F.count(F.lit(1)).alias("n_rows"), reasons)
    writer = counted.writeStream.outputMode("append").format("parquet").option("path", log.path).partitionBy("kind")
    return run.start(writer)
