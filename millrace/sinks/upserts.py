"""Keyed tables: replay-safe upserts on plain parquet.

A batch is written once, under its version, and never rewritten by later
batches; readers take the newest row of every key.  Writing a batch again
replaces its own folder, so a replay changes nothing.  Compaction folds old
versions into a new base, for the days they touch, beside what is there: no file
is overwritten while it is read.

    <path>/log/version=<v>/<day>=.../    rows of one batch
    <path>/base/upto=<v>/<day>=.../      current rows of a day after version v
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.keyed import latest_per_key
from millrace.session import settings
from millrace.sources.tables import exists, make_folder, sub_folders

#: A restart without its checkpoint counts batches from zero again; versions of a
#: later run must still be higher.
VERSIONS_PER_RUN = 10**12

#: Rows of a day that one task sorts and writes.
PIECE_ROWS = 500_000

_MERGE_SIZE = "spark.sql.adaptive.coalescePartitions.minPartitionSize"

#: Folder name Spark gives rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def run_version(run: int, batch_id: int) -> int:
    return run * VERSIONS_PER_RUN + batch_id


@dataclass(frozen=True)
class KeyedTable:
    """SNK-7: a table of at most one current row per ``(day, key)``.

    ``day`` is a column of every row, so a batch that mixes days files each row
    under its own (D3).  ``seq`` orders rows of one batch; without it they must
    be unique by key already.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    day: str
    seq: str | None = None

    @property
    def key_columns(self) -> list[str]:
        return list(dict.fromkeys([self.day, *self.keys]))

    def upsert(self, rows: DataFrame, version: int, pieces: int | None = None) -> None:
        """Write one batch; rows of higher versions win over lower ones.

        Given ``pieces``, each day goes to so many tasks, by key, which choose its rows and write them: one shuffle
        instead of two, but repeated rows of a key are all shuffled.
        """
        names, target = self.schema.fieldNames(), f"{self.path}/log/version={version}"
        if self.seq:
            extra = [] if self.seq in names else [self.seq]
            rows = rows.select(*names, *extra)
        if self.seq and pieces:
            piece = F.pmod(F.xxhash64(*self.key_columns), F.lit(pieces))
            # A key has one piece, so the window asks for no shuffle of its own.
            gathered = rows.withColumn("_piece", piece).hint("rebalance", F.col(self.day), F.col("_piece"))
            chosen = latest_per_key(gathered, ["_piece", *self.key_columns], [self.seq])
            self._write(chosen.select(*names), target, gathered=True)
            return
        if self.seq:
            rows = latest_per_key(rows, self.key_columns, [self.seq])
        self._write(rows.select(*names), target)

    def pieces(self, rows: DataFrame) -> int:
        """For :meth:`upsert`, from rows that are held: pieces of about ``PIECE_ROWS`` rows of the largest day."""
        largest = rows.groupBy(self.day).count().agg(F.max("count")).first()[0] or 0
        return max(1, -(-largest // PIECE_ROWS))

    def read(self, spark: SparkSession) -> DataFrame:
        """SNK-7..9: the newest row of every key; filters on the day prune folders.

        Rows of the last compaction are kept unless the log has their key.  While the
        log is small its keys are broadcast, by Spark's own check of their size, and
        the base is not shuffled.
        """
        base, log = self._base(spark), self._log(spark)
        if log is None:
            return self._empty(spark) if base is None else base.drop("version")
        if base is None:
            # One batch has a row of a key, by its own choice.
            return log.drop("version") if self.seq and len(self._versions(spark)) == 1 else self._newest(log)
        return self._merged(base, log)

    def read_field(self, spark: SparkSession, day: str, field: str) -> DataFrame:
        """SRC-8: one field of all rows of a day; empty if there are none; no cap (D4)."""
        return self.read(spark).where(F.col(self.day) == day).select(field)

    def compact(self, spark: SparkSession) -> int | None:
        """Fold the log into a new base of the days it touches; returns its version."""
        versions = self._versions(spark)
        log = self._log(spark)
        if log is None:
            return None
        upto = max(map(_number, versions))
        base = self._base(spark)
        if base is None:
            rows = self._newest(log)
        else:
            rows = self._merged(base.where(self._on_days(self._days(log))), log)
        self._write(rows, f"{self.path}/base/upto={upto}")
        return upto

    def last_version(self, spark: SparkSession) -> int:
        """Highest version present, -1 for a new table."""
        log = [_number(name) for name in sub_folders(spark, f"{self.path}/log")]
        return max([-1, *log, *self._bases(spark)])

    def next_run(self, spark: SparkSession, checkpoint: str) -> int:
        """The run a job belongs to: fixed at its first start, beside its checkpoint.

        A job whose checkpoint is lost finds no note of its run and gets a new one, above
        all that the table has versions or notes of; so does one that never wrote a batch.
        """
        noted = [_number(n) for n in sub_folders(spark, f"{checkpoint}/runs")]
        if noted:
            return max(noted)
        last = self.last_version(spark)
        runs = [-1, *(_number(n) for n in sub_folders(spark, f"{self.path}/runs"))]
        if last >= 0:
            runs.append(last // VERSIONS_PER_RUN)
        # A checkpoint without a note is of a job that began before there were any.
        run = max(runs) if exists(spark, f"{checkpoint}/metadata") else max(runs) + 1
        run = max(run, 0)
        make_folder(spark, f"{self.path}/runs/run={run}")
        make_folder(spark, f"{checkpoint}/runs/run={run}")
        return run

    def versions_since_base(self, spark: SparkSession) -> int:
        """Finished batches that the last compaction does not hold."""
        return len(self._versions(spark))

    # -- parts -----------------------------------------------------------------

    def _bases(self, spark: SparkSession) -> list[int]:
        """Finished compactions, oldest first."""
        names = sub_folders(spark, f"{self.path}/base")
        return sorted(
            _number(n) for n in names if exists(spark, f"{self.path}/base/{n}/_SUCCESS")
        )

    def _base(self, spark: SparkSession) -> DataFrame | None:
        """Rows of the newest compaction of every day, chosen by folder name, or ``None``."""
        stored = self._stored_schema()
        newest: dict[str, int] = {}
        for version in self._bases(spark):
            for folder in sub_folders(spark, f"{self.path}/base/upto={version}"):
                newest[folder] = version
        paths = [f"{self.path}/base/upto={v}/{folder}" for folder, v in sorted(newest.items())]
        if not paths:
            return None
        full = T.StructType([*stored.fields, T.StructField("upto", T.LongType())])
        rows = spark.read.schema(full).option("basePath", f"{self.path}/base").parquet(*paths)
        return rows.select(*stored.fieldNames(), F.col("upto").alias("version"))

    def _versions(self, spark: SparkSession) -> list[str]:
        """Folders of finished batches above the last compaction; a batch being written is not seen."""
        base = max(self._bases(spark), default=-1)
        newer = [n for n in sub_folders(spark, f"{self.path}/log") if _number(n) > base]
        return [n for n in newer if exists(spark, f"{self.path}/log/{n}/_SUCCESS")]

    def _log(self, spark: SparkSession) -> DataFrame | None:
        """Rows newer than the last compaction, or ``None``; older folders are not listed."""
        folders = self._versions(spark)
        if not folders:
            return None
        stored = self._stored_schema()
        full = T.StructType([*stored.fields, T.StructField("version", T.LongType())])
        root = f"{self.path}/log"
        reader = spark.read.schema(full).option("basePath", root)
        rows = reader.parquet(*[f"{root}/{name}" for name in folders])
        return rows.select(*stored.fieldNames(), "version")

    def _days(self, log: DataFrame) -> list[str | None]:
        """Days the log touches, from the folder names of its files; nothing is scanned."""
        names = re.compile(rf"/version=(\d+)/{re.escape(self.day)}=([^/]+)/")
        found = {match[2] for match in map(names.search, log.inputFiles()) if match}
        return [None if day == NO_DAY else unquote(day) for day in sorted(found)]

    def _on_days(self, days: list[str | None]):
        day = F.col(self.day)
        tests = [F.coalesce(day.isin([d for d in days if d is not None]), F.lit(False))]
        if None in days:
            tests.append(day.isNull())
        return reduce(or_, tests)

    def _newest(self, versions: DataFrame) -> DataFrame:
        return latest_per_key(versions, self.key_columns, ["version"]).drop("version")

    def _merged(self, base: DataFrame, log: DataFrame) -> DataFrame:
        newest = self._newest(log)
        changed = newest.select(*[F.col(c).alias(f"_{c}") for c in self.key_columns])
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.key_columns])
        return base.drop("version").join(changed, same, "left_anti").unionByName(newest)

    def _empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self._stored_schema())

    def _stored_schema(self) -> T.StructType:
        # The day is kept as text in folder names.
        return T.StructType(
            [
                T.StructField(f.name, T.StringType()) if f.name == self.day else f
                for f in self.schema.fields
            ]
        )

    def _write(self, rows: DataFrame, target: str, *, gathered: bool = False) -> None:
        # REBALANCE gathers each day, and splits days too large for one task.  Tasks
        # are merged only down to a small size: merging saves no files, as
        # days are files of their own, but would write their folders one by one.
        with settings(rows.sparkSession, {_MERGE_SIZE: "16KB"}):
            (
                (rows if gathered else rows.hint("rebalance", F.col(self.day)))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "static")
                .option("compression", "zstd")
                .partitionBy(self.day)
                .parquet(target)
            )


def _number(folder: str) -> int:
    return int(folder.split("=", 1)[1])
