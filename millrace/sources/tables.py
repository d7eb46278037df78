"""Batch sources: parquet tables, table lists, fields of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; zone-less timestamps become timestamps of the session zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return zoned(spread(df, df))


#: Bytes of a table's files for one task: their rows, as JSON text and parsed, take a multiple of it in memory.
PIECE_BYTES = 8 << 20


def spread(df: DataFrame, read: DataFrame) -> DataFrame:
    """``df`` over all cores, and in pieces of ``PIECE_BYTES``, when ``read``, its batch form, comes in fewer.

    Parsing costs far more than reading, and one small file would do it all in one
    task.  Tasks keep their size as a table grows.  A table with enough pieces is left as it is: no shuffle.
    """
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-_file_bytes(read) // PIECE_BYTES))
    return df.repartition(pieces) if read.rdd.getNumPartitions() < pieces else df


def _file_bytes(read: DataFrame) -> int:
    """Size of the files of a table, as Spark's reader has listed them."""
    return int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def zoned(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for rows that are costly to make and needed more than once."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _locate(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    files, location = _locate(spark, path)
    return files.exists(location)


def make_folder(spark: SparkSession, path: str) -> None:
    files, location = _locate(spark, path)
    files.mkdirs(location)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, location = _locate(spark, path)
    return files.exists(location) and files.getFileStatus(location).isDirectory()


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``; none if it does not exist."""
    files, location = _locate(spark, path)
    if not files.exists(location):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(location) if s.isDirectory())


def drop_newest(spark: SparkSession, path: str) -> None:
    """Deletes the file with the highest number for a name: a lost commit of a query's checkpoint."""
    files, location = _locate(spark, path)
    numbers = [int(s.getPath().getName()) for s in files.listStatus(location) if s.getPath().getName().isdigit()]
    if numbers:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{max(numbers)}"), False)


def table_names(spark: SparkSession, names: list[str]) -> DataFrame:
    """A table list as the one-column frame the change split expects (SRC-7)."""
    return spark.createDataFrame([(n,) for n in names], "table_name string")
