"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import work_dir

#: What the contracts call a word: a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what is stored.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_slices(batches: Iterable[pa.RecordBatch], rows: int, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows and about ``limit`` bytes of ``column``.

    Bounds the memory of a task, whatever size Spark gives its batches; no row is
    cut, so a single long text is a slice of its own.
    """
    for batch in batches:
        start, size = 0, 0
        lengths = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or size + n > limit):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 texts, A-Z lower-cased, in a row, and how many each text has."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(text.view(pa.string())))
    lists = pc.ascii_split_whitespace(text)
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    if empty.any():
        kept = np.ones(len(words), bool)
        kept[(np.cumsum(lens) - lens)[empty]] = False
        words, lens = words.filter(pa.array(kept)), lens - empty
    return words, lens


def utf8(df: DataFrame, column: str) -> F.Column:
    """The column as its UTF-8 bytes; null as no bytes."""
    return F.coalesce(df[column].cast("binary"), F.lit(b""))


def release() -> None:
    """Gives memory that a worker has freed back to the system: the worker lives on, and other stages share the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)
