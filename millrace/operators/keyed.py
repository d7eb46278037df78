"""Row choice per key: first, latest, distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """AGG-1: the first row of every key in ``order``.

    Spark keeps one row per key in every map task before it shuffles
    (``WindowGroupLimit``), so a key that holds a third of all rows sends one row
    per map task, not its whole group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AGG-3, AGG-4, SNK-7: the last written row of every key."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def row_counts(before: DataFrame, after: DataFrame, names: tuple[str, str] = ("before", "after")) -> DataFrame:
    """AGG-5: row counts on both sides of an operator, one row per side."""
    return (
        before.select(F.lit(names[0]).alias("stage"))
        .unionAll(after.select(F.lit(names[1]).alias("stage")))
        .groupBy("stage")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
