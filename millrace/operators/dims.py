"""Dimension tables and lookups against them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import as_of_date, whole_years
from millrace.functions.json import bind
from millrace.schemas import PROVINCE_DIM, USER_DIM

ON_MISS = ("null", "drop", "error")

#: Most keys of a micro-batch that are sent to a dimension: a few megabytes.
MAX_USED_KEYS = 100_000


def dim_table(current: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """SRC-6: one dimension as typed columns, from ``(dim, id, data)`` rows."""
    rows = current.where(F.col("dim") == name.upper())
    fields = T.StructType([f for f in schema.fields if f.name != "id"])
    return bind(rows, fields, value="data", keep=("id",))


def user_dim(current: DataFrame) -> DataFrame:
    return dim_table(current, "user_info", USER_DIM)


def province_dim(current: DataFrame) -> DataFrame:
    return dim_table(current, "base_province", PROVINCE_DIM)


def with_users(
    df: DataFrame, users: DataFrame, *, as_of: str | date | None = None, on: str = "user_id"
) -> DataFrame:
    """JN-1, JN-4: adds ``user_gender``, ``user_age`` (int) and ``user_miss``.

    The user table grows with the business, so no broadcast is forced: Spark
    broadcasts it below its threshold, otherwise sort-merge joins, and adaptive
    execution splits the fact side of a hot user.
    """
    looked_up = users.select(
        F.col("id").alias("_user"),
        F.col("gender").alias("user_gender"),
        F.col("birthday").alias("_birthday"),
    )
    joined = _lookup(df, looked_up, on, "_user")
    return joined.withColumns(
        {
            "user_age": whole_years("_birthday", as_of_date(as_of)),
            "user_miss": F.col("_user").isNull(),
        }
    ).drop("_user", "_birthday")


def with_provinces(
    df: DataFrame, provinces: DataFrame, *, iso_3166_2: str, on: str = "province_id"
) -> DataFrame:
    """JN-2, JN-3: adds name, codes and ``province_miss``.

    ``iso_3166_2`` is the output name of that code, which differs by record (F9).
    """
    looked_up = provinces.select(
        F.col("id").alias("_province"),
        F.col("name").alias("province_name"),
        F.col("iso_code").alias("province_iso_code"),
        F.col("iso_3166_2").alias(iso_3166_2),
        F.col("area_code").alias("province_area_code"),
    )
    joined = _lookup(df, looked_up, on, "_province")
    return joined.withColumn("province_miss", F.col("_province").isNull()).drop("_province")


def _lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    # Dimension keys are text; fact keys may be numbers (FN-14).
    return df.join(dim, F.col(key).cast("string") == F.col(dim_key), "left")


def used_rows(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The rows of a dimension that some facts refer to.

    For a micro-batch against a dimension of any size: while the batch uses no more
    than ``MAX_USED_KEYS`` keys, they are broadcast to the dimension, which is then
    scanned but not shuffled.  Beyond that the whole dimension is returned.

    The keys are taken as values: Spark would not find held ``facts`` again on the
    second side of one plan and would compute them, and their state, twice.
    """
    keys = facts.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    used = keys.limit(MAX_USED_KEYS + 1).collect()
    if len(used) > MAX_USED_KEYS:
        return dim
    return dim.join(F.broadcast(facts.sparkSession.createDataFrame(used, keys.schema)), "id", "left_semi")


def settle_misses(df: DataFrame, on_miss: str = "null") -> DataFrame:
    """D1: fold the miss flags into ``dim_miss`` and apply the miss policy."""
    if on_miss not in ON_MISS:
        raise ValueError(f"on_miss must be one of {ON_MISS}")
    miss: Column = F.col("user_miss") | F.col("province_miss")
    if on_miss == "error":
        failed = F.raise_error(F.lit("dimension row missing")).cast("boolean")
        miss = F.when(miss, failed).otherwise(F.lit(False))
    settled = df.withColumn("dim_miss", miss)
    if on_miss == "drop":
        settled = settled.where(~F.col("dim_miss"))
    return settled.drop("user_miss", "province_miss")


def miss_report(df: DataFrame, users: DataFrame, provinces: DataFrame) -> DataFrame:
    """D1: dimension keys that facts refer to but the dimensions lack, with counts.

    Facts are counted per key before the anti join, so the join sees one row per
    key however often it is used.
    """

    def missing(key: str, dim: DataFrame, name: str) -> DataFrame:
        used = df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"))
        return used.join(dim.select("id"), "id", "left_anti").select(F.lit(name).alias("dim"), "id", "n_rows")

    return missing("user_id", users, "USER_INFO").unionAll(
        missing("province_id", provinces, "BASE_PROVINCE")
    )
