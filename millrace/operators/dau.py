"""Daily-active devices: first session-entry page view per device and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import day_of_millis, hour_of_millis
from millrace.functions.json import project_by_name
from millrace.operators.dims import settle_misses, with_provinces, with_users
from millrace.operators.keyed import first_per_key
from millrace.schemas import DAU_WIDE


def session_starts(pages: DataFrame) -> DataFrame:
    """FLT-6: page views without a previous page; an empty name is a previous page."""
    return pages.where(F.col("last_page_id").isNull())


def with_day(pages: DataFrame) -> DataFrame:
    """FN-8, F7: adds ``dt``, the day of the event itself."""
    return pages.withColumn("dt", day_of_millis("ts"))


def first_of_day(pages: DataFrame, tiebreak: list[Column | str]) -> DataFrame:
    """AGG-1: first row per ``(dt, mid)`` by event time, then by ``tiebreak`` (D8)."""
    dated = pages if "dt" in pages.columns else with_day(pages)
    return first_per_key(dated, ["dt", "mid"], ["ts", *tiebreak])


def not_yet_written(pages: DataFrame, written: DataFrame, *, unless_earlier: bool = False) -> DataFrame:
    """ST-3: drops devices already written for the day.

    With ``unless_earlier`` a row that precedes the written one stays.  Apply it to
    rows that are unique per ``(dt, mid)``: then neither side has a hot key.
    """
    first = written.groupBy(F.col("dt").alias("_dt"), F.col("mid").alias("_mid")).agg(F.min("ts").alias("_ts"))
    same = (F.col("dt") == F.col("_dt")) & (F.col("mid") == F.col("_mid"))
    if unless_earlier:
        same = same & (F.col("_ts") <= F.col("ts"))
    return pages.join(first, same, "left_anti")


def enrich(
    firsts: DataFrame,
    users: DataFrame,
    provinces: DataFrame,
    *,
    as_of: str | date | None = None,
    on_miss: str = "null",
) -> DataFrame:
    """JN-1, JN-2, PRJ-12, FN-9: the daily-active wide record plus ``dim_miss``."""
    joined = with_provinces(
        with_users(firsts, users, as_of=as_of), provinces, iso_3166_2="province_3166_2"
    )
    settled = settle_misses(joined, on_miss)
    return project_by_name(
        settled,
        [*DAU_WIDE.fieldNames(), "dim_miss"],
        {
            "user_age": F.col("user_age").cast("string"),
            "dt": day_of_millis("ts"),
            "hr": hour_of_millis("ts"),
        },
    )
