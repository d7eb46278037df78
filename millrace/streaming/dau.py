"""Stateful choice of the first page view per device and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import day_start

#: Days older than the newest one by more than this are closed: their state is
#: dropped and later rows for them are not taken (D9).
DELAY = "24 hours"
SALTS = 8
#: ST-2, D9: how far a row may be dated after its arrival.  The watermark follows the latest day, so a clock
#: that runs ahead would close all real ones.
AHEAD = "24 hours"


def plausible(ahead: str, arrived: Column) -> Column:
    return F.coalesce(F.col("ts") <= F.unix_millis(arrived + F.expr(f"INTERVAL {ahead}")), F.lit(True))


def _dated(pages: DataFrame, delay: str) -> DataFrame:
    # The watermark sits on the day itself: on the finer event time, state keyed
    # by day would never be evicted.
    known = pages.where(F.col("mid").isNotNull())
    return known.withColumn("day", day_start("ts")).withWatermark("day", delay)


def first_arrived(pages: DataFrame, *, delay: str = DELAY, salts: int = SALTS) -> DataFrame:
    """ST-2, AGG-1: the first row to arrive per ``(day, mid)``, emitted once.

    With ``salts`` above one, rows of a device are first thinned out over that many
    tasks, each keeping one; only those meet in the final step.  A device with a
    third of all rows then loads no single task.
    """
    dated = _dated(pages, delay)
    if salts > 1:
        spread = F.pmod(F.xxhash64(*pages.columns), F.lit(salts)).cast("int")
        thinned = dated.withColumn("_salt", spread).dropDuplicates(["day", "mid", "_salt"])
        dated = thinned.drop("_salt")
    return dated.dropDuplicates(["day", "mid"])


def earliest(pages: DataFrame, tiebreak: list[str], *, delay: str = DELAY) -> DataFrame:
    """D8: the row with the lowest event time per ``(day, mid)``, whatever the arrival order.

    For update mode with a keyed sink: a key is emitted again when it is touched,
    and converges on the batch result.  Rows of a device are reduced in every
    map task before the shuffle.
    """
    row = F.struct(*pages.columns)
    order = F.struct("ts", *tiebreak)
    return (
        _dated(pages, delay)
        .groupBy("day", F.col("mid").alias("_mid"))
        .agg(F.min_by(row, order).alias("_row"))
        .select("day", "_row.*")
    )
