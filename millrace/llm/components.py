"""Connected components over edges of any number, by alternating stars.

Each round ties every node to the smallest node near it: first its larger neighbours
(large star), then its smaller ones (small star), until nothing changes.  Rounds are
joins and groupings over the edges and are kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``edges`` (``a, b``); loops count for nothing."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.where("a <> b").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    """What tells two rounds apart: rows, and sums of two hashes of them."""
    hashes = (F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("bigint")))
    return tuple(edges.agg(F.count(F.lit(1)), *hashes).first())
