"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the run, t from 0 to 1: straight lines through
knots.  Its integral up to t is the share of the source's tokens that is due by then.
A source's documents stand in an order drawn by a hash; the words before a document,
in this pass and the passes before, are the demand it meets, and the inverse of the
integral gives its training position.  The plan is range-sorted by position.

Running sums never gather a source: a source is cut into buckets by the first digits
of the hash, the few bucket totals are summed first, and the rest within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD


@dataclass(frozen=True)
class Mix:
    """Sources in order of their code points, null last, take weights and schedules in turn."""

    weights: Sequence[float] = (3.0, 1.0, 2.0)
    share: float = 1.5  # words of the mix, as a share of all words
    most: float = 2.0  # a source's target is at most this many times its size
    #: Schedule of each weight: its factors at equal times from 0 to 1.
    schedules: Sequence[Sequence[float]] = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
    digits: int = 3  # 16 ** digits buckets for each source


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def position(share: Column, factors: Sequence[float]) -> Column:
    """The time by which this share of a source is due: the schedule's integral, inverted."""
    step = 1.0 / (len(factors) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(factors, factors[1:], strict=False)]
    total, done = sum(areas), 0.0
    due = share * F.lit(total)
    found = None
    for i, (a, b, area) in enumerate(zip(factors, factors[1:], areas, strict=False)):
        rest = due - F.lit(done)
        # rest = a x + (b - a) / (2 step) x**2, solved for x
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / step) * rest, F.lit(0.0)))
        time = F.lit(i * step) + F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(a) + root))
        done += area
        found = F.when(due <= F.lit(done), time) if found is None else found.when(due <= F.lit(done), time)
    return found.otherwise(F.lit(1.0))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source_key, source_size, turn, target`` from rows of ``source_key, size``; one row for each source.

    A source whose cap is small for its weight fills first.  With the sources in order of cap
    over weight, the first that the rest of the words, shared by weight, does not fill ends the search.
    """
    by = sizes.groupBy("source_key").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source_key") == "", "source_key")
    turn = (F.row_number().over(order) - 1) % len(mix.weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, mix.weights))), F.col("turn") + 1)
    by = by.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", F.lit(mix.most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.lit(mix.share) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level)
    settled = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    by = by.withColumn("settled", F.max(settled).over(every))
    target = F.least("cap", F.coalesce(F.col("settled") * F.col("weight"), F.col("cap")))
    return by.select("source_key", "source_size", "turn", target.alias("target"))


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """All columns of ``docs`` with ``size, source_size, target, taken, first_position`` and ``_start``.

    ``taken`` counts the words the mix takes of the document, repeats included: whole passes over the
    source, then one pass up to the target, which may end within a document.  ``first_position`` is null
    where nothing is taken.  A null or empty text has size 0; a null source is a source of its own; repeated
    rows are planned one by one; columns of these names in ``docs`` are replaced.
    """
    sized = docs.withColumns({
        "size": words(docs["text"]),
        "source_key": F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")),
        "_draw": F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")),
    }).withColumn("_bucket", F.substring("_draw", 1, mix.digits))
    totals = sized.groupBy("source_key", "_bucket").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "source_key", "_bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("bigint").alias("_before"))
    buckets = starts.join(targets(totals, mix), "source_key")
    placed = sized.drop("source_size", "turn", "target", "_before").join(buckets, ["source_key", "_bucket"])
    within = (Window.partitionBy("source_key", "_bucket").orderBy("_draw", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = (F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))).cast("bigint")
    whole = F.floor(F.col("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    rest = whole - passes * F.col("source_size") - F.col("_start")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    out = placed.withColumn("_start", start).withColumn("taken", taken.cast("bigint"))
    share = F.col("_start") / F.col("target")
    at = None
    for i, factors in enumerate(mix.schedules):
        mine = F.col("turn") % len(mix.schedules) == i
        at = F.when(mine, position(share, factors)) if at is None else at.when(mine, position(share, factors))
    return out.withColumn("first_position", F.when(F.col("taken") > 0, at)).drop("source_key", "_draw", "_bucket", "_before")


def assign(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Documents of the mix in training order: a row for each pass that takes words of a document.

    All columns of ``docs`` and ``pass`` (from 0) and ``position``.  A document at the end of a source's last pass is kept whole.
    """
    planned = plan(docs, mix)
    passes = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    rows = planned.where("taken > 0").withColumn("pass", F.explode(passes))
    share = (F.col("pass") * F.col("source_size") + F.col("_start")) / F.col("target")
    at = None
    for i, factors in enumerate(mix.schedules):
        mine = F.col("turn") % len(mix.schedules) == i
        at = F.when(mine, position(share, factors)) if at is None else at.when(mine, position(share, factors))
    return rows.withColumn("position", at).select(*docs.columns, "pass", "position").orderBy("position", "doc_id", "pass")


def sql(mix: Mix = Mix()) -> str:
    """The plan's columns but for the position, as SQL over ``documents``."""
    weights = ", ".join(str(float(w)) for w in mix.weights)
    return f"""
    WITH sized AS (
        SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
               CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
        FROM documents),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               [{weights}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mix.weights)}]::DOUBLE AS weight
        FROM sized GROUP BY source),
    caps AS (SELECT *, CAST({mix.most} AS DOUBLE) * source_size AS cap FROM sources),
    levels AS (
        SELECT *, (CAST({mix.share} AS DOUBLE) * sum(source_size) OVER ()
                   - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM caps),
    settled AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS settled FROM levels),
    targets AS (SELECT source, source_size, least(cap, coalesce(settled * weight, cap)) AS target FROM settled),
    placed AS (
        SELECT s.doc_id, s.size, t.source_size, t.target,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
               CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS passes
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(passes * size + greatest(0, least(size, floor(target) - passes * source_size - start)) AS BIGINT) AS taken
    FROM placed"""
