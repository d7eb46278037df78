"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one class, so copies cost nothing.  Every class goes to its nearest
centre's cell, as *home*, and as *guest* to each other cell whose border it lies within
``margin`` of: the sine of its angle to the plane between both centres.  Home classes of
a cell meet each other and its guests in blocks of bounded size; a pair that meets in
two cells counts in one.  What leaves a block is, for each class, its number of links
and the smallest class of its component there, never pairs.

No pair is missed: unit vectors at a cosine of c are at most sqrt(2 - 2c) apart, so of two on either side of the
border between their cells one lies within half of that, sqrt((1 - c) / 2), of it, and is a guest of the other's cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.components import components
from millrace.llm.topk import usable

#: Added to the margin for rounding.
SLACK = 1e-6
#: Classes that the centres are fitted on, by a hash of their id; all classes are indexed.
SAMPLE = 8_192
PER_CELL, MOST_CELLS = 2_000, 512
BLOCK = 2_048


def fit(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres by spherical k-means; starts from spread-out members, so reruns agree."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = unit[:1]
    nearest = unit @ centres[0]
    while len(centres) < min(cells, len(unit)):
        centres = np.vstack([centres, unit[np.argmin(nearest)]])
        nearest = np.maximum(nearest, unit @ centres[-1])
    for _ in range(rounds):
        home = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def _dense(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _cells(classes: DataFrame, centres: np.ndarray, margin: float) -> DataFrame:
    """``rep, v, n, home, guests``."""
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    schema = "rep bigint, v array<double>, n bigint, home int, guests array<int>"

    def run(batches):
        for batch in batches:
            v = _dense(batch.column("v"))
            near = v @ centres.T / np.linalg.norm(v, axis=1, keepdims=True)
            home = np.argmax(near, axis=1)
            close = near[np.arange(len(v)), home][:, None] - near <= margin * gaps[home]
            close[np.arange(len(v)), home] = False
            guests = [np.flatnonzero(row).tolist() for row in close]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("v"), batch.column("n"), pa.array(home, pa.int32()),
                 pa.array(guests, pa.list_(pa.int32()))], ["rep", "v", "n", "home", "guests"])

    return classes.select("rep", "v", "n").mapInArrow(run, schema)


def _spread(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label that links lead to, for the rows and the columns."""
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], top).min(axis=1, initial=top))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], top).min(axis=0, initial=top))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """Left rows are of one block of the cell's home, right rows of another block, or of the same."""
        side = table.column("side").to_numpy()
        cell = table.column("cell")[0].as_py()
        same = (side == 2).all()
        parts = []
        for mine in ((side == 2, side == 2) if same else (side == 0, side == 1)):
            t = table.filter(pa.array(mine))
            v = _dense(t.column("v").combine_chunks())
            parts.append((t.column("rep").to_numpy(), v, np.linalg.norm(v, axis=1), t.column("n").to_numpy(),
                          t.column("home").to_numpy(), t.column("guests").to_pylist()))
        (rep_a, a, norm_a, n_a, _, guests_a), (rep_b, b, norm_b, n_b, home_b, _) = parts
        if len(rep_a) and len(rep_b):
            linked = a @ b.T / (norm_a[:, None] * norm_b[None, :]) >= cosine
        else:
            linked = np.zeros((len(rep_a), len(rep_b)), bool)
        if same:
            np.fill_diagonal(linked, False)
        for other in np.unique(home_b):
            if other < cell:  # the pair counts in the lower cell if the left row is a guest there
                there = np.array([other in g for g in guests_a], bool)
                linked[np.ix_(there, home_b == other)] = False
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked = linked[np.ix_(rows, columns)]
        left, right = _spread(linked, rep_a[rows], rep_b[columns])
        out = [(rep_a[rows], linked @ n_b[columns], left)]
        if not same:
            out.append((rep_b[columns], n_a[rows] @ linked, right))
        return pa.table({name: pa.array(np.concatenate([o[i] for o in out]), pa.int64())
                         for i, name in enumerate(("rep", "links", "low"))})

    return run


def exact_margin(cosine: float) -> float:
    return math.sqrt((1 - cosine) / 2) + SLACK


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``n_links``: other rows at this cosine or above; ``component_id``: smallest id reachable by links;
    ``kept``: the row is its component's representative.  Null and zero vectors and those with null or non-finite
    components, also empty ones, link with nothing.  Vectors of different lengths do not link.  Copies link with each
    other.  Rows that repeat a ``vec_id`` are rows of their own and share its component.  A null id links with nothing.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    nonzero = F.exists("embedding", lambda x: x != 0)
    fit_for = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.coalesce(nonzero, F.lit(False))
    rows = vectors.select("vec_id", F.when(fit_for, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "vector-classes")
    found = [_by_width(classes.where(F.size("v") == row["w"]), row["n"], cosine)
             for row in classes.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()]
    links = found[0] if found else classes.select("rep", F.col("n").alias("links"), F.col("rep").alias("low")).limit(0)
    for more in found[1:]:
        links = links.union(more)
    links = stored(links, "vector-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    about = (classes.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
             .select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(about, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _by_width(classes: DataFrame, n: int, cosine: float) -> DataFrame:
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    centres = fit(_dense(sample), min(MOST_CELLS, max(1, n // PER_CELL)))
    placed = stored(_cells(classes, centres, exact_margin(cosine)), "vector-cells")
    homes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    guests = {r["cell"]: r["n"] for r in placed.select(F.explode("guests").alias("cell")).groupBy("cell")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    # A row for each cell, at most MOST_CELLS of them: into how many blocks its rows are dealt.
    blocks = F.create_map(*[F.lit(x) for c, n in homes.items() for x in (c, -(-n // BLOCK))])
    guest_blocks = F.create_map(*[F.lit(x) for c in homes for x in (c, -(-guests.get(c, 0) // BLOCK))])
    deal = F.xxhash64("rep", F.lit(7))
    home = placed.withColumn("cell", F.col("home")).withColumn("of", F.element_at(blocks, F.col("home"))).withColumn(
        "g", F.element_at(guest_blocks, F.col("home"))).withColumn("at", F.pmod(deal, F.col("of")).cast("int"))
    guest = placed.withColumn("cell", F.explode("guests")).withColumn("of", F.element_at(blocks, F.col("cell"))).withColumn(
        "g", F.element_at(guest_blocks, F.col("cell"))).withColumn("at", F.pmod(deal, F.col("g")).cast("int"))


    # Home blocks i <= j meet; the lower one is the left side.
    meet = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda j: F.struct(
        F.lit("home").alias("kind"), F.least(F.col("at"), j).alias("i"), F.greatest(F.col("at"), j).alias("j"),
        F.when(F.col("at") == j, 2).when(F.col("at") < j, 0).otherwise(1).alias("side")))
    invite = F.when(F.col("g") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("g") - 1, F.lit(0))), lambda j: F.struct(
        F.lit("guest").alias("kind"), F.col("at").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    visit = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda i: F.struct(
        F.lit("guest").alias("kind"), i.alias("i"), F.col("at").alias("j"), F.lit(1).alias("side")))
    columns = ["rep", "v", "n", "home", "guests", "cell"]
    dealt = (home.select(*columns, F.explode(F.concat(meet, F.coalesce(invite, F.array().cast(
        "array<struct<kind:string,i:int,j:int,side:int>>")))).alias("t"))
             .union(guest.where("of IS NOT NULL").select(*columns, F.explode(visit).alias("t"))))
    dealt = dealt.select(*columns, "t.kind", "t.i", "t.j", "t.side")
    return dealt.groupBy("cell", "kind", "i", "j").applyInArrow(_compare(cosine), "rep bigint, links bigint, low bigint")
