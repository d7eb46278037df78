"""Exact top-k search by Fagin's threshold algorithm.

Candidates are dealt into blocks by a hash of their row.  A block keeps, for every
dimension, its candidates sorted by that component.  For a query the lists are read
in step, from the end at which the query's component gains most; each id met is
scored in full; reading stops when the score that the components at the present depth
would make cannot reach the k-th best any more.  Blocks of queries meet blocks of
candidates, so no task holds more than one of each, and only k rows leave a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES, FIRST_DEPTH = 8_192, 1_024, 4
EXACT = 2.0**53
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, held to the range of a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def _held(scores):
    """Scores within the range of a long, as which they are ranked; only exact integers can be beyond it."""
    if isinstance(scores, np.ndarray) and scores.dtype != object or isinstance(scores, np.floating):
        return scores
    return np.clip(scores, -LONG - 1, LONG)


def threshold_search(ids: np.ndarray, table: np.ndarray, order: np.ndarray, query: np.ndarray, barred: np.ndarray, k: int):
    """Numbers and scores of the k best rows of ``table`` for a query, ``barred`` ones left out: highest score first, then smallest id.

    ``order`` has the rows of ``table`` sorted by each component.  Ids ascend.
    """
    n = len(ids)
    dims = np.flatnonzero(query != 0)
    if not len(dims):
        keep = np.flatnonzero(~barred)[:k]
        return keep, np.zeros(len(keep), np.int64)
    rising = query[dims] < 0
    seen = barred.copy()
    best, scores = np.zeros(0, np.int64), np.zeros(0, table.dtype)
    done, depth = 0, FIRST_DEPTH
    while done < n:
        depth = min(depth, n)
        steps = np.arange(done, depth)
        at = np.where(rising[None, :], steps[:, None], n - 1 - steps[:, None])
        met = np.unique(order[at, dims[None, :]])
        met = met[~seen[met]]
        seen[met] = True
        best = np.concatenate([best, met])
        scores = np.concatenate([scores, _held(table[met] @ query)])
        top = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[top], scores[top]
        last = order[np.where(rising, depth - 1, n - depth), dims]
        bound = _held((table[last, dims] * query[dims]).sum())
        if len(best) == k and bound < scores[-1]:
            break
        done, depth = depth, 2 * depth
    return best, scores


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """One row for each vector; shorter ones are filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lens = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width)[None, :] < lens[:, None]] = vectors.flatten().to_numpy()
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((pa.compute.max(pa.compute.list_value_length(c)).as_py() or 0 for c in columns), default=0)


def top_k(vectors: DataFrame, k: int, is_query: Column, by_row: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best other rows by integer inner product.

    Rows whose ``vec_id`` or ``embedding`` is null, or holds null or non-finite components, take no part.  Shorter
    vectors count as zeros in the dimensions they lack.  Rows that repeat a ``vec_id`` are all candidates of other ids, and as
    queries they share one list of k; ``by_row``: each has a list of its own, with the other rows of its id among its candidates.
    Ties go to the smaller id; scores are held to the range of a long and ranked so.
    """
    valid = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = valid.select("vec_id", quantised(F.col("embedding")).alias("v"))
    n, n_queries = valid.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    rows = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))  # copies are one row until they are listed
    blocks, batches = -(-max(n, 1) // CANDIDATES), -(-max(n_queries, 1) // QUERIES)
    spread = F.xxhash64("vec_id", "v")  # also deals out the rows of one repeated id
    block, batch = F.pmod(spread, F.lit(blocks)), F.pmod(spread, F.lit(batches))
    candidates = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "vec_id", "v", "n")
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), batch.alias("batch"),
                                          F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.col("n").alias("times"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        asker, found_ids, found_scores = [], [], []
        if left.num_rows and right.num_rows:
            width = _width(left.column("v"), right.column("query"))
            left = left.sort_by("vec_id")
            ids, table, copies = left.column("vec_id").to_numpy(), _matrix(left.column("v"), width), left.column("n").to_numpy()
            of, asked, times = right.column("query_id").to_numpy(), _matrix(right.column("query"), width), right.column("times").to_numpy()
            lens, asked_lens = (pa.compute.list_value_length(c).to_numpy() for c in (left.column("v"), right.column("query")))
            reach = float(np.abs(table.astype(float)).max(initial=0)) * float(np.abs(asked.astype(float)).max(initial=0)) * max(width, 1)
            order = np.argsort(table, axis=0, kind="stable")
            kind = np.float64 if reach < EXACT else object  # exact either way
            exact, asked_exact = table.astype(kind), asked.astype(kind)
            for i, query_id in enumerate(of):
                mine = slice(*(np.searchsorted(ids, query_id, side) for side in ("left", "right")))
                if by_row:
                    left_over = copies.copy()
                    left_over[mine] -= (lens[mine] == asked_lens[i]) & (table[mine] == asked[i]).all(1)
                else:
                    left_over = np.minimum(copies, k) * min(times[i], k)
                    left_over[mine] = 0
                best, scores = threshold_search(ids, exact, order, asked_exact[i], left_over == 0, k)
                each = np.minimum(left_over[best], k)
                best, scores = np.repeat(best, each)[:k], np.repeat(scores, each)[:k]
                asker += [i] * len(best)
                found_ids += ids[best].tolist()
                found_scores += [int(s) for s in scores]
        columns = [right.column(c).take(pa.array(asker, pa.int64())) if asker else pa.array([], t)
                   for c, t in (("query_id", pa.int64()), ("query", pa.list_(pa.int64())), ("times", pa.int64()))]
        columns += [pa.array(found_ids, pa.int64()), pa.array(found_scores, pa.int64())]
        return pa.table(columns, ["query_id", "query", "times", "vec_id", "score"])

    found = (candidates.groupBy("block", "batch").cogroup(queries.groupBy("block", "batch"))
             .applyInArrow(search, "query_id bigint, query array<bigint>, times bigint, vec_id bigint, score bigint"))
    lists = ("query_id", "query") if by_row else ("query_id",)
    rank = F.row_number().over(Window.partitionBy(*lists).orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    if by_row:
        best = best.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return best.select("query_id", "rank", "vec_id", "score")


def sql(k: int, every: int) -> str:
    return f"""
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored QUALIFY rank <= {k}"""
