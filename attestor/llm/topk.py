"""Exact top-k by inner product with no-random-access aggregation.

A block of candidates keeps one sorted list per component. For a query, list j is read from its top if the query's
component is positive, else from its bottom. After a round of sequential reading to some depth, a candidate's unread
contributions lie between those of the list's last read value and of its far end, which gives an upper and a lower
bound of its score. Outsiders whose upper bound is below the k-th best lower bound cannot qualify; reading stops, and
the scores of the few that still can are resolved. The bound found in one part of a block carries over to the next.

All queries of a block read together: the bounds of a round are two products with the candidates' clipped components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block, of a part of it, and of a query block.
BLOCK, PART, QUERIES = 8192, 2048, 1024
#: Shares of each list that rounds read to.
DEPTHS = (0.5, 0.75)


def quantise(x: np.ndarray, scale: int = 256) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = rank < k
    return q[keep], score[keep], ids[keep]


def nra_block(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, id) of the k best candidates of each query in one block; a query's own id takes no part."""
    top = (np.zeros(0, np.int64), np.zeros(0, queries.dtype), np.zeros(0, np.int64))
    known = np.full(len(queries), -np.inf)  # the k-th best resolved score so far
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    for at in range(0, len(cands), PART):
        c, cid = cands[at : at + PART], ids[at : at + PART]
        n = len(c)
        lists = np.sort(c, axis=0)
        open_ = query_ids[:, None] != cid[None, :]
        for depth in DEPTHS if n > 4 * k else ():
            read = max(k, math.ceil(depth * n))
            high, low = lists[n - read], lists[read - 1]  # the last values read from the top and from the bottom
            upper = plus @ np.maximum(c, high).T + minus @ np.minimum(c, low).T
            bound = known
            if not np.isfinite(known).all():  # no earlier part to go by: lower bounds of this round
                lower = plus @ np.where(c >= high, c, lists[0]).T + minus @ np.where(c <= low, c, lists[-1]).T
                lower[query_ids[:, None] == cid[None, :]] = -np.inf
                bound = np.maximum(known, np.partition(lower, n - k, axis=1)[:, n - k])
            open_ &= upper >= bound[:, None]
            if open_.sum() <= 4 * k * len(queries):
                break
        q, j = np.nonzero(open_)
        if len(q) > 0.25 * open_.size:
            score = (queries @ c.T)[q, j]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", queries[q[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0, queries.dtype)])
        top = _best(np.concatenate((top[0], q)), np.concatenate((top[1], score)), np.concatenate((top[2], cid[j])), k)
        counts = np.bincount(top[0], minlength=len(queries))
        last = np.cumsum(counts) - 1
        full = counts == k
        known[full] = top[1][last[full]]
    return top


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates with the highest inner product of the vectors
    floor(scale * x), ties to the smaller id, all if fewer.

    Vectors that are null, empty, or hold a null or non-finite component, and null ids, take no part. A query never
    finds rows of its own id. Vectors meet only vectors of their own length. Of rows that share an id, the smallest
    vector stands for all. Products are exact up to 2^53.

    Blocks of queries meet blocks of candidates, each pair of blocks in a group of bounded size.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)
        twice = rows.select("id").groupBy("id").count().filter("count > 1").limit(1).count() > 0
        return rows.groupBy("id").agg(F.min("v").alias("v")) if twice else rows

    cands, asked = clean(vectors), clean(queries)
    blocks, parts = max(1, math.ceil(cands.count() / BLOCK)), max(1, math.ceil(asked.count() / QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cands.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("c"), spread(parts).alias("q"), F.lit(False).alias("asks"), "id", "v")
    right = asked.select(F.size("v").alias("dim"), spread(blocks).alias("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("q"), F.lit(True).alias("asks"), "id", "v")

    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        ids = group["id"].to_numpy()
        v = group["v"].combine_chunks()
        x = quantise(np.asarray(v.flatten()).reshape(len(ids), -1), scale)
        q, score, cid = nra_block(x[asks], ids[asks], x[~asks], ids[~asks], k) if asks.any() and not asks.all() else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": ids[asks][q], "vec_id": cid, "score": np.asarray(score).astype(np.int64)})

    found = left.unionByName(right).groupBy("dim", "c", "q").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
