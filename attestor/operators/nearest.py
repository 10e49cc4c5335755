"""The nearest vectors of a query's own group by cosine, exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block.
BLOCK, QUERIES = 4096, 2048


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and rows j of b, summed from the first component to the last."""
    out = np.zeros(len(i))
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for s in range(0, len(i), 65536):
        x, y = i[s : s + 65536], j[s : s + 65536]
        for p, q in zip(at, bt):
            out[s : s + 65536] += p[x] * q[y]
    return out


def nearest_block(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, cosine) that hold the k best vectors of each query by cosine rounded to ``digits``, ties to
    the smaller id; a query's own id takes no part.

    A product of matrices tells what can be among the k best; their cosines are then summed in order. Cosines so near to
    half a last digit that their rounding is open stay in any case, and the caller, who rounds, decides."""
    no, every = np.zeros(len(q), int), np.arange(len(v))
    nq, nv = _dots(q, q, np.arange(len(q)), np.arange(len(q))), _dots(v, v, every, every)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = q @ v.T
        score /= np.sqrt(nq)[:, None]
        score /= np.sqrt(nv)[None, :]
        score[np.isnan(score)] = np.inf
        own = q_ids[:, None] == ids[None, :]
        score[own] = -np.inf
        if len(v) > k:
            score = score >= (np.partition(score, len(v) - k, axis=1)[:, len(v) - k] - 2 * 10.0**-digits)[:, None]
        else:
            score = score > -np.inf
        i, j = np.nonzero(score & ~own)
        cos = _dots(q, v, i, j) / np.sqrt(nq[i] * nv[j])
    scaled = np.where(np.isnan(cos), np.inf, cos) * 10.0**digits
    whole = np.floor(scaled + 0.5)
    with np.errstate(invalid="ignore"):
        open_ = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5
    told = np.flatnonzero(~open_)
    told = told[np.lexsort((ids[j[told]], -whole[told], i[told]))]
    n = np.bincount(i[told], minlength=len(no))
    rank = np.arange(len(told)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.concatenate((told[rank < k], np.flatnonzero(open_)))
    return i[keep], j[keep], cos[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Vectors and queries (vec_id, embedding, label) to (query_id, vec_id, relevance, rank): the k vectors of a query's
    label, its own id left out, with the highest cosine rounded to ``digits``, ties to the smaller id. A vector that is
    null, holds a null or has another length than the query has no relevance and comes last.

    Blocks of a label's queries meet blocks of its vectors, each pair of blocks in a group of bounded size."""
    n = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label")
    n = n.select("label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / QUERIES).cast("int").alias("parts"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = vectors.join(n, "label").select("label", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("c"), spread("parts").alias("q"), F.lit(False).alias("asks"), "vec_id", "embedding")
    right = queries.join(n, "label").select("label", spread("blocks").alias("c"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int").alias("q"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def run(group: pa.Table) -> pa.Table:
        asks, ids, e = group["asks"].to_numpy(), group["vec_id"].to_numpy(), group["embedding"].combine_chunks()
        dim = pc.fill_null(pc.list_value_length(e), -1).to_numpy(zero_copy_only=False).astype(int)
        if e.flatten().null_count:
            dim = np.where([x is not None and None in x for x in e.to_pylist()], -1, dim)
        found: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for d in np.unique(dim[asks]):
            mine, theirs = np.flatnonzero(asks & (dim == d)), np.flatnonzero(~asks & (dim == d))
            if d >= 0 and len(theirs):
                rows = lambda at: np.asarray(e.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), d)  # noqa: B023, E731
                i, j, cos = nearest_block(rows(mine), ids[mine], rows(theirs), ids[theirs], k, digits)
                found.append((ids[mine[i]], ids[theirs[j]], cos))
            rest = np.sort(ids[~asks & ((dim != d) | (d < 0))])
            for x in ids[mine] if len(rest) else ():
                last = rest[rest != x][:k]
                found.append((np.full(len(last), x), last, np.full(len(last), None)))
        a, b, c = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64(), from_pandas=False)})

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    groups = left.unionByName(right).repartition(tasks, "label", "c", "q").groupBy("label", "c", "q")
    found = groups.applyInArrow(run, "query_id long, vec_id long, cosine double").select("query_id", "vec_id", F.round("cosine", digits).alias("relevance"))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
