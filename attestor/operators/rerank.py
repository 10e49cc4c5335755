"""Soft reranking: a role moves a candidate by a few ranks and never out of the set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAME, LIMIT, AUTHORITY_STEP = "soft_rerank_v1", 20, 0.05
OFFSETS = {"governing": -4, "verifier": -2, "contender": 2, "excluded": 6}
PRECEDENCE = ("excluded", "contender", "verifier", "governing")


def role_offset(role):
    out = F.lit(0)
    for name, offset in OFFSETS.items():
        out = F.when(role == name, F.lit(offset)).otherwise(out)
    return out


def primary_role(materials: DataFrame) -> DataFrame:
    """(source_id, role) with the role that comes first in PRECEDENCE, over all packets."""
    code = F.array_position(F.array(*[F.lit(r) for r in PRECEDENCE]), F.col("role"))
    best = materials.filter(F.col("role").isin(*PRECEDENCE)).groupBy("source_id").agg(F.min(code).alias("code"))
    return best.select("source_id", F.element_at(F.array(*[F.lit(r) for r in PRECEDENCE]), F.col("code").cast("int")).alias("role"))


def soft_rerank(candidates: DataFrame, by: str = "query_id", rank: str = "rank", role: str = "role") -> DataFrame:
    """Adds new_rank: order by (rank + offset of the role, rank), ranks counting from 1 in each query. More than LIMIT
    candidates in a query are an error, so the number of candidates never changes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    w = Window.partitionBy(by).orderBy("adjusted", rank)
    guarded = F.when(F.col("n") > LIMIT, F.raise_error(F.concat(F.lit(f"at most {LIMIT} candidates, got "), F.col("n").cast("string")))).otherwise(F.row_number().over(w))
    return candidates.withColumn("adjusted", F.col(rank) + role_offset(F.col(role))).withColumn("n", n).withColumn("new_rank", guarded.cast("int")).drop("n")


#: The reranking of a retrieval contract that names none.
rerank = soft_rerank
