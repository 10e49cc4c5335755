"""Retrieval records of a build, and the delta between two builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_units(evidence: DataFrame, claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, source_id, text, claim_ids, conflict_ids) for each evidence unit, lists sorted, empty if none."""
    refs = claims.select(F.col("id").alias("claim_id"), F.explode("evidence").alias("r")).select("claim_id", "r.source_id", "r.evidence_id")
    con = conflicts.select("conflict_id", F.explode(F.array("l_id", "r_id")).alias("claim_id")).groupBy("claim_id").agg(F.collect_set("conflict_id").alias("c"))
    of = refs.join(con, "claim_id", "left").groupBy("source_id", "evidence_id").agg(F.sort_array(F.collect_set("claim_id")).alias("claim_ids"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("c")))).alias("conflict_ids"))
    none = F.array().cast("array<string>")
    return evidence.join(of, ["source_id", "evidence_id"], "left").select(F.concat(F.lit("unit:"), "evidence_id").alias("id"), "source_id", "text", F.coalesce("claim_ids", none).alias("claim_ids"), F.coalesce("conflict_ids", none).alias("conflict_ids"))


def records(df: DataFrame) -> DataFrame:
    """(id, payload): each row as JSON."""
    return df.select("id", F.to_json(F.struct(*[c for c in df.columns])).alias("payload"))


def assert_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """The same rows; running it fails if a key is missing or repeats."""
    bad = df.groupBy(key).count().filter(f"count > 1 OR {key} IS NULL").limit(1).count()
    if bad:
        raise ValueError(f"{key} is missing or repeats")
    return df


def delta(base: DataFrame, target: DataFrame) -> DataFrame:
    """(id, op, payload): upserts of new and changed records, deletes of lost ones."""
    b, t = base.select("id", F.col("payload").alias("old")), target.select("id", F.col("payload").alias("new"), F.lit(True).alias("there"))
    j = b.join(t, "id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")) | F.col("there").isNull())
    return j.select("id", F.when(F.col("there").isNull(), "delete").otherwise("upsert").alias("op"), F.col("new").alias("payload"))


def delta_summary(base: DataFrame, target: DataFrame) -> DataFrame:
    b, t = base.select("id", F.col("payload").alias("old")), target.select("id", F.col("payload").alias("new"), F.lit(True).alias("there"))
    same = F.col("old").eqNullSafe(F.col("new"))
    return b.join(t, "id", "full_outer").agg(F.count_if(F.col("there").isNotNull() & ~same).alias("upserts"), F.count_if(F.col("there").isNull()).alias("deletes"), F.count_if(F.col("there").isNotNull() & same).alias("unchanged"))


def apply_delta(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base after the delta: equals the target."""
    kept = base.select("id", "payload").join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(changes.filter("op = 'upsert'").select("id", "payload"))
