"""Decision packets: the materials of each relation with their roles, merged where they say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scope as S
from ..sources.tables import materialise


def _roles():
    kind, pos = F.col("kind"), F.col("position")
    two = lambda a, b: F.struct(F.lit(a).alias("s"), F.lit(b).alias("t"))
    return (
        F.when(kind.isin("approves", "records_execution_of", "evaluates"), two("verifier", "governing")).when(kind == "implements_decision", two("governing", "verifier"))
        .when(pos == "dominates", two("governing", "excluded")).when(pos == "conditional", two("governing", "governing")).when(pos == "non_effective", two("excluded", "governing")).otherwise(two("contender", "contender"))
    )


def materials(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(relation_id, source_id, role, evidence_ids): both ends with their role; sources of a relation's evidence that
    are neither end are verifiers. ``evidence``: (id, source_id, evidence_id) of relations."""
    r = relations.select("id", "source_id", "target_id", _roles().alias("r"))
    ends = r.select("id", F.explode(F.array(F.struct(F.col("source_id").alias("source_id"), F.col("r.s").alias("role")), F.struct(F.col("target_id").alias("source_id"), F.col("r.t").alias("role")))).alias("m")).select("id", "m.source_id", "m.role")
    refs = evidence.select("id", "source_id", "evidence_id").join(relations.select("id"), "id", "left_semi")
    third = refs.join(ends.select("id", "source_id"), ["id", "source_id"], "left_anti").select("id", "source_id", F.lit("verifier").alias("role")).distinct()
    return ends.unionByName(third).join(refs, ["id", "source_id"], "left").groupBy(F.col("id").alias("relation_id"), "source_id", "role").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))


def build_packets(relations: DataFrame, evidence: DataFrame, intent_id: str) -> DataFrame:
    """One packet for each distinct set of (source, role): (id, intent_id, relation_ids, materials), the id being that of
    the first relation merged into it."""
    m = materials(relations, evidence)
    sets = m.groupBy("relation_id").agg(F.sort_array(F.collect_set(F.concat_ws("\u0001", "source_id", "role"))).alias("signature"))
    groups = sets.groupBy("signature").agg(F.sort_array(F.collect_list("relation_id")).alias("relation_ids"))
    rows = groups.select("relation_ids", F.explode("relation_ids").alias("relation_id")).join(m, "relation_id")
    merged = rows.groupBy("relation_ids", "source_id", "role").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))
    packed = merged.groupBy("relation_ids").agg(F.sort_array(F.collect_list(F.struct("source_id", "role", "evidence_ids"))).alias("materials"))
    return packed.select(F.concat(F.lit(f"packet:{intent_id}:"), F.element_at("relation_ids", 1)).alias("id"), F.lit(intent_id).alias("intent_id"), "relation_ids", "materials")


def complementary_merge(packets: DataFrame, relations: DataFrame) -> DataFrame:
    """Packets merged until nothing changes: one without an excluded source that holds a relation of precedence takes in
    one with an excluded source that holds a non-effective proposal, if they share a governing source, give no source two
    roles, and two of their relations have equivalent scopes or one refining the other. In a round each packet meets the
    first partner by id; what was taken in is gone, so there are at most as many rounds as packets that can be merged."""
    none = F.array().cast("array<string>")
    clauses = F.concat(F.coalesce("source_clauses", none), F.coalesce("target_clauses", none))
    rel = relations.select(F.col("id").alias("relation_id"), S.expresses_precedence(F.col("kind"), F.col("position"), clauses).alias("precedes"), ((F.col("kind") == "proposes_change_to") & (F.col("position") == "non_effective")).alias("proposes"), "scope")
    while True:
        m = packets.select("id", F.explode("materials").alias("m")).select("id", "m.source_id", "m.role")
        r = packets.select("id", F.explode("relation_ids").alias("relation_id")).join(rel, "relation_id")
        marks = r.groupBy("id").agg(F.max("precedes").alias("precedes"), F.max("proposes").alias("proposes"))
        kinds = m.groupBy("id").agg(F.max(F.col("role") == "excluded").alias("excludes")).join(marks, "id")
        gov = m.filter("role = 'governing'").join(kinds, "id")
        pairs = gov.filter("NOT excludes AND precedes").select(F.col("id").alias("c"), "source_id").join(gov.filter("excludes AND proposes").select(F.col("id").alias("x"), "source_id"), "source_id").select("c", "x").distinct()
        clash = pairs.join(m.select(F.col("id").alias("c"), "source_id", F.col("role").alias("rc")), "c").join(m.select(F.col("id").alias("x"), "source_id", F.col("role").alias("rx")), ["x", "source_id"]).filter("rc <> rx").select("c", "x").distinct()
        scoped = pairs.join(r.select(F.col("id").alias("c"), F.col("scope").alias("cs")), "c").join(r.select(F.col("id").alias("x"), F.col("scope").alias("xs")), "x")
        near = scoped.filter(S.scopes_equivalent(F.col("cs"), F.col("xs")) | S.strict_refinement(F.col("cs"), F.col("xs")) | S.strict_refinement(F.col("xs"), F.col("cs"))).select("c", "x").distinct()
        good = near.join(clash, ["c", "x"], "left_anti").groupBy("x").agg(F.min("c").alias("c"))
        good = materialise(good.groupBy("c").agg(F.min("x").alias("x")))
        if good.isEmpty():
            return packets
        to = good.select(F.col("x").alias("id"), F.col("c").alias("into"))
        rows = packets.join(to, "id", "left").withColumn("key", F.coalesce("into", "id"))
        mats = rows.select("key", F.explode("materials").alias("m")).groupBy("key", "m.source_id", "m.role").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.evidence_ids")))).alias("evidence_ids"))
        mats = mats.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("source_id", "role", "evidence_ids"))).alias("materials"))
        ids = rows.groupBy("key").agg(F.first("intent_id").alias("intent_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("relation_ids")))).alias("relation_ids"))
        packets = materialise(ids.join(mats, "key").select(F.col("key").alias("id"), "intent_id", "relation_ids", "materials"))


def render(packets: DataFrame, units: DataFrame) -> DataFrame:
    """(id, text): the relations, then excerpts, those of verifiers first."""
    m = packets.select("id", "relation_ids", F.explode("materials").alias("m")).select("id", "relation_ids", "m.source_id", "m.role", F.explode_outer("m.evidence_ids").alias("evidence_id"))
    rows = m.join(units.select("evidence_id", "text"), "evidence_id", "left")
    line = F.struct((F.col("role") != "verifier").alias("later"), "source_id", "evidence_id", F.concat(F.lit("["), "role", F.lit("] "), F.coalesce("text", F.lit(""))).alias("s"))
    return rows.groupBy("id", "relation_ids").agg(F.array_sort(F.collect_list(line)).alias("ls")).select("id", F.concat_ws("\n", F.concat(F.lit("relations: "), F.array_join("relation_ids", ", ")), F.transform("ls", lambda x: x["s"])).alias("text"))
