"""Queries whose intermediate rows must grow with the input and no faster."""

from pyspark.sql import functions as F

from attestor.operators import candidates as C
from attestor.operators import claims as CL
from attestor.operators import export as EX
from attestor.operators import relations as R


def most_rows(df):
    """The rows of df, and the most rows that any node of its executed plan gave."""
    rows = df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        n = node.metrics().get("numOutputRows")
        children = node.children()
        return max([n.get().value() if n.isDefined() else 0] + [walk(children.apply(i)) for i in range(children.size())])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def _dossier(spark, n):
    """n test records and n amendments of one dossier, and a second one in which each record's scope has one amendment."""
    k, kind = F.col("id"), F.when(F.col("id") % 2 == 0, "test_record").otherwise("specification_amendment")
    big = spark.range(2 * n).select(F.format_string("a%06d", k).alias("source_id"), F.lit("big").alias("scenario"), kind.alias("document_type"), F.array(F.lit("t"), F.concat(F.lit("u"), (k % 5).cast("string"))).alias("tokens"))
    small = spark.range(10).select(F.format_string("b%06d", k).alias("source_id"), F.lit("small").alias("scenario"), kind.alias("document_type"), F.array(F.lit("t"), F.concat(F.lit("u"), F.floor(k / 2).cast("string"))).alias("tokens"))
    return big.unionByName(small).withColumns({"purpose": F.lit("technical_spec"), "status": F.lit("current")})


def test_slots_of_a_large_dossier(spark):
    docs = _dossier(spark, 1500)
    rows, most = most_rows(R.required_slots(docs))
    assert sorted((r.source_id, r.target_id) for r in rows) == [(f"b{i:06}", f"b{i + 1:06}") for i in range(0, 10, 2)]
    assert most < 10 * 3010
    open_, most = most_rows(R.unresolved_slots(docs))
    assert sum(r.kind == "records_execution_of" for r in open_) == 1500 and most < 10 * 3010
    near, most = most_rows(R.slot_fallback_pairs(docs))
    assert len(near) == 1500 * 32 and {r.target_id for r in near} == {f"a{i:06}" for i in range(1, 65, 2)} and most <= len(near)
    rel = docs.filter("document_type = 'test_record'").select(F.concat(F.lit("r"), "source_id").alias("id"), F.lit("records_execution_of").alias("kind"), "source_id", F.regexp_replace("source_id", "^a.*", "a000001").alias("target_id"))
    kept, most = most_rows(R.slot_shape_filter(rel, docs))
    assert len(kept) == 1500 and most < 10 * 3010


def test_positions_on_a_common_document_id(spark):
    """All profiles share one document id; the first two are targets, each revision's first of those that ask for it."""
    k = F.col("id")
    p = spark.range(2000).select(F.format_string("s%05d", k).alias("source_id"), k.alias("ordinal"), F.lit("D").alias("document_id"), (k % 3).cast("string").alias("revision"))
    s = p.select("source_id", F.lit("dominates").alias("position"), F.lit("D").alias("position_target_document_id"), F.when(F.col("ordinal") % 2 == 1, F.col("revision")).alias("position_target_revision"))
    rows, most = most_rows(R.front_matter_positions(s, p))
    want = {f"s{i:05}": f"s{(i % 3 if i != i % 3 else i + 3) if i % 2 else int(i == 0):05}" for i in range(2000)}
    assert {r.source_id: r.target_id for r in rows} == want and len(rows) == 2000
    assert most < 10 * 2000


def test_conflicts_post_subjects_and_not_claims(spark):
    """50 subjects of 12 claims each, and one claim whose subject ends in the first of them."""
    k, none = F.col("id"), F.lit(None).cast("string")
    c = spark.range(601).select(k.cast("string").alias("id"), F.when(k == 600, "of the refund window number 000").otherwise(F.format_string("refund window number %03d", k % 50)).alias("subject"), F.lit("retention_period").alias("predicate"), F.when(k < 50, "5日").otherwise("7日").alias("object"))
    c = c.withColumns({**{x: none for x in ("condition", "valid_from", "valid_to", "authority", "status")}, "evidence": F.array(F.struct(F.lit("s").alias("source_id"), F.col("id").alias("evidence_id")))})
    rows, most = most_rows(CL.conflict_pairs(c))
    assert len(rows) == len({(r.l_id, r.r_id) for r in rows}) == 50 * 11 + 1 and all(r.l_id < r.r_id and r.l_object != r.r_object for r in rows)
    assert {(r.l_id, r.l_object, r.r_id, r.r_object) for r in rows if "600" in (r.l_id, r.r_id)} == {("0", "5日", "600", "7日")}
    assert most < 3 * 601


def test_units_meet_claims_and_not_conflicts(spark):
    """50 claims on 40 units each; every claim is in 20 conflicts."""
    k = F.col("id")
    refs = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda u: F.struct(F.lit("s").alias("source_id"), F.concat_ws("-", k.cast("string"), u.cast("string")).alias("evidence_id")))
    claims = spark.range(50).select(k.cast("string").alias("id"), refs.alias("evidence"))
    units = claims.select(F.explode("evidence").alias("r")).select("r.*", F.lit("t").alias("text"))
    con = spark.range(500).select(F.format_string("c%03d", k).alias("conflict_id"), (k % 50).cast("string").alias("l_id"), ((k + 1 + F.floor(k / 50)) % 50).cast("string").alias("r_id"))
    rows, most = most_rows(EX.export_units(units, claims, con))
    want = {c: sorted(f"c{i:03}" for i in range(500) if c in (i % 50, (i + 1 + i // 50) % 50)) for c in range(50)}
    assert len(rows) == 2000 and all(r.conflict_ids == want[int(r.id[5:].split("-")[0])] and len(r.claim_ids) == 1 for r in rows)
    assert most <= 2000


def test_references_shuffle_ids_and_not_words(spark):
    """500 texts of 400 words, most of them one word; each names 70 ids in falling order, its own and an ambiguous one."""
    k, name = F.col("id"), lambda i: F.format_string("D-%03d", i)
    p = spark.range(500).select(F.format_string("s%03d", k).alias("source_id"), F.when(k < 490, name(F.least(k, F.lit(480)))).alias("document_id"))
    told = F.array_join(F.transform(F.sequence(F.lit(70), F.lit(0), F.lit(-1)), lambda j: name((k + j) % 490)), ", ")
    common = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.when(i % 2 == 0, "the").otherwise(F.concat(F.lit("w"), i.cast("string"))))
    first = spark.range(500).select(F.format_string("s%03d", k).alias("source_id"), F.lit(1).cast("long").alias("line_start"), F.array_join(common, " ").alias("text"))
    units = first.unionByName(first.select("source_id", F.lit(2).cast("long").alias("line_start"), F.lit(None).cast("string").alias("text"))).unionByName(
        spark.range(500).select(F.format_string("s%03d", k).alias("source_id"), F.lit(3).cast("long").alias("line_start"), told.alias("text"))
    )
    refs = C.body_references(units, p)
    told_by = {i: [(i + j) % 490 for j in range(70, -1, -1)] for i in range(500)}
    want = {(f"s{i:03}", f"s{x:03}") for i in told_by for x in [x for x in told_by[i] if x < 480 and x != i][:64]}
    rows = refs.collect()
    assert len(rows) == len(want) and {(r.source_id, r.target_id) for r in rows} == want
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    passed = C.maybe_ids(units.select("source_id", "line_start", F.posexplode(F.split("text", "[ ,]+")).alias("p", "document_id")), p.select("document_id"))
    assert passed.filter("document_id LIKE 'D-%'").count() > 500 * 60 and passed.filter("document_id NOT LIKE 'D-%'").count() < 500 * 400 / 100
