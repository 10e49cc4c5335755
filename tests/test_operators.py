import pytest
from pyspark.sql import functions as F

from attestor.functions import scope as S
from attestor.operators import candidates as C
from attestor.operators import claims as CL
from attestor.operators import export as EX
from attestor.operators import packets as P
from attestor.operators import parse as PA
from attestor.operators import rerank as RR
from attestor.operators import resolve as RE


@pytest.mark.parametrize(("n", "size", "edges"), [(320, 32, 4960), (5000, 32, 77404), (100, 1000, 0)])
def test_candidate_graph_bounds(spark, n, size, edges):
    p = spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("source_id"), F.lit("scope").alias("key_kind"), F.floor(F.col("id") / size).cast("string").alias("key"))
    g = C.candidate_graph(p)
    assert g.count() == edges
    assert "CartesianProduct" not in g._jdf.queryExecution().toString()


def test_rerank_order(spark):
    roles = [None, "excluded", "contender", None, "verifier", "governing", None, None]
    df = spark.createDataFrame([(1, i + 1, "abcdefgh"[i], r) for i, r in enumerate(roles)], "query_id int, rank int, name string, role string")
    assert "".join(r.name for r in RR.soft_rerank(df).orderBy("new_rank").collect()) == "afedcgbh"
    with pytest.raises(Exception, match="at most 20"):
        RR.soft_rerank(spark.range(21).select(F.lit(1).alias("query_id"), F.col("id").alias("rank"), F.lit(None).cast("string").alias("role"))).collect()


def test_primary_role(spark):
    df = spark.createDataFrame([("a", "governing"), ("a", "excluded"), ("b", "verifier"), ("b", "governing")], "source_id string, role string")
    assert {(r.source_id, r.role) for r in RR.primary_role(df).collect()} == {("a", "excluded"), ("b", "verifier")}


def test_markdown_headings(spark):
    text = "---\na: 1\n---\n# T\n\npara\nmore\n\n## S\n- x\n- y\n# U\n### V\nz\n"
    rows = PA.parse_markdown(spark.createDataFrame([("s", "p", text)], "source_id string, path string, text string")).orderBy("line_start").collect()
    assert [(r.kind, r.line_start, r.line_end, list(r.heading_path)) for r in rows] == [
        ("metadata", 1, 3, []), ("heading", 4, 4, ["T"]), ("paragraph", 6, 7, ["T"]), ("heading", 9, 9, ["T", "S"]), ("list", 10, 11, ["T", "S"]), ("heading", 12, 12, ["U"]), ("heading", 13, 13, ["U", "V"]), ("paragraph", 14, 14, ["U", "V"]),
    ]


def test_delta_round_trip(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "id string, payload string")
    b = spark.createDataFrame([("2", "z"), ("3", None), ("4", "w")], "id string, payload string")
    assert EX.delta_summary(a, b).first().asDict() == {"upserts": 2, "deletes": 1, "unchanged": 1}
    assert sorted(EX.apply_delta(a, EX.delta(a, b)).collect()) == sorted(b.collect())
    assert EX.delta(a, a).count() == 0
    with pytest.raises(ValueError):
        EX.assert_unique(a.union(a))


def _node(disposition="reference", role="normative", approved=True, official=None, known=True):
    return {"disposition": disposition, "reasons": [], "path": [], "role": role, "approved": approved, "official": official, "known": known}


def _edge(kind, s="a", t="b", position="unresolved", active=True, clause=True, id="e"):
    return {"id": id, "kind": kind, "position": position, "source_id": s, "target_id": t, "active": active, "clause": clause}


@pytest.mark.parametrize(
    ("edge", "source", "target"),
    [
        (_edge("operational_position", position="dominates"), "canonical", "reference"), (_edge("operational_position", position="conditional"), "instance_exception", "canonical"),
        (_edge("operational_position", position="non_effective"), "excluded", "canonical"), (_edge("operational_position"), "unresolved", "unresolved"), (_edge("supersedes"), "canonical", "historical"),
        (_edge("amends"), "canonical", "canonical"), (_edge("exception_to"), "instance_exception", "canonical"), (_edge("order_of_precedence"), "canonical", "reference"), (_edge("records_execution_of"), "execution_record", "reference"),
        (_edge("evaluates"), "reference", "reference"), (_edge("amends", clause=False), "reference", "canonical"), (_edge("order_of_precedence", clause=False), "reference", "canonical"), (_edge("exception_to", active=False), "reference", "reference"),
    ],
)
def test_fold(edge, source, target):
    state = {"a": _node(), "b": _node()}
    RE.fold_edges(state, [edge], {"normative"})
    assert (state["a"]["disposition"], state["b"]["disposition"]) == (source, target)


def test_fold_chain_and_guards():
    for order in ((0, 1), (1, 0)):  # an amended amendment steps back whatever the order
        state = {"a": _node(), "b": _node(), "c": _node()}
        edges = [_edge("amends", "a", "b", id="1"), _edge("amends", "b", "c", id="2")]
        RE.fold_edges(state, [edges[i] for i in order], {"normative"})
        assert [state[k]["disposition"] for k in "abc"] == ["canonical", "reference", "canonical"]
    state = {"a": _node(approved=False), "b": _node()}
    RE.fold_edges(state, [_edge("supersedes")], {"normative"})
    assert state["a"]["reasons"] == ["relation_invalid"] and state["b"]["disposition"] == "reference"
    state = {"a": _node("execution_record", "record", official=False), "b": _node("reference", "record", official=True)}
    RE.fold_edges(state, [_edge("derived_from")], {"record"})
    assert (state["a"]["disposition"], state["b"]["disposition"]) == ("excluded", "canonical")


def test_resolvers_with_relations(spark):
    cand = spark.createDataFrame([("c", 1, "a", 0.9), ("c", 2, "b", 0.8), ("c", 3, "x", 0.7)], "case_id string, ordinal long, source_id string, relevance double")
    ctx = spark.createDataFrame([("c", "i", "2024-05-01")], "case_id string, intent_id string, as_of string").withColumns({"requested_roles": F.array(F.lit("normative")), "requested_clauses": F.array().cast("array<string>"), "scope": S.scope_of()})
    prof = spark.createDataFrame([("a", "normative", "mandatory", 1, True), ("b", "normative", "mandatory", 1, True)], "source_id string, role string, level string, authority_rank int, approved boolean").withColumns({"scope": S.scope_of(), "valid_from": F.lit(None).cast("string"), "valid_to": F.lit(None).cast("string"), "official_record": F.lit(None).cast("boolean")})
    rel = spark.createDataFrame([("r", "supersedes", "dominates", "b", "a")], "id string, kind string, position string, source_id string, target_id string").withColumns({"source_clauses": F.array().cast("array<string>"), "target_clauses": F.array().cast("array<string>"), "scope": S.scope_of(), "valid_from": F.lit(None).cast("string"), "valid_to": F.lit(None).cast("string")})
    s2 = {r.source_id: r.disposition for r in RE.resolve_s2(cand, ctx, prof).collect()}
    s3 = {r.source_id: r.disposition for r in RE.resolve_s3(cand, ctx, prof, rel).collect()}
    assert s2 == {"a": "canonical", "b": "reference", "x": "unresolved"} and s3 == {"a": "historical", "b": "canonical", "x": "unresolved"}


def test_suffix_subjects_conflict(spark):
    rows = [("1", "refund window", "retention_period", "5日"), ("2", "the refund window", "retention_period", "7日"), ("3", "dow", "retention_period", "9日"), ("4", "refund window", "retention_period", "５日")]
    c = spark.createDataFrame(rows, "id string, subject string, predicate string, object string").withColumns({**{x: F.lit(None).cast("string") for x in ("condition", "valid_from", "valid_to", "authority", "status")}, "evidence": F.array(F.struct(F.col("id").alias("source_id"), F.lit("e").alias("evidence_id")))})
    got = {(r.l_id, r.r_id) for r in CL.conflict_pairs(c).collect()}
    assert ("1", "2") in got and ("2", "4") in got and not any("3" in p for p in got)


def test_greedy_batches(spark):
    e = spark.createDataFrame([("d", f"a{i:02}", f"b{i:02}") for i in range(20)], "dossier string, a string, b string")
    assert [r.n for r in C.bounded_batches(e).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [6, 6, 6, 2]


@pytest.mark.parametrize(("documents", "edges"), [(320, 4960), (5000, 77404)])
def test_candidate_edges_stay_linear(spark, documents, edges):
    """Scopes of 32 documents each: all pairs inside them, and no others."""
    p = spark.range(documents).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("source_id"), F.lit("scope").alias("key_kind"), F.floor(F.col("id") / 32).cast("string").alias("key"))
    assert C.candidate_graph(p).count() == edges


def test_a_common_scope_makes_no_edges(spark):
    p = spark.range(100).select(F.col("id").cast("string").alias("source_id"), F.lit("scope").alias("key_kind"), F.lit("all").alias("key"))
    assert C.candidate_graph(p).count() == 0
