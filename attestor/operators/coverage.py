"""Relations that a family of documents implies, by rules that ask for types, roles, approval, scopes and textual proof.

Every rule is a join over candidate pairs of documents, which are bounded for each document (``coverage_pairs``); proof
comes from claims of both documents (``claim_pairs``) or from units of text. Documents hold source_id, document_type, role,
approved, official_record, authority_rank, scope, valid_from and valid_to; units source_id, evidence_id, line_start, text
and heading_path; relations their full schema with evidence as an array of (source_id, evidence_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import text as X
from ..sources.tables import materialise
from . import relations as R

#: Candidates of one document at most: neighbours in the candidate graph and documents of a dossier.
COVERAGE_CAP = 32 + 12
MATCH_UNITS = 16
RELATION = ("id", "kind", "position", "source_id", "target_id", "source_clauses", "target_clauses", "scope", "valid_from", "valid_to", "evidence")


def coverage_pairs(graph: DataFrame, relations: DataFrame, cap: int = COVERAGE_CAP) -> DataFrame:
    """(source_id, target_id), both ways, of the candidate graph's edges (a, b) and of the relations' ends: the first
    ``cap`` of each source, edges of the graph before relations, in order of the pair."""
    edges = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("turn"))
    edges = edges.unionByName(relations.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.lit(1).alias("turn")))
    edges = edges.filter("a <> b").groupBy("a", "b").agg(F.min("turn").alias("turn"))
    both = edges.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "turn", "a", "b").unionByName(edges.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), "turn", "a", "b"))
    w = Window.partitionBy("source_id").orderBy("turn", "a", "b")
    return both.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).select("source_id", "target_id")


def _evidence(*refs: Column) -> Column:
    return F.array_compact(F.array(*refs))


def _ref(source: Column, unit: Column) -> Column:
    return F.when(unit.isNotNull(), F.struct(source.alias("source_id"), unit.alias("evidence_id")))


def _literal(*clauses: str) -> Column:
    return F.array(*[F.lit(c) for c in clauses]) if clauses else F.array().cast("array<string>")


def _made(rows: DataFrame, kind: str, position: str, source_clauses: Column, target_clauses: Column, of: str = "s", dates: str = "s", evidence: Column | None = None) -> DataFrame:
    """Edges of rows that hold s (source document), t (target document) and evidence; scope and dates of the named one."""
    return rows.select(
        F.concat(F.lit("coverage_"), F.substring(F.sha2(F.concat_ws(":", "s.source_id", "t.source_id", F.lit(kind)), 256), 1, 16)).alias("id"), F.lit(kind).alias("kind"), F.lit(position).alias("position"),
        F.col("s.source_id").alias("source_id"), F.col("t.source_id").alias("target_id"), source_clauses.alias("source_clauses"), target_clauses.alias("target_clauses"), F.col(f"{of}.scope").alias("scope"),
        F.col(f"{dates}.valid_from").alias("valid_from"), F.col(f"{dates}.valid_to").alias("valid_to"), (evidence if evidence is not None else F.col("evidence")).alias("evidence"),
    )


def _only(rows: DataFrame) -> DataFrame:
    """Rows of sources that have one candidate."""
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s.source_id"))).filter("n = 1").drop("n")


def _without(edges: DataFrame, existing: DataFrame) -> DataFrame:
    return edges.join(existing.select("source_id", "target_id", "kind").distinct(), ["source_id", "target_id", "kind"], "left_anti").select(*RELATION)


def _shortest(units: DataFrame, alias: str) -> DataFrame:
    """(source_id, alias) of the unit with the least text of each source, the earlier of equals."""
    key = F.struct(F.char_length("text").alias("n"), "line_start", "evidence_id", "text", F.try_element_at(F.col("heading_path"), F.lit(-1)).alias("heading"))
    return units.groupBy("source_id").agg(F.min(key).alias(alias))


def _earliest(units: DataFrame, alias: str) -> DataFrame:
    return units.groupBy("source_id").agg(F.min(F.struct("line_start", "evidence_id", F.try_element_at(F.col("heading_path"), F.lit(-1)).alias("heading"))).alias(alias))


def drop_absorbed_conflicts(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """a: relations without conflicts between two documents, in the same direction, that an approved amendment of a
    specification amends, itself approved, with overlapping clauses."""
    ok = docs.filter("approved")
    am = relations.filter("kind = 'amends'").join(ok.filter("document_type = 'specification_amendment'").select("source_id"), "source_id", "left_semi").join(ok.select(F.col("source_id").alias("target_id")), "target_id", "left_semi")
    am = am.select("source_id", "target_id", F.concat("source_clauses", "target_clauses").alias("amended"))
    gone = relations.filter("kind = 'conflicts_with'").join(am, ["source_id", "target_id"]).filter(S.clauses_overlap(F.concat("source_clauses", "target_clauses"), F.col("amended"))).select("id").distinct()
    return relations.join(gone, "id", "left_anti").select(*relations.columns)


def family_coverage(relations: DataFrame, docs: DataFrame, claims: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relations after all rules: conflicts that an amendment absorbs go (a); vendor proposals (b), work instructions (c),
    temporary deviations (d), precedence among instructions (e), execution logs (f), stale FAQs (g), test records (h),
    technical drafts (i) and decisions (j) get the edges that their documents prove. Rules c, d, f, h, i and j need a
    single candidate. A rule adds no edge of a kind that two documents already have in that direction."""
    relations = materialise(drop_absorbed_conflicts(relations.select(*RELATION), docs))
    doc = F.struct("source_id", "document_type", "role", F.coalesce("approved", F.lit(False)).alias("approved"), "official_record", F.coalesce("authority_rank", F.lit(0)).alias("rank"), "scope", "valid_from", "valid_to")
    side = lambda a: docs.select(F.col("source_id").alias("source_id" if a == "s" else "target_id"), doc.alias(a))
    near = pairs.join(side("s"), "source_id").join(side("t"), "target_id")
    same, inside = S.scopes_equivalent(F.col("s.scope"), F.col("t.scope")), S.strict_refinement(F.col("s.scope"), F.col("t.scope"))
    text = X.trim(F.col("text"))
    says = lambda *words: [F.contains("text", F.lit(w)) for w in words]
    under = lambda word: F.exists("heading_path", lambda h: F.contains(h, F.lit(word)))

    def proof_of(agree: bool) -> DataFrame:
        """(source_id, target_id, score, evidence): the claims of candidates that agree, or don't, computed once."""
        best = R.claim_pairs(near.select("source_id", "target_id"), claims, agree)
        refs = claims.select("id", "evidence")
        best = best.join(refs.select(F.col("id").alias("source_claim"), F.col("evidence").alias("se")), "source_claim").join(refs.select(F.col("id").alias("target_claim"), F.col("evidence").alias("te")), "target_claim")
        own = lambda c, end: F.transform(F.filter(c, lambda r: r["source_id"] == F.col(end)), lambda r: F.struct(r["source_id"].alias("source_id"), r["evidence_id"].alias("evidence_id")))
        return materialise(best.select("source_id", "target_id", "score", F.concat(own("se", "source_id"), own("te", "target_id")).alias("evidence")).filter(F.size("evidence") > 0))

    near = materialise(near.withColumns({"same": same, "inside": inside}))
    same, inside = F.col("same"), F.col("inside")
    proofs = {agree: proof_of(agree) for agree in (True, False)}

    def with_claims(rows: DataFrame, agree: bool) -> DataFrame:
        return rows.join(proofs[agree], ["source_id", "target_id"])

    # b: an unapproved proposal of a vendor that speaks of a contract change and a signature
    signed = _earliest(units.filter(says("契約変更")[0] & says("署名")[0]), "p")
    offers = units.filter(F.contains(F.coalesce(F.try_element_at(F.col("heading_path"), F.lit(-1)), F.lit("")), F.lit("提案")) & ~text.startswith("#") & (says("提示")[0] | says("提案")[0]) & ~says("この節では")[0])
    b = near.filter("s.document_type = 'vendor_proposal' AND s.role = 'proposal' AND NOT s.approved AND t.document_type IN ('master_agreement', 'master_contract') AND t.role = 'normative' AND t.approved").filter(same | inside)
    b = b.join(signed, "source_id").join(_shortest(offers, "v"), "source_id", "left")
    b = _made(b, "proposes_change_to", "non_effective", F.array_compact(F.array("p.heading")), _literal(), evidence=_evidence(_ref(F.col("s.source_id"), F.col("p.evidence_id")), _ref(F.col("s.source_id"), F.col("v.evidence_id"))))
    # c and d: instructions that refine a procedure: agreeing claims apply it, contradicting ones are an exception
    refined = near.filter("s.role = 'instruction' AND s.approved AND t.document_type = 'operating_procedure' AND t.role = 'instruction' AND t.approved").filter(inside)
    c = _made(_only(with_claims(refined.filter("s.document_type = 'work_instruction'"), True)), "applies_to", "conditional", _literal("現場指示"), _literal("標準手順"))
    d = _made(_only(with_claims(refined.filter("s.document_type = 'temporary_deviation'"), False)), "exception_to", "conditional", _literal("例外規則"), _literal("標準手順"))
    c, d, b = _without(c, relations), _without(d, relations), _without(b, relations)
    # e: precedence of a narrower over a broader instruction also applies it, with the precedence's own proof
    c = materialise(c)
    ends = relations.join(side("s"), "source_id").join(side("t"), "target_id").withColumns({"same": S.scopes_equivalent(F.col("s.scope"), F.col("t.scope")), "inside": S.strict_refinement(F.col("s.scope"), F.col("t.scope"))})
    proven = F.exists("evidence", lambda r: r["source_id"] == F.col("source_id"))
    e = ends.filter("kind = 'order_of_precedence' AND s.role = 'instruction' AND t.role = 'instruction' AND s.approved AND t.approved AND s.rank < t.rank").filter(inside & proven)
    e = R.first_wins(_carried(e, "applies_to", "conditional"), ["source_id", "target_id"], "of")
    e = _without(e, relations.unionByName(c))
    # f: official logs of an approved deviation of the same scope, by agreeing claims or by a proven position
    official = near.filter("s.role = 'record' AND s.official_record AND t.approved").filter(same)
    f1 = _made(_only(with_claims(official.filter("s.document_type = 'execution_log' AND t.document_type = 'temporary_deviation' AND t.role = 'instruction'"), True)), "records_execution_of", "non_effective", _literal("実施結果"), _literal("例外規則"))
    f1 = materialise(_without(f1, relations))
    f2 = ends.filter("kind = 'operational_position' AND position = 'non_effective' AND s.document_type = 'execution_log' AND t.document_type = 'temporary_deviation' AND s.role = 'record' AND s.official_record AND t.role = 'instruction' AND t.approved").filter(same & proven)
    f2 = _without(R.first_wins(_carried(f2, "records_execution_of", "non_effective", own_dates=True), ["source_id", "target_id"], "of"), relations.unionByName(f1))
    # h: official test records of an approved amendment, the same way
    h = _made(_only(with_claims(official.filter("s.document_type = 'test_record' AND t.document_type = 'specification_amendment' AND t.role = 'normative'"), True)), "records_execution_of", "non_effective", _literal("判定"), _literal("変更値"), of="t")
    h = _without(h, relations.unionByName(f1).unionByName(f2))
    # g: a stale FAQ conflicts with the norm that alone contradicts it best, and with no other
    stale = units.filter(says("反映していない")[0] | F.contains(F.lower("text"), F.lit("stale"))).select("source_id").distinct()
    g = with_claims(near.filter("s.document_type = 'faq' AND s.role = 'communication' AND t.role = 'normative' AND t.approved").filter(same).join(stale, "source_id", "left_semi"), False)
    g = g.withColumn("best", F.max("score").over(Window.partitionBy("source_id"))).filter("score = best")
    g = materialise(_only(g))
    corrected = g.select("source_id", F.col("target_id").alias("right"))
    g = _without(_made(g, "conflicts_with", "non_effective", _literal("旧案内"), _literal("現行規則"), of="t", dates="t"), relations)
    relations = relations.join(corrected, "source_id", "left").filter("kind <> 'conflicts_with' OR right IS NULL OR right = target_id").select(*RELATION)
    # i: an unapproved draft whose purpose names a topic that a single approved specification speaks of
    topics = units.filter(under("検討目的") & says("の次期改訂")[0]).withColumn("topic", X.trim(F.substring_index("text", "の次期改訂", 1))).filter(F.char_length("topic") >= 6)
    topics = topics.groupBy("source_id").agg(F.min(F.struct(F.char_length("topic").alias("n"), "line_start", "evidence_id", "topic")).alias("w"))
    status = _earliest(units.filter(says("未承認")[0] & (says("適用")[0] | says("正式")[0])), "u")
    i = near.filter("s.document_type = 'technical_draft' AND s.role = 'proposal' AND NOT s.approved AND t.document_type = 'technical_specification' AND t.role = 'normative' AND t.approved").join(topics, "source_id")
    spoken = units.select(F.col("source_id").alias("target_id"), "text", "line_start", F.col("evidence_id").alias("unit"), F.try_element_at(F.col("heading_path"), F.lit(-1)).alias("heading"))
    spoken = i.select("source_id", "target_id", "w.topic").join(spoken, "target_id").filter(F.contains("text", F.col("topic"))).groupBy("source_id", "target_id").agg(F.min(F.struct(F.char_length("text").alias("n"), "line_start", "unit", "heading")).alias("x"))
    i = _only(i.join(spoken, ["source_id", "target_id"])).join(status, "source_id")
    proof = _evidence(_ref(F.col("s.source_id"), F.col("w.evidence_id")), _ref(F.col("s.source_id"), F.col("u.evidence_id")), _ref(F.col("t.source_id"), F.col("x.unit")))
    i = _without(_made(i, "proposes_change_to", "non_effective", _literal("検討目的", "承認状態"), F.array_compact(F.array("x.heading")), of="t", evidence=proof), relations.unionByName(b))
    # j: official minutes and the single approved plan that quotes what they decided
    first = lambda u: u.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("line_start"))).filter(F.col("n") <= MATCH_UNITS)
    quoted = lambda u, end: first(u).select(F.col("source_id").alias(end), F.col("evidence_id").alias(f"{end}_unit"), F.col("line_start").alias(f"{end}_line"), F.char_length("text").alias(f"{end}_n"), F.explode(X.quoted_phrases(F.col("text"))).alias("phrase"))
    minutes = quoted(units.filter(under("決定") & (says("正式採用")[0] | says("正式な実施方式")[0])), "source_id")
    plans = quoted(units.filter(under("採用方式") & says("実施方式")[0]), "target_id")
    j = near.filter("s.document_type = 'decision_minutes' AND s.role = 'record' AND s.approved AND s.official_record AND t.document_type = 'implementation_plan' AND t.role = 'instruction' AND t.approved")
    met = j.select("source_id", "target_id").join(minutes, "source_id").join(plans, ["target_id", "phrase"])
    met = met.groupBy("source_id", "target_id").agg(F.min(F.struct((F.col("source_id_n") + F.col("target_id_n")).alias("n"), "source_id_line", "target_id_line", F.col("source_id_unit").alias("su"), F.col("target_id_unit").alias("tu"))).alias("m"))
    j = _only(j.join(met, ["source_id", "target_id"])).withColumn("evidence", _evidence(_ref(F.col("source_id"), F.col("m.su")), _ref(F.col("target_id"), F.col("m.tu"))))
    back = j.select(F.col("t").alias("s"), F.col("s").alias("t"), "evidence")
    j = _made(j, "approves", "non_effective", _literal("決定"), _literal("採用方式"), of="t", dates="t").unionByName(_made(back, "implements_decision", "non_effective", _literal("決定"), _literal("採用方式")))
    j = _without(j, relations)
    for more in (b, c, d, e, f1, f2, g, h, i, j):
        relations = relations.unionByName(more)
    return relations


def _carried(rows: DataFrame, kind: str, position: str, own_dates: bool = False) -> DataFrame:
    """Edges with the clauses, dates and evidence of the relation that proves them; ``of`` is its id. Dates that it lacks
    are the source document's, unless own_dates."""
    date = lambda c: F.col(c) if own_dates else F.coalesce(F.col(c), F.col(f"s.{c}"))
    return rows.select(
        F.concat(F.lit("coverage_"), F.substring(F.sha2(F.concat_ws(":", "source_id", "target_id", F.lit(kind)), 256), 1, 16)).alias("id"), F.lit(kind).alias("kind"), F.lit(position).alias("position"), "source_id", "target_id",
        "source_clauses", "target_clauses", F.col("s.scope").alias("scope"), date("valid_from").alias("valid_from"), date("valid_to").alias("valid_to"), "evidence", F.col("id").alias("of"),
    )
