"""Small fixed cases for rules that the driver's tables have no text for; their SQL are the rows they must give."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scope as S

#: source_id, document type, role, approved, official record, authority rank, products, sites
DOCS = [
    ("amd", "specification_amendment", "normative", True, None, 5, ["p1"], []), ("spec", "technical_specification", "normative", True, None, 5, ["p1"], []),
    ("test", "test_record", "record", True, True, 1, ["p1"], []), ("test_copy", "test_record", "record", True, False, 1, ["p1"], []),
    ("offer", "vendor_proposal", "proposal", False, None, 1, ["p2"], ["s1"]), ("offer_unsigned", "vendor_proposal", "proposal", False, None, 1, ["p2"], []),
    ("contract", "master_agreement", "normative", True, None, 9, ["p2"], []), ("contract_draft", "master_agreement", "normative", False, None, 9, ["p2"], []),
    ("work", "work_instruction", "instruction", True, None, 2, ["p3"], ["s1"]), ("work_other", "work_instruction", "instruction", True, None, 2, ["p3"], ["s3"]),
    ("procedure", "operating_procedure", "instruction", True, None, 6, ["p3"], []), ("deviation", "temporary_deviation", "instruction", True, None, 3, ["p3"], ["s2"]),
    ("log", "execution_log", "record", True, True, 1, ["p3"], ["s2"]), ("log_position", "execution_log", "record", True, True, 1, ["p3"], ["s2"]),
    ("faq", "faq", "communication", True, None, 0, ["p4"], []), ("rule", "policy", "normative", True, None, 7, ["p4"], []), ("rule_other", "policy", "normative", True, None, 7, ["p4"], []),
    ("draft", "technical_draft", "proposal", False, None, 0, ["p5"], []), ("cooling", "technical_specification", "normative", True, None, 5, ["p6"], []),
    ("minutes", "decision_minutes", "record", True, True, 4, ["p7"], []), ("plan", "implementation_plan", "instruction", True, None, 4, ["p7"], []), ("plan_other", "implementation_plan", "instruction", True, None, 4, ["p7"], []),
]
#: source_id, line, headings, text; the unit's id is source and line
UNITS = [
    ("offer", 1, ["提案内容"], "月額を提案する"), ("offer", 2, ["提案内容"], "この節では提案を述べる"), ("offer", 3, ["前提"], "契約変更には署名が要る"), ("offer_unsigned", 1, ["前提"], "契約変更を望む"),
    ("faq", 1, ["案内"], "最新の規則を反映していない"), ("draft", 1, ["検討目的"], "冷却配管の設計の次期改訂を検討する"), ("draft", 2, ["状態"], "未承認のため適用しない"),
    ("cooling", 1, ["設計"], "冷却配管の設計は別紙の図面による"), ("cooling", 2, ["適用"], "冷却配管の設計を定める"), ("spec", 1, ["設計"], "配管の図面"),
    ("minutes", 1, ["決定事項"], "「段階移行方式」を正式採用する"), ("plan", 1, ["採用方式"], "実施方式は「段階移行方式」とする"), ("plan_other", 1, ["採用方式"], "実施方式は「一括移行方式」とする"),
]
#: id, subject, predicate, object, source_id
CLAIMS = [
    ("c01", "試験の判定", "result", "合格とする", "test"), ("c02", "試験の判定", "decision", "合格とする", "amd"), ("c03", "点検の体制", "staffing", "二人で行う", "work"), ("c04", "点検の体制", "crew", "二人で 行う", "procedure"),
    ("c05", "点検の間隔", "inspection_interval", "7日以内", "deviation"), ("c06", "点検の間隔", "inspection_interval", "5日以内", "procedure"), ("c07", "代替措置の完了", "state", "完了した", "log"), ("c08", "代替措置の完了", "outcome", "完了した", "deviation"),
    ("c09", "申請の期限", "request_deadline", "10日以内", "faq"), ("c10", "申請の期限", "request_deadline", "5日まで", "rule"), ("c11", "申請の", "request_deadline", "3日以内", "rule_other"),
    ("c12", "体制", "staffing", "三人で行う", "work_other"), ("c13", "申請の窓口", "contact", "総務", "faq"), ("c14", "申請の窓口", "contact", "人事", "rule_other"),
]
#: id, kind, position, source_id, target_id, source clauses, target clauses, units referred to
RELATIONS = [
    ("r1", "amends", "dominates", "amd", "spec", ["3.1"], ["3.1"], ["amd/1"]), ("r2", "conflicts_with", "unresolved", "amd", "spec", ["3.1"], [], ["amd/1"]), ("r3", "conflicts_with", "unresolved", "spec", "amd", ["3.1"], [], ["spec/1"]),
    ("r4", "conflicts_with", "unresolved", "amd", "spec", ["4"], [], ["amd/1"]), ("r5", "order_of_precedence", "conditional", "work_other", "procedure", ["優先"], ["標準"], ["work_other/1"]),
    ("r6", "operational_position", "non_effective", "log_position", "deviation", ["結果"], ["措置"], ["log_position/1"]), ("r7", "conflicts_with", "unresolved", "faq", "rule_other", [], [], ["faq/1"]),
]

#: Cases of the relation resolver. Candidates by name in order of relevance 0.9, 0.8, ...: role, approved, official record,
#: authority rank; relations in order: kind, position, source, target, clauses of the source, end of validity
CASES = {
    "amends": ("normative", ["c1"], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2)], [("amends", "dominates", "a", "b", ["c1"], None)]),
    "amends_other_clause": ("normative", ["c9"], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2)], [("amends", "dominates", "a", "b", ["c1"], None)]),
    "amends_chain_other_clause": ("normative", ["c9"], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2), ("c", "normative", True, None, 1)], [("amends", "dominates", "a", "b", ["c1"], None), ("amends", "dominates", "b", "c", ["c2"], None)]),
    "amends_chain": ("normative", [], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2), ("c", "normative", True, None, 1)], [("amends", "dominates", "b", "c", [], None), ("amends", "dominates", "a", "b", [], None)]),
    "target_amends_outside": ("normative", ["c9"], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2)], [("amends", "dominates", "a", "b", ["c1"], None), ("amends", "dominates", "b", "elsewhere", ["c2"], None)]),
    "order_decides": ("normative", [], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2)], [("order_of_precedence", "dominates", "b", "a", [], None), ("order_of_precedence", "dominates", "a", "b", [], None)]),
    "supersedes": ("normative", [], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2)], [("supersedes", "dominates", "a", "b", [], None)]),
    "superseded_source_is_mute": ("normative", [], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2), ("c", "normative", True, None, 1)], [("supersedes", "dominates", "a", "b", [], None), ("order_of_precedence", "dominates", "b", "c", [], None)]),
    "expired_exception": ("instruction", [], [("a", "instruction", True, None, 1), ("b", "instruction", True, None, 2)], [("exception_to", "conditional", "a", "b", [], "2023-01-01")]),
    "exception": ("instruction", [], [("a", "instruction", True, None, 1), ("b", "instruction", True, None, 2)], [("exception_to", "conditional", "a", "b", [], None)]),
    "unapproved_source": ("normative", [], [("a", "normative", False, None, 1), ("b", "normative", True, None, 2)], [("supersedes", "dominates", "a", "b", [], None)]),
    "unapproved_proposal": ("normative", [], [("a", "proposal", False, None, 1), ("b", "normative", True, None, 2)], [("proposes_change_to", "non_effective", "a", "b", [], None)]),
    "position_unresolved": ("normative", [], [("a", "normative", True, None, 1), ("b", "normative", True, None, 2)], [("operational_position", "unresolved", "a", "b", [], None)]),
    "applies_to_other_role": ("normative", [], [("a", "instruction", True, None, 1), ("b", "normative", True, None, 2)], [("applies_to", "conditional", "a", "b", [], None)]),
    "official_record": ("record", [], [("a", "record", True, True, 1), ("b", "record", True, True, 3), ("c", "record", True, False, 9)], []),
    "official_record_tie": ("record", [], [("a", "record", True, True, 3), ("b", "record", True, True, 3), ("c", "record", True, False, 9)], []),
    "official_record_not_asked": ("normative", [], [("a", "record", True, True, 1), ("c", "record", True, False, 9)], []),
    "official_record_without_copy": ("record", [], [("a", "record", True, True, 1), ("b", "record", True, None, 3)], []),
    "copy_of_official": ("normative", [], [("a", "normative", True, False, 1), ("b", "normative", True, True, 2)], [("derived_from", "non_effective", "a", "b", [], None)]),
    "copy_of_historical": ("normative", [], [("a", "normative", True, False, 1), ("b", "normative", True, True, 2), ("c", "normative", True, None, 1)], [("supersedes", "dominates", "c", "b", [], None), ("derived_from", "non_effective", "a", "b", [], None)]),
    "dominates": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('operational_position', 'dominates', 'a', 'b', [], None)]),
    "conditional": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('operational_position', 'conditional', 'a', 'b', [], None)]),
    "non_effective": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('operational_position', 'non_effective', 'a', 'b', [], None)]),
    "evaluates": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('evaluates', 'unresolved', 'a', 'b', [], None)]),
    "approves": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('approves', 'unresolved', 'a', 'b', [], None)]),
    "implements_decision": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('implements_decision', 'unresolved', 'a', 'b', [], None)]),
    "conflicts_with": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('conflicts_with', 'unresolved', 'a', 'b', [], None)]),
    "derived_from_other": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('derived_from', 'non_effective', 'a', 'b', [], None)]),
    "applies_to": ("normative", [], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('applies_to', 'conditional', 'a', 'b', [], None)]),
    "precedence_other_clause": ("normative", ['c9'], [('a', 'normative', True, None, 1), ('b', 'normative', True, None, 2)], [('order_of_precedence', 'dominates', 'a', 'b', ['c1'], None)]),
    "supersedes_other_role": ("normative", [], [('a', 'instruction', True, None, 1), ('b', 'normative', True, None, 2)], [('supersedes', 'dominates', 'a', 'b', [], None)]),
    "records_execution": ("instruction", [], [("a", "record", True, None, 1), ("b", "instruction", True, None, 2)], [("records_execution_of", "non_effective", "a", "b", [], None)]),
}
#: case, candidate, disposition, reasons behind those of the filters, relation path
OUTCOMES = [
    ("amends", "a", "canonical", "clause_amendment", "1"), ("amends", "b", "canonical", "clause_amendment", "1"), ("amends_other_clause", "a", "reference", "clause_amendment", ""), ("amends_other_clause", "b", "canonical", "", ""),
    ("amends_chain_other_clause", "a", "reference", "clause_amendment", ""), ("amends_chain_other_clause", "b", "reference", "clause_amendment", ""), ("amends_chain_other_clause", "c", "canonical", "", ""),
    ("amends_chain", "a", "canonical", "clause_amendment", "2"), ("amends_chain", "b", "reference", "clause_amendment", "1,2"), ("amends_chain", "c", "canonical", "clause_amendment", "1"),
    ("target_amends_outside", "a", "reference", "clause_amendment", ""), ("target_amends_outside", "b", "reference", "", ""), ("order_decides", "a", "canonical", "contract_precedence", "1,2"), ("order_decides", "b", "reference", "contract_precedence", "1,2"),
    ("supersedes", "a", "canonical", "superseded", "1"), ("supersedes", "b", "historical", "superseded", "1"), ("superseded_source_is_mute", "a", "canonical", "superseded", "1"), ("superseded_source_is_mute", "b", "historical", "superseded", "1"), ("superseded_source_is_mute", "c", "reference", "", ""),
    ("expired_exception", "a", "reference", "exception_scope_mismatch", ""), ("expired_exception", "b", "canonical", "", ""), ("exception", "a", "instance_exception", "applicable_exception", "1"), ("exception", "b", "canonical", "applicable_exception", "1"),
    ("unapproved_source", "a", "excluded", "relation_invalid", ""), ("unapproved_source", "b", "canonical", "", ""), ("unapproved_proposal", "a", "excluded", "", "1"), ("unapproved_proposal", "b", "canonical", "", "1"),
    ("position_unresolved", "a", "unresolved", "position_unresolved", "1"), ("position_unresolved", "b", "unresolved", "position_unresolved", "1"), ("applies_to_other_role", "a", "reference", "", "1"), ("applies_to_other_role", "b", "canonical", "", ""),
    ("official_record", "a", "execution_record", "", ""), ("official_record", "b", "canonical", "official_record", ""), ("official_record", "c", "excluded", "non_official_copy", ""), ("official_record_tie", "a", "canonical", "official_record", ""), ("official_record_tie", "b", "execution_record", "", ""),
    ("official_record_tie", "c", "excluded", "non_official_copy", ""), ("official_record_not_asked", "a", "execution_record", "", ""), ("official_record_not_asked", "c", "execution_record", "", ""), ("official_record_without_copy", "a", "execution_record", "", ""), ("official_record_without_copy", "b", "execution_record", "", ""),
    ("copy_of_official", "a", "excluded", "non_official_copy", "1"), ("copy_of_official", "b", "canonical", "official_record", "1"), ("copy_of_historical", "a", "excluded", "non_official_copy", "2"), ("copy_of_historical", "b", "historical", "superseded", "1,2"), ("copy_of_historical", "c", "canonical", "superseded", "1"),
    ('dominates', 'a', 'canonical', 'contract_precedence', '1'), ('dominates', 'b', 'reference', 'contract_precedence', '1'), ('conditional', 'a', 'instance_exception', 'applicable_exception', '1'), ('conditional', 'b', 'canonical', 'applicable_exception', '1'), ('non_effective', 'a', 'excluded', 'not_approved', '1'), ('non_effective', 'b', 'canonical', '', '1'), ('evaluates', 'a', 'reference', '', '1'), ('evaluates', 'b', 'canonical', '', '1'), ('approves', 'a', 'reference', '', '1'), ('approves', 'b', 'canonical', '', '1'), ('implements_decision', 'a', 'reference', '', '1'), ('implements_decision', 'b', 'canonical', '', '1'), ('conflicts_with', 'a', 'reference', '', '1'), ('conflicts_with', 'b', 'canonical', '', '1'), ('derived_from_other', 'a', 'reference', '', '1'), ('derived_from_other', 'b', 'canonical', '', '1'), ('applies_to', 'a', 'canonical', '', '1'), ('applies_to', 'b', 'canonical', '', ''), ('precedence_other_clause', 'a', 'reference', 'contract_precedence', ''), ('precedence_other_clause', 'b', 'canonical', '', ''), ('supersedes_other_role', 'a', 'reference', 'superseded', '1'), ('supersedes_other_role', 'b', 'historical', 'superseded', '1'),
    ("records_execution", "a", "execution_record", "execution_evidence", "1"), ("records_execution", "b", "canonical", "", ""),
]


def resolver_cases(spark: SparkSession) -> dict[str, DataFrame]:
    cand, prof, rel, ctx = [], [], [], []
    for name, (role, clauses, nodes, edges) in CASES.items():
        ctx.append((name, "i", "2024-03-01", [role], clauses))
        for n, (c, r, approved, official, rank) in enumerate(nodes):
            cand.append((name, n + 1, f"{name}/{c}", 0.9 - 0.1 * n))
            prof.append((f"{name}/{c}", r, "mandatory", rank, approved, official))
        for n, (kind, position, s, t, own, until) in enumerate(edges):
            rel.append((f"{name}/{n + 1}", kind, position, f"{name}/{s}", f"{name}/{t}", own, [], until, n))
    none = F.lit(None).cast("string")
    return {
        "candidates": spark.createDataFrame(cand, "case_id string, ordinal long, source_id string, relevance double"),
        "contexts": spark.createDataFrame(ctx, "case_id string, intent_id string, as_of string, requested_roles array<string>, requested_clauses array<string>").withColumn("scope", S.scope_of()),
        "profiles": spark.createDataFrame(prof, "source_id string, role string, level string, authority_rank int, approved boolean, official_record boolean").withColumns({"scope": S.scope_of(), "valid_from": none, "valid_to": none}),
        "relations": spark.createDataFrame(rel, "id string, kind string, position string, source_id string, target_id string, source_clauses array<string>, target_clauses array<string>, valid_to string, ordinal int").withColumns({"scope": S.scope_of(), "valid_from": none}),
    }


_REF = "array<struct<source_id:string,evidence_id:string>>"


def _refs(units: list[str]) -> list[tuple[str, str]]:
    return [(u.split("/")[0], u) for u in units]


def family(spark: SparkSession) -> dict[str, DataFrame]:
    docs = spark.createDataFrame(DOCS, "source_id string, document_type string, role string, approved boolean, official_record boolean, authority_rank int, products array<string>, sites array<string>")
    none = F.lit(None).cast("string")
    docs = docs.withColumns({"scope": S.scope_of(products=F.col("products"), sites=F.col("sites")), "valid_from": none, "valid_to": none})
    units = spark.createDataFrame([(s, f"{s}/{n}", n, text, heads) for s, n, heads, text in UNITS], "source_id string, evidence_id string, line_start int, text string, heading_path array<string>")
    claims = spark.createDataFrame([(i, s, p, o, _refs([f"{src}/1"])) for i, s, p, o, src in CLAIMS], f"id string, subject string, predicate string, object string, evidence {_REF}")
    relations = spark.createDataFrame([(*r[:7], _refs(r[7])) for r in RELATIONS], f"id string, kind string, position string, source_id string, target_id string, source_clauses array<string>, target_clauses array<string>, evidence {_REF}")
    relations = relations.withColumns({"scope": S.scope_of(), "valid_from": none, "valid_to": none})
    graph = spark.createDataFrame(list(combinations(sorted(d[0] for d in DOCS), 2)), "a string, b string")
    return {"relations": relations, "docs": docs, "claims": claims, "units": units, "graph": graph}


#: What the rules must leave and add: rule, kind, position, source, target, clauses of both, units
EDGES = [
    ("a", "amends", "dominates", "amd", "spec", "3.1", "3.1", "amd/1"), ("a", "conflicts_with", "unresolved", "spec", "amd", "3.1", "", "spec/1"), ("a", "conflicts_with", "unresolved", "amd", "spec", "4", "", "amd/1"),
    ("b", "proposes_change_to", "non_effective", "offer", "contract", "前提", "", "offer/3,offer/1"), ("c", "applies_to", "conditional", "work", "procedure", "現場指示", "標準手順", "work/1,procedure/1"),
    ("d", "exception_to", "conditional", "deviation", "procedure", "例外規則", "標準手順", "deviation/1,procedure/1"), ("e", "order_of_precedence", "conditional", "work_other", "procedure", "優先", "標準", "work_other/1"),
    ("e", "applies_to", "conditional", "work_other", "procedure", "優先", "標準", "work_other/1"), ("f", "operational_position", "non_effective", "log_position", "deviation", "結果", "措置", "log_position/1"),
    ("f", "records_execution_of", "non_effective", "log_position", "deviation", "結果", "措置", "log_position/1"), ("f", "records_execution_of", "non_effective", "log", "deviation", "実施結果", "例外規則", "log/1,deviation/1"),
    ("g", "conflicts_with", "non_effective", "faq", "rule", "旧案内", "現行規則", "faq/1,rule/1"), ("h", "records_execution_of", "non_effective", "test", "amd", "判定", "変更値", "test/1,amd/1"),
    ("i", "proposes_change_to", "non_effective", "draft", "cooling", "検討目的,承認状態", "適用", "draft/1,draft/2,cooling/2"),
    ("j", "approves", "non_effective", "minutes", "plan", "決定", "採用方式", "minutes/1,plan/1"), ("j", "implements_decision", "non_effective", "plan", "minutes", "決定", "採用方式", "minutes/1,plan/1"),
]
RULE_OF = {"amd": "a", "spec": "a", "offer": "b", "work": "c", "deviation": "d", "work_other": "e", "log": "f", "log_position": "f", "faq": "g", "test": "h", "draft": "i", "minutes": "j", "plan": "j"}


def values(rows: list[tuple], names: str) -> str:
    """SQL for fixed rows."""
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


#: Conflicts that relations or roles decide: claim id, subject, its sources
SIDES = [("a1", "返金の期限", ["s1"]), ("a2", "返金の期限", ["s2"]), ("b1", "点検", ["s3"]), ("b2", "点検", ["s5"]), ("c1", "額", ["p1"]), ("c2", "額", ["p2"]), ("d1", "額", ["p1"]), ("d2", "額", ["s1"]), ("e1", "結果", ["l1"]), ("e2", "結果", ["s1"]), ("f1", "結果", ["l2"]), ("f2", "結果", ["s1"]), ("g1", "x", ["s1"]), ("g2", "x", ["s4"]), ("h1", "点検", ["s3"]), ("h2", "点検", ["s6"]), ("i1", "返金の期限", ["s2", "p1"]), ("i2", "返金の期限", ["s1"])]
#: id, kind, source, target, clauses, scope's product, end of validity
LINKS = [("1", "amends", "s1", "s2", ["返金の期限"], None, None), ("2", "exception_to", "s3", "s4", [], "p", None), ("3", "applies_to", "s5", "s4", [], "p", None), ("4", "applies_to", "s6", "s4", [], "q", None), ("5", "records_execution_of", "l2", "s3", [], None, None), ("6", "amends", "s4", "s1", ["x"], None, "2023-01-01")]
OVERRIDES = [("a", "a1", "explicit_override"), ("b", "b1", "explicit_override"), ("c", None, "state"), ("d", "d2", "state"), ("e", "e2", "explicit_override"), ("f", "f2", "explicit_override"), ("i", "i2", "explicit_override")]


def overrides(spark: SparkSession) -> dict[str, DataFrame]:
    claims = spark.createDataFrame([(i, s, [(x, f"{x}/1") for x in src]) for i, s, src in SIDES], f"id string, subject string, evidence {_REF}")
    conflicts = spark.createDataFrame([(i[0], i, i[0] + "2", "unresolved") for i, _, _ in SIDES if i.endswith("1")], "conflict_id string, l_id string, r_id string, status string")
    links = spark.createDataFrame([(*x[:4], x[4], [], x[5], x[6]) for x in LINKS], "id string, kind string, source_id string, target_id string, source_clauses array<string>, target_clauses array<string>, product string, valid_to string")
    links = links.withColumns({"scope": S.scope_of(products=F.when(F.col("product").isNotNull(), F.array("product"))), "valid_from": F.lit(None).cast("string"), "position": F.lit("unresolved")})
    roles = spark.createDataFrame([("p1", "proposal", False), ("p2", "proposal", False), ("l1", "record", True), ("l2", "reference", True), ("s1", "normative", True)], "source_id string, role string, approved boolean")
    return {"conflicts": conflicts, "claims": claims, "relations": links, "profiles": roles}


#: Packets that can be merged and such that can't: relation id, kind, position, source, target, product
PACKET_RELATIONS = [
    ("r1", "order_of_precedence", "conditional", "sow", "frame", "p"), ("r2", "proposes_change_to", "non_effective", "offer", "frame", "p"), ("r3", "proposes_change_to", "non_effective", "offer_q", "frame", "q"),
    ("r4", "conflicts_with", "non_effective", "faq", "frame", "p"), ("r5", "applies_to", "conditional", "site", "frame", "p"), ("r6", "proposes_change_to", "non_effective", "sow", "other", "p"),
]
MERGED = [("r1,r2", "frame:governing,offer:excluded,sow:governing"), ("r3", "frame:governing,offer_q:excluded"), ("r4", "faq:excluded,frame:governing"), ("r5", "frame:governing,site:governing"), ("r6", "other:governing,sow:excluded")]


def packet_relations(spark: SparkSession) -> DataFrame:
    none = F.array().cast("array<string>")
    r = spark.createDataFrame(PACKET_RELATIONS, "id string, kind string, position string, source_id string, target_id string, product string")
    return r.withColumns({"source_clauses": none, "target_clauses": none, "scope": S.scope_of(products=F.array("product"))})


#: Profiles of a provider: ordinal, source, units referred to; and units: source, line, text
EXTRACTED = [(1, "a", ["a/1"]), (2, "a", ["a/1"]), (3, "b", ["a/1"]), (4, "c", []), (5, "ghost", ["ghost/1"])]
TEXTS = [("a", 1, "plain"), ("b", 1, "---\nstatus: approved\ndocument_type: policy\n---"), ("c", 1, "first"), ("c", 2, "---\nstatus: draft\ndocument_type: test_record\n---"), ("d", 1, "only text")]
VALIDATED = [("a", "analysis", "recommended", 7, False, None), ("b", "normative", "mandatory", 0, True, False), ("c", "record", "informational", 0, False, True), ("d", "reference", "informational", 0, False, False)]
INVALID = [("a", "PRF-INVALID-PROFILE"), ("b", "PRF-FALLBACK-PROFILE"), ("b", "PRF-INVALID-PROFILE"), ("c", "PRF-FALLBACK-PROFILE"), ("c", "PRF-INVALID-PROFILE"), ("d", "PRF-FALLBACK-PROFILE"), ("ghost", "PRF-INVALID-PROFILE")]


def extracted(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    units = spark.createDataFrame([(s, f"{s}/{n}", n, t) for s, n, t in TEXTS], "source_id string, evidence_id string, line_start int, text string")
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(n, s, "analysis", "recommended", 7, False, _refs(u)) for n, s, u in EXTRACTED], f"ordinal int, source_id string, role string, level string, authority_rank int, approved boolean, evidence {_REF}")
    return rows.withColumns({"document_id": none, "revision": none, "scope": S.scope_of(), "valid_from": none, "valid_to": none, "observed_at": none, "official_record": F.lit(None).cast("boolean")}), units


#: Candidate relations: ordinal, id, kind, source, target, clauses of both, units referred to; and what stays of each
CANDIDATES = [
    (1, "ok", "supersedes", "a", "b", [], [], ["a/1"]), (2, "ok", "supersedes", "b", "a", [], [], ["a/1"]), (3, "loop", "supersedes", "a", "a", [], [], ["a/1"]), (4, "far", "supersedes", "a", "d", [], [], ["a/1"]), (5, "bare", "amends", "a", "b", ["1"], [], ["a/1"]),
    (6, "airy", "evaluates", "b", "c", [], [], []), (7, "wrong", "evaluates", "b", "c", [], [], ["b/9"]), (8, "amended", "amends", "c", "b", ["1"], ["2"], ["c/1", "b/1"]), (9, " ", "evaluates", "b", "c", [], [], ["b/1"]), (10, "ghostly", "evaluates", "ghost", "b", [], [], ["b/1"]),
]
JUDGED = [
    ("ok", "kept"), ("amended", "kept"), ("ok", "ends=true; unique=false; grounded=true; clauses=true"), ("loop", "ends=false; unique=true; grounded=true; clauses=true"), ("bare", "ends=true; unique=true; grounded=true; clauses=false"), ("airy", "ends=true; unique=true; grounded=false; clauses=true"),
    ("wrong", "ends=true; unique=true; grounded=false; clauses=true"), (" ", "ends=true; unique=false; grounded=true; clauses=true"), ("ghostly", "ends=false; unique=true; grounded=true; clauses=true"),
]


def candidate_relations(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = spark.createDataFrame([(*c[:7], _refs(c[7])) for c in CANDIDATES], f"ordinal int, id string, kind string, source_id string, target_id string, source_clauses array<string>, target_clauses array<string>, evidence {_REF}")
    return rows, spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "b"), ("b", "ghost")], "a string, b string")


#: An incident: source, type, status, scenario; units (source, line, text); relations before; and what comes of them
INCIDENT = [("old", "incident_report", "open", "x"), ("open", "incident_report", "open", "x"), ("shut", "incident_report", "closed", "x"), ("change", "change_request", "", "x"), ("release", "release_record", "", "x"), ("half", "incident_report", "closed", "y"), ("start", "incident_report", "open", "y"), ("rule", "policy", "current", "x")]
INCIDENT_UNITS = [("shut", 1, "最終報として初報の内容を更新し、全体を改める"), ("shut", 2, "最終報で初報を更新する"), ("shut", 3, "初報を更新する"), ("release", 1, "変更申請と実施証跡"), ("half", 1, "最終報で初報を更新する"), ("change", 1, "変更申請")]
INCIDENT_RELATIONS = [("1", "supersedes", "shut", "old"), ("2", "derived_from", "change", "shut"), ("3", "conflicts_with", "open", "shut"), ("4", "applies_to", "rule", "open"), ("5", "supersedes", "shut", "half")]
INCIDENT_EDGES = [("derived_from", "change", "shut", ""), ("applies_to", "rule", "open", ""), ("supersedes", "shut", "half", ""), ("supersedes", "shut", "open", "shut/2"), ("records_execution_of", "release", "change", "release/1")]


def incident(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    docs = spark.createDataFrame([(*d, n) for n, d in enumerate(INCIDENT)], "source_id string, document_type string, status string, scenario string, ordinal int")
    units = spark.createDataFrame([(s, f"{s}/{n}", n, t) for s, n, t in INCIDENT_UNITS], "source_id string, evidence_id string, line_start int, text string")
    r = spark.createDataFrame(INCIDENT_RELATIONS, "id string, kind string, source_id string, target_id string").withColumns({"position": F.lit("unresolved"), "source_clauses": empty, "target_clauses": empty, "scope": S.scope_of(), "valid_from": none, "valid_to": none, "evidence": F.array().cast(_REF)})
    return docs, r, docs.select("source_id").withColumns({"scope": S.scope_of(), "valid_from": none, "valid_to": none}), units


#: Dossiers: source, purpose, type, status, document id, names that it tells, tokens; and relations (id, kind, source, target)
DOSSIER = [
    ("rule1", "governance", "policy", "current", "P-1", [], ["a"]), ("rule2", "governance", "policy", "current", "P-2", [], ["a", "b"]), ("past", "governance", "policy", "superseded", "P-0", [], []), ("faq", "governance", "faq", "", "F", ["p-1"], ["a", "b"]),
    ("note", "governance", "approval_record", "", "N", [], ["a", "b"]), ("lone", "governance", "approval_record", "", "L", [], ["z"]), ("plan", "planning", "implementation_plan", "", "I", [], []), ("other", "reading", "policy", "current", "O", [], []),
]
DOSSIER_RELATIONS = [
    ("1", "conflicts_with", "faq", "rule1"), ("2", "conflicts_with", "faq", "rule2"), ("3", "approves", "note", "rule2"), ("3b", "approves", "note", "rule2"), ("4", "approves", "lone", "rule1"), ("5", "approves", "lone", "past"), ("6", "evaluates", "note", "rule1"), ("7", "approves", "note", "plan"), ("position_8", "amends", "note", "plan"),
    ("9", "amends", "other", "rule1"), ("9b", "amends", "other", "rule1"), ("10", "supersedes", "rule1", "past"), ("11", "supersedes", "rule2", "rule1"), ("12", "implements_decision", "plan", "note"),
]
DOSSIER_KEPT = [("1",), ("3",), ("4",), ("position_8",), ("9",), ("9b",), ("10",)]
DOSSIER_SLOTS = [("faq", "rule1", "conflicts_with"), ("note", "rule2", "approves"), ("rule1", "past", "supersedes"), ("rule2", "past", "supersedes")]


def dossier(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    docs = spark.createDataFrame(DOSSIER, "source_id string, purpose string, document_type string, status string, document_id string, names array<string>, tokens array<string>").withColumn("scenario", F.lit("s"))
    return docs, spark.createDataFrame(DOSSIER_RELATIONS, "id string, kind string, source_id string, target_id string")
