"""Relations derived by rule: positions from front matter, required slots of a dossier, coverage rules, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import text as X
from ..schemas import DIMENSIONS
from . import claims as CL

#: What the purpose of a dossier requires: purpose, source types, source status, kind, position, target types, target
#: status, and headings under which source and target say so.
SLOTS = [
    ("commercial_compliance", "audit_record", None, "records_execution_of", "non_effective", "statement_of_work", None, "監査対象 評価基準", "個別条件 対象"),
    ("commercial_compliance", "statement_of_work", None, "order_of_precedence", "dominates", "master_agreement master_contract", None, "優先 個別条件", "優先順位 標準条件"),
    ("commercial_compliance", "vendor_proposal", None, "proposes_change_to", "non_effective", "master_agreement master_contract", None, "契約状態 提案", "契約対象 標準条件"),
    ("governance", "approval_record", None, "approves", "non_effective", "policy", "current", "承認対象 決定", "現行規則 目的"),
    ("governance", "faq", None, "conflicts_with", "non_effective", "policy", "current", "旧案内 更新状況", "現行規則"),
    ("governance", "policy", "current", "supersedes", "dominates", "policy", "superseded", "旧版の扱い 現行規則", "承認規則 旧版"),
    ("incident_change", "change_request", None, "derived_from", "non_effective", "incident_report", "closed", "変更理由 変更内容", "確定原因"),
    ("incident_change", "incident_report", "closed", "supersedes", "dominates", "incident_report", "open", "終結 確定原因", "初報 発生 概要"),
    ("incident_change", "release_record", None, "records_execution_of", "non_effective", "change_request", None, "実施内容 位置づけ", "承認 変更内容"),
    ("operations", "execution_log", None, "records_execution_of", "non_effective", "temporary_deviation", None, "位置づけ 実施結果", "適用対象 例外規則"),
    ("operations", "temporary_deviation", None, "exception_to", "conditional", "operating_procedure", None, "適用対象 例外規則", "例外 対象"),
    ("operations", "work_instruction", None, "applies_to", "conditional", "operating_procedure", None, "上位手順 実施", "対象 頻度"),
    ("planning", "analysis options_analysis", None, "evaluates", "non_effective", "proposal", None, "比較対象 評価", "初期案 提案"),
    ("planning", "decision_minutes", None, "approves", "non_effective", "implementation_plan", None, "決定", "採用方式 実施方式"),
    ("planning", "implementation_plan", None, "implements_decision", "non_effective", "decision_minutes", None, "採用方式 実施方式", "決定"),
    ("technical_spec", "specification_amendment", None, "amends", "dominates", "technical_specification", None, "対象条項 変更値", "変更管理 基準値"),
    ("technical_spec", "technical_draft", None, "proposes_change_to", "non_effective", "technical_specification", None, "検討目的 候補値", "変更管理 基準値"),
    ("technical_spec", "test_record", None, "records_execution_of", "non_effective", "specification_amendment", None, "試験対象 判定 記録性", "対象条項 変更値"),
]
PURPOSES = sorted({s[0] for s in SLOTS})


def slot_table(spark) -> DataFrame:
    """The rule table: a fixed few rows, hence broadcast."""
    rows = [(i, p, st.split(), ss, kind, pos, tt.split(), ts, sh.split(), th.split()) for i, (p, st, ss, kind, pos, tt, ts, sh, th) in enumerate(SLOTS)]
    return F.broadcast(spark.createDataFrame(rows, "rule int, purpose string, source_types array<string>, source_status string, kind string, position string, target_types array<string>, target_status string, source_headings array<string>, target_headings array<string>"))


def _slot_ends(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (source_id, scenario, purpose, document_type, status, tokens; document_id and names, if there) as sources
    and as targets of every rule whose types and states they have. A document has one row in a dossier, and no rule takes
    it for both ends. ``tokens`` are distinct and sorted, so equal sets are equal keys."""
    extra = {"document_id": F.lit(None).cast("string"), "names": F.array().cast("array<string>")}
    docs = docs.withColumns({c: v for c, v in extra.items() if c not in docs.columns}).filter("source_id IS NOT NULL")
    tokens = F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))))
    d = docs.select("source_id", "scenario", "purpose", "document_type", "status", tokens.alias("tokens"), X.normalized_key(F.col("document_id")).alias("document_id"), "names").join(slot_table(docs.sparkSession), "purpose")
    end = lambda x: d.filter(F.array_contains(f"{x}_types", F.col("document_type")) & (F.col(f"{x}_status").isNull() | (F.col("status") == F.col(f"{x}_status"))))
    s = end("source").select("source_id", "scenario", "purpose", "rule", "kind", "position", "source_headings", "target_headings", "tokens", "names")
    return s, end("target").select(F.col("source_id").alias("target_id"), "scenario", "rule", F.col("tokens").alias("t_tokens"), F.col("document_id").alias("t_document"))


def _required(docs: DataFrame) -> DataFrame:
    """A dossier's sources and targets meet as sets of tokens, each set once with the number of its targets and the least
    of them: only a target that is alone is ever taken, so no source has to meet every target. A source names a target if
    one of its names (scope values and document ids in its text) is an id that no other target has."""
    s, t = _slot_ends(docs)
    dossier = ["rule", "scenario"]
    sets = t.groupBy(*dossier, "t_tokens").agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("least"))
    met = s.select(*dossier, "tokens").distinct().join(sets, dossier).withColumn("shared", F.size(F.array_intersect("tokens", "t_tokens")))
    level = met.groupBy(*dossier, "tokens", "shared").agg(F.sum("n").alias("ties"), F.min("least").alias("least"))
    best = level.groupBy(*dossier, "tokens").agg(F.sum("ties").alias("n"), F.max(F.struct("shared", "ties", "least")).alias("top"))
    p = s.join(best, [*dossier, "tokens"])
    if "names" in docs.columns:
        alone = t.filter("t_document IS NOT NULL").groupBy(*dossier, "t_document").agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("direct")).filter("n = 1").drop("n")
        said = s.select("source_id", *dossier, F.explode(F.array_distinct("names")).alias("t_document")).join(alone, [*dossier, "t_document"])
        p = p.join(said.groupBy("source_id", *dossier).agg(F.count(F.lit(1)).alias("named"), F.min("direct").alias("direct")), ["source_id", *dossier], "left")
    else:
        p = p.withColumns({"named": F.lit(0), "direct": F.lit(None).cast("string")})
    target = F.when(F.col("n") == 1, F.col("top.least")).when(F.col("named") == 1, F.col("direct")).when((F.col("top.shared") > 0) & (F.col("top.ties") == 1), F.col("top.least"))
    hit = p.withColumn("target_id", target).filter("target_id IS NOT NULL").drop("top", "n", "named", "direct", "tokens", "names")
    key = F.concat(F.lit("slot_"), F.substring(F.sha2(F.concat_ws(":", "source_id", "target_id", "kind", F.lit("required-slot")), 256), 1, 16))
    return first_wins(hit.withColumn("id", key), ["source_id", "target_id", "kind"], "rule")


def required_slots(docs: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, position, id): a dossier's only target takes every source; of several, the only one
    that the source names, else the one that alone shares most scope tokens; else none."""
    return _required(docs).select("source_id", "target_id", "kind", "position", "id")


def slot_relations(docs: DataFrame, profiles: DataFrame, units: DataFrame) -> DataFrame:
    """Required edges as relations: evidence of both ends from under the slot's headings, or from front matter, edges
    with less being left out; clauses are the first headings, scope and dates the source document's."""
    e = _required(docs)
    wanted = e.select("source_id", F.concat(F.lit("s"), "id").alias("slot"), F.col("source_headings").alias("headings")).unionByName(e.select(F.col("target_id").alias("source_id"), F.concat(F.lit("t"), "id").alias("slot"), F.col("target_headings").alias("headings")))
    found = slot_evidence(wanted, units)
    side = lambda c: found.filter(F.col("slot").startswith(c)).select(F.substr("slot", F.lit(2)).alias("id"), F.struct("source_id", "evidence_id").alias(f"{c}_ref"))
    rows = e.join(side("s"), "id").join(side("t"), "id").join(profiles.select("source_id", "scope", "valid_from", "valid_to"), "source_id")
    first = lambda c: F.slice(c, 1, 1)
    return rows.select("id", "kind", "position", "source_id", "target_id", first("source_headings").alias("source_clauses"), first("target_headings").alias("target_clauses"), "scope", "valid_from", "valid_to", F.array("s_ref", "t_ref").alias("evidence"))


def slot_tokens(scope):
    """The scope's values as ``dimension:value``, 64 at most, in order of dimension and place."""
    parts = [F.transform(S.dim(scope, d), lambda v, d=d: F.concat(F.lit(f"{d}:"), X.normalized_key(v))) for d in DIMENSIONS]
    return F.slice(F.concat(*parts), 1, 64)


def slot_evidence(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """(source_id, slot, evidence_id) for wanted (source_id, slot, headings): the unit with the least text under a heading
    that holds one of ``headings``, neither front matter nor about its section; else the source's front matter."""
    text = X.trim(F.col("text"))
    meta = text.startswith("---")
    rows = wanted.join(units, "source_id")
    under = ~meta & ~F.contains("text", F.lit("この節では")) & F.exists("heading_path", lambda h: F.exists("headings", lambda w: F.contains(h, w)))
    turn = F.when(under, F.struct(F.lit(0).alias("turn"), F.char_length("text").alias("n"), "line_start", "evidence_id")).when(meta, F.struct(F.lit(1).alias("turn"), F.lit(0).alias("n"), "line_start", "evidence_id"))
    best = rows.groupBy("source_id", "slot").agg(F.min(turn).alias("b"))
    return best.filter("b IS NOT NULL").select("source_id", "slot", "b.evidence_id")


def unresolved_slots(docs: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(source_id, purpose, kind, code) of slots whose source has no relation of the kind: none of ``relations``, or
    without them none that is required. A slot is open whether or not its dossier has a target."""
    found = required_slots(docs) if relations is None else relations
    s = docs.select("source_id", "purpose", "document_type", "status").join(slot_table(docs.sparkSession), "purpose")
    wanted = s.filter(F.array_contains("source_types", F.col("document_type")) & (F.col("source_status").isNull() | (F.col("status") == F.col("source_status")))).select("source_id", "purpose", "kind").distinct()
    return wanted.join(found.select("source_id", "kind").distinct(), ["source_id", "kind"], "left_anti").select("source_id", "purpose", "kind", F.lit("REL-UNRESOLVED-REQUIRED-SLOT").alias("code"))


def slot_fallback_pairs(docs: DataFrame, limit: int = 32) -> DataFrame:
    """(source_id, kind, target_id): up to ``limit`` possible targets of each unresolved slot, by id."""
    open_ = unresolved_slots(docs).select("source_id", "kind")
    s, t = _slot_ends(docs)
    w = Window.partitionBy("rule", "scenario").orderBy("target_id")
    first = t.select("rule", "scenario", "target_id").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit)
    lists = first.groupBy("rule", "scenario").agg(F.collect_list("target_id").alias("targets"))
    asked = s.select("source_id", "kind", "rule", "scenario").join(open_, ["source_id", "kind"], "left_semi").join(lists, ["rule", "scenario"])
    near = asked.groupBy("source_id", "kind").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"))  # of all its dossiers
    return near.select("source_id", "kind", F.explode(F.slice("targets", 1, limit)).alias("target_id"))


def front_matter_positions(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """operational_position edges that front matter (position, position_target_document_id, …_revision) declares: the
    target is the first profile of that document id, of that revision if one is given."""
    # a source can be its own first target and never its second, so two targets of a name are all that may be asked for
    t = profiles.filter("document_id IS NOT NULL").select(F.col("source_id").alias("target_id"), "document_id", "revision", "ordinal")
    named = t.withColumn("of", F.lit(None).cast("string")).unionByName(t.filter("revision IS NOT NULL").withColumn("of", F.col("revision")))
    each = named.groupBy("document_id", "of", "target_id").agg(F.min("ordinal").alias("ordinal"))
    order = Window.partitionBy("document_id", "of").orderBy("ordinal", "target_id")
    two = each.withColumn("n", F.row_number().over(order)).filter("n <= 2").groupBy("document_id", "of").agg(F.min_by("target_id", "n").alias("one"), F.max_by("target_id", "n").alias("two"))
    asked = sources.filter("position IS NOT NULL AND position_target_document_id IS NOT NULL")
    j = asked.join(two, (F.col("position_target_document_id") == F.col("document_id")) & F.col("position_target_revision").eqNullSafe(F.col("of")))
    j = j.withColumn("target_id", F.when(F.col("one") != F.col("source_id"), F.col("one")).otherwise(F.col("two"))).filter("source_id <> target_id").drop("document_id")
    return j.select(F.concat(F.lit("position_"), F.substring(F.sha2(F.concat_ws(":", "source_id", "target_id", "position_target_document_id", "position"), 256), 1, 16)).alias("id"), F.lit("operational_position").alias("kind"), "position", "source_id", "target_id")


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row for each key, the first by ordinal."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


#: Words by which a unit supports a relation of a kind; all other kinds have those of "".
TERMS = {
    "": "参照 由来 適用 関係",
    "amends": "修正 変更 改訂 条 節",
    "approves": "対象 承認 採用 施行 決定",
    "conflicts_with": "優先 反映していない 旧案内 正式 現行 矛盾 食い違",
    "evaluates": "優位 分析 初期案 提案 比較 評価",
    "exception_to": "例外 免除 逸脱 限定",
    "implements_decision": "不採用 実施対象 実施方式 採否 採用 決定 計画",
    "operational_position": "却下 失効 承認 未承認 現行 適用",
    "order_of_precedence": "優先 反映していない 旧案内 正式 現行 矛盾 食い違",
    "proposes_change_to": "変更 提案 未署名 義務 署名 適用",
    "records_execution_of": "完了 実施 実行 承認 決定 記録 適用",
    "supersedes": "旧版 現行 第1版 第2版 終了 置き換 適用期間",
}


def relation_evidence(relations: DataFrame, units: DataFrame, k: int = 3, grounded: DataFrame | None = None) -> DataFrame:
    """(id, source_id, evidence_id, score, rank): the k best units of each end of each relation, ties to the earlier.

    20 for each of the kind's terms in heading path or text, 100 for each of the end's clauses there if the relation
    speaks of precedence, 100 under a heading that names the basis of judgement, 3 for a validity; units that the relation
    already refers to (``grounded``: id, source_id, evidence_id) come first. Front matter, headings and boilerplate never
    do. ``units`` may hold heading_path, valid_from and valid_to. Clauses of a relation without any make no hits."""
    spark = relations.sparkSession
    terms = F.broadcast(spark.createDataFrame([(kind, ts.split()) for kind, ts in TERMS.items()], "term_kind string, terms array<string>"))
    none = F.array().cast("array<string>")
    tells = S.expresses_precedence(F.col("kind"), F.col("position"), F.concat(F.coalesce("source_clauses", none), F.coalesce("target_clauses", none)))
    ends = relations.select("id", F.when(F.col("kind").isin(*[x for x in TERMS if x]), F.col("kind")).otherwise("").alias("term_kind"), tells.alias("tells"), F.explode(F.array(F.struct(F.col("source_id").alias("source_id"), F.coalesce("source_clauses", none).alias("clauses")), F.struct(F.col("target_id").alias("source_id"), F.coalesce("target_clauses", none).alias("clauses")))).alias("e"))
    ends = ends.select("id", "term_kind", "tells", "e.source_id", "e.clauses").join(terms, "term_kind")
    have = set(units.columns)
    path = F.col("heading_path") if "heading_path" in have else none
    valid = [F.col(c) for c in ("valid_from", "valid_to") if c in have]
    text = X.trim(F.col("text"))
    u = units.filter(~text.startswith("---") & ~text.startswith("#") & ~F.contains("text", F.lit("架空の評価用社内文書")) & ~F.contains("text", F.lit("この節では")))
    u = u.select("source_id", "evidence_id", "line_start", F.lower(F.concat_ws(" ", F.array_join(path, " "), "text")).alias("all"), F.exists(path, lambda h: F.contains(h, F.lit("判断に用いる基準"))).alias("basis"), (F.coalesce(*valid).isNotNull() if valid else F.lit(False)).alias("dated"))
    scored = ends.join(u, "source_id")
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("all"), t)))
    named = F.size(F.filter("clauses", lambda c: (F.trim(c) != "") & F.contains(F.col("all"), F.lower(F.trim(c)))))
    scored = scored.withColumn("score", F.when(F.col("tells"), named * 100).otherwise(0) + hits * 20 + F.col("dated").cast("int") * 3 + F.coalesce(F.col("basis").cast("int"), F.lit(0)) * 100)
    if grounded is None:
        scored = scored.withColumn("known", F.lit(False))
    else:
        scored = scored.join(grounded.select("id", "source_id", "evidence_id").distinct().withColumn("known", F.lit(True)), ["id", "source_id", "evidence_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    w = Window.partitionBy("id", "source_id").orderBy(F.desc(F.col("known").cast("int") * 1000 + F.col("score")), "line_start")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "source_id", "evidence_id", "score", "rank")


def claim_pairs(pairs: DataFrame, claims: DataFrame, agree: bool, limit: int = 64) -> DataFrame:
    """(source_id, target_id, source_claim, target_claim, score): for each pair of sources the claims whose subjects
    overlap and that say the same (``agree``: equivalent objects with a text of 2 characters or more, whatever the
    predicate) or not (one single-valued predicate, other objects); the pair with the longest shorter subject, score
    being its length, ties to the first by id. At most ``limit`` claims of a source, the first by id, are looked at.

    Claims meet in equi-joins on normal forms: of the object, as scalar and as duration, or of the predicate."""
    c = claims.select("id", "subject", "predicate", "object", F.explode(F.array_distinct(F.col("evidence.source_id"))).alias("s"))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("id"))).filter(F.col("n") <= limit)
    text = X.scalar_claim_text(F.col("object"))
    if agree:  # the text of an array does not count for the length, as it is no string
        c = c.filter(F.char_length(X.trim(text)) >= 2)
        keys = F.array_compact(F.array(F.concat(F.lit("="), X.scalar_normalize(text)), F.concat(F.lit("~"), X.duration_constraint(text))))
        c = c.withColumn("key", F.explode(keys))
    else:
        c = c.filter(CL.single_valued(F.col("predicate"))).withColumn("key", X.normalized_key(F.col("predicate")))
    side = lambda p, end: c.select(F.col("s").alias(end), "key", *[F.col(x).alias(f"{p}_{x}") for x in ("id", "subject", "object")])
    j = pairs.select("source_id", "target_id").join(side("a", "source_id"), "source_id").join(side("b", "target_id"), ["target_id", "key"])
    same = X.objects_equivalent(F.col("a_object"), F.col("b_object"))
    j = j.filter(X.subjects_overlap(F.col("a_subject"), F.col("b_subject")) & (same if agree else ~same))
    short = F.least(F.char_length(X.trim(F.col("a_subject"))), F.char_length(X.trim(F.col("b_subject"))))
    best = j.groupBy("source_id", "target_id").agg(F.min(F.struct((-short).alias("n"), F.col("a_id").alias("a"), F.col("b_id").alias("b"))).alias("m"))
    return best.select("source_id", "target_id", F.col("m.a").alias("source_claim"), F.col("m.b").alias("target_claim"), (-F.col("m.n")).alias("score"))


def refine_stale_guidance(relations: DataFrame, profiles: DataFrame, incompatible: DataFrame) -> DataFrame:
    """Non-effective positions of a communication against an approved norm become conflicts_with where the two sources
    have incompatible claims (``incompatible``: source_id, target_id)."""
    role = profiles.select("source_id", "role", "approved")
    r = relations.join(role.select("source_id", F.col("role").alias("sr")), "source_id", "left").join(role.select(F.col("source_id").alias("target_id"), F.col("role").alias("tr"), F.col("approved").alias("ta")), "target_id", "left")
    r = r.join(incompatible.select("source_id", "target_id").distinct().withColumn("bad", F.lit(True)), ["source_id", "target_id"], "left")
    hit = (F.col("kind") == "operational_position") & (F.col("position") == "non_effective") & (F.col("sr") == "communication") & (F.col("tr") == "normative") & F.col("ta") & F.col("bad")
    return r.withColumn("kind", F.when(hit, "conflicts_with").otherwise(F.col("kind"))).select(*relations.columns)


_INCIDENT = {"open_report": "incident_report/open", "closed_report": "incident_report/closed", "change": "change_request", "release": "release_record"}


def incident_pivot(docs: DataFrame) -> DataFrame:
    """(scenario, open_report, closed_report, change, release): the last document of each kind in a scenario."""
    t, s = F.col("document_type"), F.col("status")
    last = lambda c: F.max_by(F.when(c, F.col("source_id")), F.when(c, F.col("ordinal")))
    return docs.groupBy("scenario").agg(last((t == "incident_report") & (s == "open")).alias("open_report"), last((t == "incident_report") & (s == "closed")).alias("closed_report"), last(t == "change_request").alias("change"), last(t == "release_record").alias("release"))


def incident_change(docs: DataFrame, relations: DataFrame, profiles: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations that stay, relations to add) for incidents, by scenario. Between two of a scenario's incident documents
    only these relations stay: the closed report supersedes the open one, the release records the change's execution, the
    change derives from the closed report. In a complete dossier the first two are added where the source's text says so:
    final and first report and an update; change request and proof of execution; the shortest such unit is the evidence."""
    kinds = (F.col("document_type") == "incident_report") & F.col("status").isin("open", "closed") | F.col("document_type").isin("change_request", "release_record")
    d = docs.filter(kinds & F.col("scenario").isNotNull())
    p = incident_pivot(d)
    edge = lambda a, b, kind: F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("kind"))
    expected = p.select(F.explode(F.array(edge("closed_report", "open_report", "supersedes"), edge("release", "change", "records_execution_of"), edge("change", "closed_report", "derived_from"))).alias("e")).select("e.*").filter("source_id IS NOT NULL AND target_id IS NOT NULL").withColumn("expected", F.lit(True))
    inside = d.select("source_id", F.col("scenario").alias("__s")).join(d.select(F.col("source_id").alias("target_id"), F.col("scenario").alias("__s")), "__s").select("source_id", "target_id").distinct().withColumn("inside", F.lit(True))
    kept = relations.join(inside, ["source_id", "target_id"], "left").join(expected, ["source_id", "target_id", "kind"], "left").filter("inside IS NULL OR expected").select(*relations.columns)
    whole = p.filter("open_report IS NOT NULL AND closed_report IS NOT NULL AND change IS NOT NULL AND release IS NOT NULL")
    says = lambda *words: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("text"), w))
    proof = lambda cond: units.filter(cond).groupBy("source_id").agg(F.min(F.struct(F.char_length("text").alias("n"), "line_start", "evidence_id")).alias("u"))
    closed = whole.select(F.col("closed_report").alias("source_id"), F.col("open_report").alias("target_id"), F.lit("supersedes").alias("kind"), F.lit("dominates").alias("position")).join(proof(says("最終報", "初報", "更新")), "source_id")
    release = whole.select(F.col("release").alias("source_id"), F.col("change").alias("target_id"), F.lit("records_execution_of").alias("kind"), F.lit("non_effective").alias("position")).join(proof(says("変更申請", "実施証跡")), "source_id")
    none = F.array().cast("array<string>")
    made = closed.unionByName(release).join(kept.select("source_id", "target_id", "kind").distinct(), ["source_id", "target_id", "kind"], "left_anti").join(profiles.select("source_id", "scope", "valid_from", "valid_to"), "source_id")
    key = F.concat(F.lit("coverage_"), F.substring(F.sha2(F.concat_ws(":", "source_id", "target_id", "kind"), 256), 1, 16))
    return kept, made.select(key.alias("id"), "kind", "position", "source_id", "target_id", none.alias("source_clauses"), none.alias("target_clauses"), "scope", "valid_from", "valid_to", F.array(F.struct(F.col("source_id").alias("source_id"), F.col("u.evidence_id").alias("evidence_id"))).alias("evidence"))


def slot_shape_filter(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations of documents in dossiers whose purpose has slots stay only inside the dossier: those that a slot
    requires, and, where none is required of that source and kind, those that fit a slot by types and states. Positions
    declared in front matter stay, as do relations of other documents."""
    d = docs.select("source_id", "scenario", "purpose", "document_type", "status")
    r = relations.join(d, "source_id", "left").join(d.select(F.col("source_id").alias("target_id"), F.col("scenario").alias("ts"), F.col("purpose").alias("tp"), F.col("document_type").alias("tt"), F.col("status").alias("t_status")), "target_id", "left")
    need = required_slots(docs).select("source_id", "target_id", "kind").distinct()
    shapes = slot_table(relations.sparkSession).select("purpose", "kind", "source_types", "source_status", "target_types", "target_status")
    state = lambda want, have: F.col(want).isNull() | F.coalesce(F.col(want) == F.col(have), F.lit(False))
    shaped = r.join(shapes, ["purpose", "kind"]).filter(F.array_contains("source_types", F.col("document_type")) & F.array_contains("target_types", F.col("tt")) & state("source_status", "status") & state("target_status", "t_status"))
    r = r.join(shaped.select("id", F.lit(True).alias("fits")).distinct(), "id", "left").join(need.withColumn("wanted", F.lit(True)), ["source_id", "target_id", "kind"], "left").join(need.select("source_id", "kind", F.lit(True).alias("other")).distinct(), ["source_id", "kind"], "left")
    free = F.col("id").startswith("position_") | ~F.coalesce(F.col("purpose").isin(*PURPOSES), F.lit(False))
    inside = F.coalesce((F.col("scenario") == F.col("ts")) & (F.col("purpose") == F.col("tp")), F.lit(False))
    return r.filter(free | inside & (F.col("wanted").isNotNull() | F.col("other").isNull() & F.col("fits").isNotNull())).select(*relations.columns)


def slot_dedup(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """One relation of a kind between two documents, the first by id, where the source's dossier has a slot of that kind;
    others, and positions declared in front matter, stay as they are."""
    slots = slot_table(relations.sparkSession).select("purpose", "kind", F.lit(True).alias("slotted")).distinct()
    r = relations.join(docs.select("source_id", "purpose"), "source_id", "left").join(slots, ["purpose", "kind"], "left")
    single = F.col("slotted").isNotNull() & ~F.col("id").startswith("position_")
    n = F.row_number().over(Window.partitionBy("source_id", "target_id", "kind", single).orderBy("id"))
    return r.withColumn("n", n).filter(~single | (F.col("n") == 1)).select(*relations.columns)
