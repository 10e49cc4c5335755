"""Which candidates govern: four resolvers over (candidates, contexts, profiles, relations).

Ties are decided by the candidate's ordinal, the later one winning, as every ranking here is a row_number.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import temporal as T

RECORD_BLOCK = ("historical", "excluded", "unresolved")


def _reasons(*names: str):
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def _winner(df: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(*[F.desc(k) for k in keys], F.desc("ordinal"))
    return df.withColumn("first", F.row_number().over(w) == 1)


def _decisions(df: DataFrame, score=None) -> DataFrame:
    return df.select(
        "case_id", "ordinal", "source_id", F.when(F.col("first"), "canonical").otherwise("reference").alias("disposition"),
        F.when(F.col("first"), _reasons("highest_relevance")).otherwise(_reasons()).alias("reasons"), (score if score is not None else F.lit(None).cast("double")).alias("score"),
    )


def resolve_r0(candidates: DataFrame) -> DataFrame:
    """The most relevant candidate is canonical, the others are reference."""
    return _decisions(_winner(candidates, "relevance"))


def weighted_score(relevance, rank, approved, level, match, is_effective):
    return (
        relevance + rank.cast("double") * F.lit(0.05) + F.when(approved, F.lit(0.25)).otherwise(F.lit(-0.60)) + F.when(level == "mandatory", F.lit(0.15)).otherwise(F.lit(0.0))
        + F.when(match == "match", F.lit(0.30)).when(match == "missing", F.lit(-0.10)).otherwise(F.lit(-0.50)) + F.when(is_effective, F.lit(0.20)).otherwise(F.lit(-0.40))
    )


def _joined(candidates: DataFrame, contexts: DataFrame, profiles: DataFrame) -> DataFrame:
    ctx = contexts.select("case_id", "as_of", "requested_roles", "requested_clauses", F.col("scope").alias("wanted"))
    prof = profiles.select("source_id", "role", "level", "authority_rank", "approved", "scope", "valid_from", "valid_to", "official_record", F.lit(True).alias("known"))
    df = candidates.join(ctx, "case_id").join(prof, "source_id", "left")
    return df.withColumn("match", S.scope_match(F.col("scope"), F.col("wanted"))).withColumn("eff", T.effective(F.col("valid_from"), F.col("valid_to"), F.col("as_of")))


def resolve_s1(candidates: DataFrame, contexts: DataFrame, profiles: DataFrame) -> DataFrame:
    """As R0 with the weighted score; a candidate without a profile keeps its relevance."""
    df = _joined(candidates, contexts, profiles)
    score = F.when(F.col("known"), weighted_score(F.col("relevance"), F.coalesce("authority_rank", F.lit(0)), F.coalesce("approved", F.lit(False)), F.col("level"), F.col("match"), F.col("eff"))).otherwise(F.col("relevance"))
    return _decisions(_winner(df.withColumn("weighted", score), "weighted"), F.col("weighted"))


def resolve_s2(candidates: DataFrame, contexts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Filters first, in a fixed order; then the best of each role by (authority_rank, relevance) becomes canonical."""
    df = _joined(candidates, contexts, profiles)
    none, dims = _reasons(), S.scope_missing(F.col("scope"), F.col("wanted"))
    wants = F.coalesce(F.array_contains("requested_roles", F.col("role")), F.lit(False))
    bounded = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()

    def row(disposition, reasons, missing=none, eligible=False):
        return F.struct(F.lit(disposition).alias("disposition"), reasons.alias("reasons"), missing.alias("missing_inputs"), F.lit(eligible).alias("eligible"))

    seen = ("scope_matched", "approved", "effective_at_requested_time")
    cascade = (
        F.when(F.col("known").isNull(), row("unresolved", _reasons("relation_invalid"), _reasons("document_profile")))
        .when(F.col("match") == "mismatch", row("excluded", _reasons("scope_mismatch")))
        .when(F.col("match") == "missing", row("unresolved", _reasons("scope_input_missing"), dims))
        .when(~F.coalesce("approved", F.lit(False)), row("excluded", _reasons("scope_matched", "not_approved")))
        .when(bounded & F.col("as_of").isNull(), row("unresolved", _reasons("scope_matched", "approved", "scope_input_missing"), _reasons("as_of")))
        .when(~F.col("eff"), row("historical", _reasons("scope_matched", "approved", "not_effective_at_requested_time")))
        .when((F.col("role") == "record") & wants, row("execution_record", _reasons(*seen, "role_matched")))
        .when(F.col("role") == "record", row("execution_record", _reasons(*seen, "role_separated")))
        .when(~wants, row("reference", _reasons(*seen, "role_separated")))
        .otherwise(row("reference", _reasons(*seen, "role_matched"), eligible=True))
    )
    df = df.withColumn("d", cascade)
    w = Window.partitionBy("case_id", "role", F.col("d.eligible")).orderBy(F.desc("authority_rank"), F.desc("relevance"), F.desc("ordinal"))
    wins = F.col("d.eligible") & (F.row_number().over(w) == 1)
    return df.withColumn("wins", wins).select(
        "case_id", "ordinal", "source_id", F.when(F.col("wins"), "canonical").otherwise(F.col("d.disposition")).alias("disposition"),
        F.when(F.col("wins"), F.concat("d.reasons", _reasons("higher_authority"))).otherwise(F.col("d.reasons")).alias("reasons"), "d.missing_inputs",
    )


_SILENT = ("proposes_change_to", "evaluates", "approves", "implements_decision", "conflicts_with")


def fold_edges(decisions: dict[str, dict], edges: list[dict], requested: set[str]) -> None:
    """Apply relations in order: later edges see what earlier ones wrote, so this is a fold and not a join.

    decisions: source_id to {disposition, reasons, path, role, approved, official, known}; edges carry active (scope and
    time hold), clause (the clause filter holds) and the relation's fields. Edges with an end outside of ``decisions`` only
    tell that their source amends something: while the clauses asked for are others, that of any active amendment counts;
    in the last pass only that of amendments of these clauses."""
    amends = [e for e in edges if e["kind"] == "amends" and e["active"]]
    amending, amending_here = {e["source_id"] for e in amends}, {e["source_id"] for e in amends if e["clause"]}

    def mark(node: dict, disposition: str | None, reason: str | None, edge: str | None) -> None:
        if disposition:
            node["disposition"] = disposition
        if reason and reason not in node["reasons"]:
            node["reasons"].append(reason)
        if edge and edge not in node["path"]:
            node["path"].append(edge)

    for e in edges:
        s, t, kind, pos, edge = decisions.get(e["source_id"]), decisions.get(e["target_id"]), e["kind"], e["position"], e["id"]
        if s is None or t is None:
            continue
        if not e["active"]:
            if kind == "exception_to":
                mark(s, None, "exception_scope_mismatch", None)
            continue
        if not s["known"]:
            continue
        if not s["approved"] and not (kind == "proposes_change_to" and pos == "non_effective" and s["role"] == "proposal"):
            mark(s, None, "relation_invalid", None)
            continue
        if s["disposition"] in ("historical", "unresolved") or s["disposition"] == "excluded" and kind not in ("derived_from", "proposes_change_to", "evaluates"):
            continue
        wanted = s["role"] in requested
        if not e["clause"]:
            if kind == "amends":
                mark(s, "reference", "clause_amendment", None)
                mark(t, "reference" if e["target_id"] in amending else "canonical", None, None)
            elif kind == "order_of_precedence":
                mark(s, "reference", "contract_precedence", None)
                mark(t, "canonical", None, None)
            continue
        rule = {
            ("operational_position", "dominates"): ("canonical", "reference", "contract_precedence", "contract_precedence"),
            ("operational_position", "conditional"): ("instance_exception", "canonical", "applicable_exception", "applicable_exception"),
            ("operational_position", "non_effective"): ("excluded", "canonical", "not_approved", "approved"),
            ("operational_position", "unresolved"): ("unresolved", "unresolved", "position_unresolved", "position_unresolved"),
        }.get((kind, pos)) or {
            "supersedes": ("canonical" if wanted else "reference", "historical", "superseded", "superseded"),
            "amends": ("canonical", "canonical", "clause_amendment", "clause_amendment"),
            "exception_to": ("instance_exception", "canonical", "applicable_exception", "applicable_exception"),
            "order_of_precedence": ("canonical", "reference", "contract_precedence", "contract_precedence"),
            "records_execution_of": ("execution_record", None, "execution_evidence", "execution_evidence"),
            "applies_to": ("canonical" if wanted else None, None, "scope_matched" if wanted else None, None),
        }.get(kind)
        if kind == "derived_from" and s["official"] is False and t["official"] is True:
            mark(s, "excluded", "non_official_copy", edge)
            blocked = t["disposition"] in RECORD_BLOCK
            mark(t, None if blocked else "canonical", None if blocked else "official_record", edge)
        elif rule:
            mark(s, rule[0], rule[2], edge)
            if kind not in ("records_execution_of", "applies_to"):  # these say nothing of their target
                mark(t, rule[1], rule[3], edge)
        elif kind in _SILENT or kind == "derived_from":
            mark(s, None, None, edge)
            mark(t, None, None, edge)
    for e in amends:  # an amendment that is itself amended steps back, whatever the order of edges
        if e["clause"] and e["source_id"] in decisions and e["target_id"] in decisions and e["target_id"] in amending_here:
            mark(decisions[e["target_id"]], "reference", "clause_amendment", e["id"])


def official_record_pass(s2: DataFrame, candidates: DataFrame, contexts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Where records are asked for and a case has official execution records beside known copies, the official one of the
    highest authority, then relevance, then the later, is canonical, and the copies are excluded."""
    prof = profiles.select("source_id", "official_record", F.coalesce("authority_rank", F.lit(0)).alias("rank"))
    wants = contexts.select("case_id", F.coalesce(F.array_contains("requested_roles", F.lit("record")), F.lit(False)).alias("wants"))
    df = s2.join(prof, "source_id", "left").join(wants, "case_id", "left").join(candidates.select("case_id", "ordinal", "relevance"), ["case_id", "ordinal"], "left")
    is_record = (F.col("disposition") == "execution_record") & F.coalesce("wants", F.lit(False))
    df = df.withColumns({"official": is_record & F.coalesce("official_record", F.lit(False)), "copy": is_record & F.coalesce(~F.col("official_record"), F.lit(False))})
    case = Window.partitionBy("case_id")
    both = F.max("official").over(case) & F.max("copy").over(case)
    best = F.row_number().over(case.orderBy(F.desc("official"), F.desc("rank"), F.desc("relevance"), F.desc("ordinal"))) == 1
    df = df.withColumns({"wins": both & F.col("official") & best, "copy": both & F.col("copy")})
    reason = F.when(F.col("wins"), _reasons("official_record")).when(F.col("copy"), _reasons("non_official_copy")).otherwise(_reasons())
    out = df.withColumn("disposition", F.when(F.col("wins"), "canonical").when(F.col("copy"), "excluded").otherwise(F.col("disposition")))
    return out.withColumn("reasons", F.array_union("reasons", reason)).select(*s2.columns)


def resolve_s3(candidates: DataFrame, contexts: DataFrame, profiles: DataFrame, relations: DataFrame) -> DataFrame:
    """S2, the official-record pass, then the fold over the relations of the case's candidates in the order of
    ``relations.ordinal``, without such a column in order of id.

    Relations meet candidates in equi-joins; a group of the fold is one case with its edges, at most a few rows. An
    amendment whose target is no candidate is kept for what it says of its source."""
    base = official_record_pass(resolve_s2(candidates, contexts, profiles), candidates, contexts, profiles)
    if "ordinal" not in relations.columns:
        relations = relations.withColumn("ordinal", F.lit(0))
    prof = profiles.select("source_id", "role", F.coalesce("approved", F.lit(False)).alias("approved"), "official_record", F.lit(True).alias("known"))
    nodes = base.join(prof, "source_id", "left")
    ends = candidates.select("case_id", "source_id").distinct()
    ctx = contexts.select("case_id", "as_of", "requested_clauses", "requested_roles", F.col("scope").alias("wanted"))
    edges = relations.join(ends.withColumnRenamed("source_id", "s"), F.col("source_id") == F.col("s")).join(ends.select(F.col("case_id").alias("c2"), F.col("source_id").alias("t")), (F.col("target_id") == F.col("t")) & (F.col("case_id") == F.col("c2")), "left")
    edges = edges.filter("t IS NOT NULL OR kind = 'amends'").join(ctx, "case_id")
    edges = edges.withColumn("active", (S.scope_match(F.col("scope"), F.col("wanted")) == "match") & T.effective(F.col("valid_from"), F.col("valid_to"), F.col("as_of")))
    edges = edges.withColumn("clause", S.clause_requested(F.col("requested_clauses"), F.col("kind"), F.col("source_clauses"), F.col("target_clauses")))
    edges = edges.select("case_id", F.struct("ordinal", "id", "kind", F.coalesce("position", F.lit("unresolved")).alias("position"), "source_id", "target_id", "active", "clause").alias("e")).groupBy("case_id").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    kind = "case_id string, ordinal long, source_id string, disposition string, reasons array<string>, relation_path array<string>, missing_inputs array<string>"
    grouped = nodes.join(edges, "case_id", "left").join(ctx.select("case_id", "requested_roles"), "case_id", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        state = {r.source_id: {"disposition": r.disposition, "reasons": list(r.reasons), "path": [], "role": r.role, "approved": bool(r.approved) if r.known is True or r.known == True else False, "official": None if pd.isna(r.official_record) else bool(r.official_record), "known": bool(r.known) if not pd.isna(r.known) else False} for r in pdf.itertuples()}  # noqa: E712
        first = pdf.iloc[0]
        edges_ = [dict(e) for e in first["edges"]] if first["edges"] is not None else []
        fold_edges(state, edges_, set(first["requested_roles"]) if first["requested_roles"] is not None else set())
        return pd.DataFrame({
            "case_id": pdf["case_id"], "ordinal": pdf["ordinal"], "source_id": pdf["source_id"], "disposition": [state[s]["disposition"] for s in pdf["source_id"]],
            "reasons": [state[s]["reasons"] for s in pdf["source_id"]], "relation_path": [state[s]["path"] for s in pdf["source_id"]], "missing_inputs": [list(m) for m in pdf["missing_inputs"]],
        })

    return grouped.groupBy("case_id").applyInPandas(fold, kind)


__all__ = ["fold_edges", "official_record_pass", "resolve_r0", "resolve_s1", "resolve_s2", "resolve_s3", "weighted_score"]
