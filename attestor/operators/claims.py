"""Claims: clean-up, validation with all reasons, metadata of their evidence, conflicts and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import temporal as T
from ..functions import text as X

TERMINAL = ("rejected", "superseded", "retired", "stale")
CURRENT = ("active", "approved", "implemented", "current")
PENDING = ("proposed", "draft")
#: Words by which a predicate has one value: alone, or behind an underscore; and predicates that have one besides.
SINGLE_WORDS = "allowed deadline duration enabled interval limit maximum minimum required status version window within".split()
SINGLE_NAMES = "access_approver allows_self_approval has_formal_owner incident_commander is_approved_as notification_approver requires_approval requires_review retention_period".split()
#: Predicates whose values exclude each other under one condition only, besides those that speak of a deadline.
CONDITIONAL_NAMES = "access_approver access_duration allows_review_omission allows_self_approval incident_commander is_approved_as notification_approver requires_approval requires_review".split()
#: What makes a date a span of time.
RELATIVE = "営業日|年以内|月以内|週以内|日以内|分以内|時間以内|週間以内|years|months|weeks|days|hours|minutes"
DENIALS = "なし|不可|禁止|認めない|false"
#: Headings under which a source's units support a predicate.
HEADINGS = {
    "incident_cause": ["cause", "root cause", "原因"],
    "permanent_remediation": ["corrective action", "permanent remediation", "恒久対策"],
    "temporary_remediation": ["mitigation", "recovery", "復旧", "暫定対応"],
}


def single_valued(predicate: Column) -> Column:
    p = X.normalized_key(predicate)
    words = "|".join(SINGLE_WORDS)
    return (p != "has_status") & (p.rlike(f"^(?:{words})$|_(?:{words})") | p.isin(*SINGLE_NAMES))


def needs_condition(predicate: Column) -> Column:
    p = X.normalized_key(predicate)
    return F.contains(p, F.lit("deadline")) | p.isin(*CONDITIONAL_NAMES)


def semantics(claims: DataFrame) -> DataFrame:
    """Relative durations are no dates; what a claim of a review says moves into its condition, the object becoming true;
    whether self-approval is allowed becomes true or false."""
    dated = lambda c: F.when(~F.lower(X.trim(c)).rlike(RELATIVE), c)
    review, own = F.col("predicate").isin("requires_review", "allows_review_omission"), F.col("predicate") == "allows_self_approval"
    said = X.blank_to_null(X.scalar_claim_text(F.col("object")))
    denied = F.lower(F.coalesce(said, X.trim(F.col("object")), F.lit(""))).rlike(DENIALS)
    return claims.withColumns({
        "valid_from": dated(F.col("valid_from")), "valid_to": dated(F.col("valid_to")),
        "condition": F.when(review & said.isNotNull(), X.append_condition(F.col("condition"), said)).otherwise(F.col("condition")),
        "object": F.when(review, "true").when(own, F.when(denied, "false").otherwise("true")).otherwise(F.col("object")),
    })


def rejections(claims: DataFrame, known: DataFrame) -> DataFrame:
    """claims with reasons: every rule a candidate breaks, in a fixed order; empty for good ones.

    References are checked by one equi-join on the exploded evidence, not by a set on the driver."""
    refs = claims.select("id", F.explode("evidence").alias("r")).select("id", "r.source_id", "r.evidence_id")
    lost = refs.join(known.select("source_id", "evidence_id"), ["source_id", "evidence_id"], "left_anti").groupBy("id").agg(F.lit(True).alias("lost"))
    blank = lambda c: F.coalesce(X.trim(F.col(c)) == "", F.lit(True))
    bad = lambda c: F.col(c).isNotNull() & T.parse_date(F.col(c)).isNull()
    conf = F.col("confidence")
    rules = [
        (blank("subject"), "subject_required"), (blank("predicate"), "predicate_required"), (blank("object"), "object_required"),
        (conf.isNull() | F.isnan(conf) | (conf < 0) | (conf > 1), "confidence_out_of_range"), (F.coalesce(F.size("evidence") <= 0, F.lit(True)), "evidence_required"),
        (bad("valid_from"), "valid_from_invalid"), (bad("valid_to"), "valid_to_invalid"),
        (F.coalesce(T.parse_date(F.col("valid_from")) > T.parse_date(F.col("valid_to")), F.lit(False)), "valid_range_reversed"), (F.coalesce("lost", F.lit(False)), "evidence_unknown"),
    ]
    return claims.join(lost, "id", "left").withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).drop("lost")


def single_distinct(c: str) -> Column:
    """The value if a group holds exactly one distinct non-null one."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def evidence_metadata(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, authority, status, valid_from, valid_to) where all evidence of a claim agrees, else null."""
    refs = claims.select("id", F.explode("evidence").alias("r")).select("id", "r.source_id", "r.evidence_id")
    return refs.join(evidence, ["source_id", "evidence_id"]).groupBy("id").agg(single_distinct("authority").alias("authority"), single_distinct("lifecycle").alias("status"), single_distinct("valid_from").alias("valid_from"), single_distinct("valid_to").alias("valid_to"))


def structured_evidence(claims: DataFrame, evidence: DataFrame, headings: dict[str, list[str]] = HEADINGS) -> DataFrame:
    """claims whose predicate has expected headings get the units of their sources under these as further evidence."""
    spark = claims.sparkSession
    want = spark.createDataFrame([(p, h.lower()) for p, hs in headings.items() for h in hs], "predicate string, heading string")
    refs = claims.select("id", "predicate", F.explode("evidence.source_id").alias("source_id")).distinct()
    units = evidence.select("source_id", "evidence_id", X.normalized_key(F.try_element_at(F.col("heading_path"), F.lit(-1))).alias("heading"), "text").filter(~F.ltrim("text").startswith("#"))
    more = refs.join(F.broadcast(want), "predicate").join(units, ["source_id", "heading"]).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("source_id", "evidence_id"))).alias("more"))
    return claims.join(more, "id", "left").withColumn("evidence", F.array_union("evidence", F.coalesce("more", F.array().cast("array<struct<source_id:string,evidence_id:string>>")))).drop("more")


def state_rank(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), 2).when(status.isin(*PENDING), 1).when(status.isin(*CURRENT), 0)


def conflict_pairs(claims: DataFrame) -> DataFrame:
    """Pairs of claims (l before r by id) that fill one slot with objects that are neither equivalent nor compatible.

    Subjects are equal, or one is a suffix of 4 characters or more of the other. Equal ones meet in an equi-join that also
    holds predicate and, where the predicate needs it, condition. Of the distinct subjects, those that end in another whole
    subject are found by their suffixes, and their claims meet the other's. Claims go whole into these joins, which drop
    objects that agree: no pair is shuffled, only claims are."""
    c = claims.filter(single_valued(F.col("predicate")))
    c = c.withColumn("k", X.normalized_key(F.col("subject"))).withColumn("p", X.normalized_key(F.col("predicate")))
    c = c.withColumn("slot", F.when(needs_condition(F.col("p")), F.coalesce(X.normalized_condition(F.col("condition")), F.lit(""))).otherwise(F.lit("")))
    text = X.scalar_claim_text(F.col("object"))
    c = c.withColumn("norm", X.scalar_normalize(text)).withColumn("span", X.duration_constraint(text))
    c = c.withColumn("sources", F.array_sort(F.array_distinct(F.col("evidence.source_id"))))
    n = F.char_length("k")
    suffixes = F.when(n > 4, F.transform(F.sequence(F.lit(2), F.greatest(n - 3, F.lit(2))), lambda i: F.substr(F.col("k"), i))).otherwise(F.array().cast("array<string>"))
    cols = ["id", "subject", "object", "condition", "valid_from", "valid_to", "authority", "status", "evidence"]
    carried = [*cols, "norm", "span", "sources"]
    side = lambda x, k="k": c.select("p", "slot", F.col("k").alias(k), *[F.col(y).alias(f"{x}_{y}") for y in carried])
    agree = (F.col("a_object") == F.col("b_object")) | F.coalesce(F.col("a_norm") == F.col("b_norm"), F.lit(False)) | F.coalesce(F.col("a_span") == F.col("b_span"), F.lit(False))
    agree |= X.objects_compatible(F.col("p"), F.col("a_object"), F.col("b_object"), F.coalesce(F.arrays_overlap("a_sources", "b_sources"), F.lit(False)))
    ca, cb = X.normalized_condition(F.col("a_condition")), X.normalized_condition(F.col("b_condition"))
    alternatives = F.coalesce((F.col("a_sources") == F.col("b_sources")) & (F.size("a_sources") > 0) & (ca != cb), F.lit(False))
    equal = side("a").join(side("b"), ["p", "slot", "k"]).filter((F.col("a_id") < F.col("b_id")) & ~agree & ~alternatives)
    subjects = c.select("p", "slot", "k").distinct()
    tails = subjects.select("p", "slot", F.col("k").alias("whole"), F.explode(suffixes).alias("k")).join(subjects, ["p", "slot", "k"], "left_semi")
    longer = side("b", "whole").join(tails, ["p", "slot", "whole"]).drop("whole")
    tail = side("a").join(longer, ["p", "slot", "k"]).filter((F.col("a_id") != F.col("b_id")) & ~agree & ~alternatives)
    first = F.col("a_id") < F.col("b_id")
    order = lambda left: [F.when(left, F.col(f"{x}_{y}")).otherwise(F.col(f"{z}_{y}")).alias(f"{w}_{y}") for y in cols for w, x, z in (("l", "a", "b"), ("r", "b", "a"))]
    plain = [F.col(f"{x}_{y}").alias(f"{w}_{y}") for y in cols for w, x in (("l", "a"), ("r", "b"))]
    return equal.select(*plain, F.col("p").alias("predicate")).unionByName(tail.select(*order(first), F.col("p").alias("predicate")))


def resolve_conflicts(pairs: DataFrame, as_of: str, precedence: list[str]) -> DataFrame:
    """kind, status and the winning claim of each pair: disjoint validity, one side active, state, then authority."""
    at = F.lit(as_of)
    active = {s: T.claim_active(F.col(f"{s}_valid_from"), F.col(f"{s}_valid_to"), at) for s in "lr"}
    rank = {s: F.nullif(F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col(f"{s}_authority")), F.lit(0).cast("long")) for s in "lr"}
    ended = {s: F.coalesce(F.col(f"{s}_status").isin(*TERMINAL), F.lit(False)) for s in "lr"}
    state = {s: state_rank(F.col(f"{s}_status")) for s in "lr"}
    disjoint = T.validity_disjoint(F.col("l_valid_from"), F.col("l_valid_to"), F.col("r_valid_from"), F.col("r_valid_to"))
    state_left = (ended["r"] & ~ended["l"]) | (F.coalesce(state["l"] < state["r"], F.lit(False)) & (ended["l"] == ended["r"]))
    state_right = (ended["l"] & ~ended["r"]) | (F.coalesce(state["r"] < state["l"], F.lit(False)) & (ended["l"] == ended["r"]))
    known = F.coalesce(rank["l"] != rank["r"], F.lit(False))
    made = lambda kind, winner: F.struct(F.lit(kind).alias("kind"), F.lit("resolved").alias("status"), winner.cast("string").alias("winner"))
    side = lambda left: F.when(left, F.col("l_id")).otherwise(F.col("r_id"))
    later = F.when(active["l"] & ~active["r"], F.col("l_id")).when(active["r"] & ~active["l"], F.col("r_id"))
    out = (
        F.when(disjoint, made("temporal", later))
        .when(active["l"] != active["r"], made("temporal", side(active["l"])))
        .when(state_left | state_right, made("state", side(state_left)))
        .when(known, made("authority", side(rank["l"] < rank["r"])))
        .otherwise(F.struct(F.lit("semantic").alias("kind"), F.lit("unresolved").alias("status"), F.lit(None).cast("string").alias("winner")))
    )
    return pairs.withColumn("o", out).select(X.conflict_id(F.col("l_id"), F.col("r_id")).alias("conflict_id"), "l_id", "r_id", "o.kind", "o.status", "o.winner")


def source_metadata(claims: DataFrame, evidence: DataFrame, refresh: bool = False) -> DataFrame:
    """claims with authority, status and dates of their evidence where that holds one value: authority is null otherwise,
    the others stay as they are, or (``refresh``, when old claims meet new metadata) are null too."""
    meta = evidence_metadata(claims, evidence).select("id", F.struct("authority", "status", "valid_from", "valid_to").alias("__m"))
    joined = claims.join(meta, "id", "left")
    others = {c: F.col(f"__m.{c}") if refresh else F.coalesce(F.col(f"__m.{c}"), F.col(c)) for c in ("status", "valid_from", "valid_to")}
    return joined.withColumns({"authority": F.col("__m.authority"), **others}).select(*claims.columns)


def relation_overrides(conflicts: DataFrame, claims: DataFrame, relations: DataFrame, profiles: DataFrame, as_of: str) -> DataFrame:
    """(conflict_id, winner, kind) of unresolved conflicts that relations or roles decide, the first way that does: an
    active amends edge between the two sides' sources whose clauses name both subjects; an active exception_to from one
    side against sources that its target is or governs (they apply it, in a compatible scope, actively); claims of
    unapproved proposals alone, on both sides without a winner; records, and sources that actively record an execution,
    on one side only. Of several edges the first by id decides."""
    open_ = conflicts.filter("status = 'unresolved'").select("conflict_id", "l_id", "r_id")
    src = claims.select("id", "subject", F.explode(F.array_distinct(F.col("evidence.source_id"))).alias("source_id"))
    side = lambda s: src.select(F.col("id").alias(f"{s}_id"), F.col("subject").alias(f"{s}_subject"), F.col("source_id").alias(f"{s}_source"))
    both = open_.join(side("l"), "l_id").join(side("r"), "r_id")
    active = relations.filter(T.relation_active(F.col("valid_from"), F.col("valid_to"), F.lit(as_of)))
    edge = ["id", "kind", F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.concat("source_clauses", "target_clauses").alias("clauses")]
    amends = active.filter("kind = 'amends'").select(*edge)
    exceptions = active.filter("kind = 'exception_to'")
    applied = active.filter("kind = 'applies_to'").select(F.col("source_id").alias("by"), F.col("target_id").alias("target_id"), F.col("scope").alias("by_scope"))
    hop = exceptions.join(applied, "target_id").filter(S.compatible_for_override(F.col("by_scope"), F.col("scope"))).select("id", "kind", F.col("source_id").alias("s"), F.col("by").alias("t"), F.concat("source_clauses", "target_clauses").alias("clauses"))
    live = amends.unionByName(exceptions.select(*edge)).unionByName(hop)
    flip = both.select("conflict_id", F.col("l_id").alias("win"), F.col("l_source").alias("s"), F.col("r_source").alias("t"), "l_subject", "r_subject", F.lit(0).alias("right")).unionByName(both.select("conflict_id", F.col("r_id").alias("win"), F.col("r_source").alias("s"), F.col("l_source").alias("t"), "l_subject", "r_subject", F.lit(1).alias("right")))
    named = F.exists("clauses", lambda c: X.subjects_equivalent(c, F.col("l_subject"))) & F.exists("clauses", lambda c: X.subjects_equivalent(c, F.col("r_subject")))
    by_edge = flip.join(live, ["s", "t"]).filter((F.col("kind") == "exception_to") | named).select("conflict_id", F.when(F.col("kind") == "amends", 1).otherwise(2).alias("turn"), F.col("id").alias("edge"), "right", "win", F.lit("explicit_override").alias("kind"))
    executed = active.filter("kind = 'records_execution_of'").select("source_id", F.lit(True).alias("executes")).distinct()
    role = profiles.select("source_id", ((F.col("role") == "proposal") & ~F.coalesce("approved", F.lit(False))).alias("proposal"), (F.col("role") == "record").alias("record"))
    flags = src.join(role, "source_id", "left").join(executed, "source_id", "left").groupBy("id").agg(F.min(F.coalesce("proposal", F.lit(False))).alias("proposal"), F.max(F.coalesce("record", F.lit(False)) | F.coalesce("executes", F.lit(False))).alias("record"))
    sides = open_.join(flags.select(F.col("id").alias("l_id"), F.col("proposal").alias("lp"), F.col("record").alias("lr")), "l_id").join(flags.select(F.col("id").alias("r_id"), F.col("proposal").alias("rp"), F.col("record").alias("rr")), "r_id")
    proposed = F.expr("lp OR rp")
    loser = lambda l, r: F.when(F.col(l) & F.col(r), F.lit(None).cast("string")).when(F.col(l), F.col("r_id")).otherwise(F.col("l_id"))  # noqa: E731, E741
    by_role = sides.filter("lp OR rp OR lr <> rr").select("conflict_id", F.when(proposed, 3).otherwise(4).alias("turn"), F.lit("").alias("edge"), F.lit(0).alias("right"), F.when(proposed, loser("lp", "rp")).otherwise(loser("lr", "rr")).alias("win"), F.when(proposed, "state").otherwise("explicit_override").alias("kind"))
    w = Window.partitionBy("conflict_id").orderBy("turn", "edge", "right")
    return by_edge.unionByName(by_role).withColumn("n", F.row_number().over(w)).filter("n = 1").select("conflict_id", F.col("win").alias("winner"), "kind")


def build_status(diagnostics: DataFrame, unresolved: int | Column, allowed: bool, warnings_as_errors: bool = False) -> DataFrame:
    """One row: counts by severity and completed, completed_with_warnings or failed."""
    n = lambda s: F.count_if(F.col("severity") == s)
    row = diagnostics.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    fails = (F.col("errors") > 0) | (F.lit(warnings_as_errors) & (F.col("warnings") > 0)) | (F.lit(not allowed) & (F.lit(unresolved) > 0 if isinstance(unresolved, int) else unresolved > 0))
    return row.withColumn("status", F.when(fails, "failed").when(F.col("warnings") > 0, "completed_with_warnings").otherwise("completed"))
