"""Scopes and clauses brought to canonical values, and profile and relation validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import temporal as T
from ..functions import text as X
from ..schemas import DIMENSIONS

EMPTY_VALUES = ("", "null", "none", "n/a", "na", "unknown", "[]", "{}", "不明", "未指定")


def alias_index(aliases: DataFrame) -> DataFrame:
    """(key, canonical, dim) from ordered (ordinal, dimension, canonical, aliases): a later entry overwrites a key."""
    keys = aliases.select("ordinal", "dimension", "canonical", F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("p", "alias"))
    w = Window.partitionBy("key").orderBy(F.desc("ordinal"), F.desc("p"))
    return keys.withColumn("key", X.normalized_key(F.col("alias"))).withColumn("n", F.row_number().over(w)).filter("n = 1").select("key", "canonical", F.col("dimension").alias("to_dim"))


def normalize_scopes(owners: DataFrame, aliases: DataFrame, universal: list[str], owner: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(owner, scope) with canonical, sorted, distinct values, and (owner, code, dim, value) of what was changed.

    Empty sentinels go; a universal value empties its dimension; an alias may move its value to another dimension."""
    rows = S.exploded(owners, owner).withColumn("key", X.normalized_key(F.col("value")))
    rows = rows.join(alias_index(aliases), "key", "left")
    code = F.when(F.col("key").isin(*EMPTY_VALUES), "scope.empty_sentinel_removed").when(F.col("key").isin(*[u.lower() for u in universal]), "scope.universal_value_normalized").when((F.col("canonical") != X.trim(F.col("value"))) | (F.col("to_dim") != F.col("dim")), "scope.alias_normalized")
    rows = rows.withColumn("code", code)
    kept = rows.filter(F.col("code").isNull() | (F.col("code") == "scope.alias_normalized")).select(owner, F.coalesce("to_dim", "dim").alias("dim"), F.coalesce("canonical", X.trim(F.col("value"))).alias("value"))
    sets = kept.groupBy(owner).agg(*[F.sort_array(F.collect_set(F.when(F.col("dim") == d, F.col("value")))).alias(d) for d in DIMENSIONS])
    out = owners.select(owner).join(sets, owner, "left").select(owner, S.scope_of(**{d: F.col(d) for d in DIMENSIONS}).alias("scope"))
    return out, rows.filter("code IS NOT NULL").select(owner, "code", "dim", "value")


def normalize_clauses(clauses: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, clause) to (id, clause, canonical): the first alias entry whose canonical equals the clause or one of whose
    aliases is contained in it. The alias table is configuration, a few rows, hence the broadcast."""
    a = aliases.select("ordinal", F.col("canonical").alias("to"), F.explode(F.concat(F.array("canonical"), "aliases")).alias("alias"))
    key = X.normalized_key(F.col("clause"))
    hit = (key == X.normalized_key(F.col("to"))) | ((F.col("alias") != F.col("to")) & key.contains(X.normalized_key(F.col("alias"))))
    best = clauses.join(F.broadcast(a), hit).groupBy("id", "clause").agg(F.min(F.struct("ordinal", "to")).alias("m"))
    return clauses.join(best, ["id", "clause"], "left").select("id", "clause", F.coalesce("m.to", X.trim(F.col("clause"))).alias("canonical"))


def profile_diagnostics(profiles: DataFrame) -> DataFrame:
    """(source_id, code) for each rule that a profile breaks."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    bad = F.lit(False)
    for c in ("valid_from", "valid_to", "observed_at"):
        bad |= F.col(c).isNotNull() & T.parse_date(F.col(c)).isNull()
    rules = [
        (F.coalesce(X.trim(F.col("source_id")) == "", F.lit(True)), "profile.empty_source_id"), (F.col("n") > 1, "profile.duplicate_source_id"),
        (~F.coalesce(F.col("authority_rank").between(0, 10), F.lit(True)), "profile.invalid_authority_rank"), (bad, "profile.invalid_date"),
        (F.coalesce(T.parse_date(F.col("valid_from")) > T.parse_date(F.col("valid_to")), F.lit(False)), "profile.invalid_time_range"),
    ]
    rows = profiles.withColumn("n", n).select("source_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules]))).alias("code"))
    return rows.distinct()


def relation_diagnostics(relations: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, code): empty or repeated ids, loops, unknown ends, amends without clauses on both sides."""
    known = profiles.select(F.col("source_id").alias("k")).distinct().withColumn("ok", F.lit(True))
    r = relations.join(known.withColumnsRenamed({"k": "ks", "ok": "source_ok"}), F.col("source_id") == F.col("ks"), "left").join(known.withColumnsRenamed({"k": "kt", "ok": "target_ok"}), F.col("target_id") == F.col("kt"), "left")
    r = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    rules = [
        (F.coalesce(X.trim(F.col("id")) == "", F.lit(True)), "relation.empty_id"), (F.col("n") > 1, "relation.duplicate_id"), (F.col("source_id") == F.col("target_id"), "relation.self_loop"),
        (F.col("source_ok").isNull(), "relation.unknown_source"), (F.col("target_ok").isNull(), "relation.unknown_target"),
        ((F.col("kind") == "amends") & ((F.size("source_clauses") <= 0) | (F.size("target_clauses") <= 0)), "relation.amends_without_clauses"),
    ]
    return r.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules]))).alias("code")).distinct()


def overlay(profiles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Front-matter values over extracted ones, ranks clamped to 0..10."""
    m = metadata.select("source_id", *[F.col(c).alias(f"m_{c}") for c in ("document_id", "revision", "role", "level", "authority_rank", "approved", "valid_from", "valid_to", "official_record")])
    joined = profiles.join(m, "source_id", "left")
    out = {c: F.coalesce(f"m_{c}", c) for c in ("document_id", "revision", "role", "level", "approved", "valid_from", "valid_to", "official_record")}
    clamped = F.when(F.col("m_authority_rank").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), F.col("m_authority_rank"))))  # greatest and least skip nulls
    out["authority_rank"] = F.coalesce(clamped, F.col("authority_rank"))
    return joined.withColumns(out).select(*profiles.columns)


def fallback_profiles(units: DataFrame) -> DataFrame:
    """A profile of each source from its front matter alone, or from its first unit without one: force by role, rank 0,
    approved only if the status says current or approved, official if it is a record."""
    first = units.groupBy("source_id").agg(F.min(F.struct(F.when(X.trim(F.col("text")).startswith("---"), 0).otherwise(1).alias("turn"), "line_start", "evidence_id", "text")).alias("u"))
    fm = lambda k: X.front_matter_value(F.col("u.text"), k)
    role = X.role_from_type(F.coalesce(fm("document_type"), F.lit("reference")))
    level = F.when(role == "normative", "mandatory").when(role == "instruction", "recommended").otherwise("informational")
    return first.select(
        "source_id", fm("document_id").alias("document_id"), F.coalesce(fm("revision"), fm("version")).alias("revision"), role.alias("role"), level.alias("level"), F.lit(0).alias("authority_rank"), F.coalesce(fm("status").isin("current", "approved"), F.lit(False)).alias("approved"),
        F.coalesce(X.front_matter_scope(F.col("u.text")), S.scope_of()).alias("scope"), F.coalesce(fm("valid_from"), fm("effective_from")).alias("valid_from"), F.coalesce(fm("valid_to"), fm("effective_to")).alias("valid_to"), F.lit(None).cast("string").alias("observed_at"), (role == "record").alias("official_record"),
        F.array(F.struct(F.col("source_id").alias("source_id"), F.col("u.evidence_id").alias("evidence_id"))).alias("evidence"),
    )


def _grounded(rows: DataFrame, known: DataFrame, key: str, own: bool) -> DataFrame:
    """rows with grounded: there is evidence, and all of it is known (``own``: and of the row's source)."""
    refs = rows.select(key, *(["source_id"] if own and key != "source_id" else []), F.explode("evidence").alias("r"))
    if own:
        refs = refs.withColumn("foreign", F.col("r.source_id") != F.col("source_id"))
    refs = refs.select(key, F.col("r.source_id").alias("ks"), F.col("r.evidence_id").alias("ke"), F.col("foreign") if own else F.lit(False).alias("foreign"))
    k = known.select(F.col("source_id").alias("ks"), F.col("evidence_id").alias("ke"), F.lit(True).alias("there")).distinct()
    ok = refs.join(k, ["ks", "ke"], "left").groupBy(key).agg(F.min(F.coalesce("there", F.lit(False)) & ~F.col("foreign")).alias("grounded"))
    return rows.join(ok, key, "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def validate_profiles(extracted: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, diagnostics (target, code)): of the extracted profiles (in order of ordinal) those of a known source,
    the first of each, all of whose evidence is the source's own; other sources get the fallback from their units. A
    source that comes several times is judged by its first profile; evidence of profiles of one source counts together."""
    sources = units.select("source_id").distinct()
    rows = _grounded(extracted, units, "source_id", True).join(sources.withColumn("known", F.lit(True)), "source_id", "left")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal")))
    good = (F.col("n") == 1) & F.coalesce("known", F.lit(False)) & F.col("grounded")
    kept = rows.filter(good)
    back = fallback_profiles(units).join(kept.select("source_id"), "source_id", "left_anti")
    columns = back.columns
    bad = rows.filter(~good).select(F.col("source_id").alias("target"), F.lit("PRF-INVALID-PROFILE").alias("code"))
    filled = back.select(F.col("source_id").alias("target"), F.lit("PRF-FALLBACK-PROFILE").alias("code"))
    return kept.select(*columns).unionByName(back), bad.unionByName(filled)


def validate_relations(candidates: DataFrame, profiles: DataFrame, units: DataFrame, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(relations, diagnostics (target, code, reason)): candidates (in order of ordinal) between two different known
    sources, the first of each id, with known evidence, and with clauses on both sides if they amend. Those outside of the
    allowed pairs (a, b) are dropped without a word."""
    if allowed is not None:
        pairs = allowed.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b")).distinct()
        candidates = candidates.join(pairs, (F.least("source_id", "target_id") == F.col("__a")) & (F.greatest("source_id", "target_id") == F.col("__b")), "left_semi")
    ids = profiles.select("source_id").distinct()
    rows = candidates.join(ids.select(F.col("source_id").alias("__s")), F.col("source_id") == F.col("__s"), "left").join(ids.select(F.col("source_id").alias("__t")), F.col("target_id") == F.col("__t"), "left")
    ends = (F.col("source_id") != F.col("target_id")) & F.col("__s").isNotNull() & F.col("__t").isNotNull()
    unique = (F.row_number().over(Window.partitionBy("id").orderBy("ordinal")) == 1) & F.coalesce(X.trim(F.col("id")) != "", F.lit(False))
    rows = rows.withColumns({"ends": ends, "unique": unique, "ref": F.concat_ws("\u0001", "id", F.col("ordinal").cast("string"))})
    rows = _grounded(rows, units, "ref", False)
    clauses = (F.col("kind") != "amends") | ((F.size("source_clauses") > 0) & (F.size("target_clauses") > 0))
    rows = rows.withColumn("clauses", clauses).withColumn("good", F.col("ends") & F.col("unique") & F.col("grounded") & F.col("clauses"))
    says = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("ends", "unique", "grounded", "clauses")])
    return rows.filter("good").select(*candidates.columns), rows.filter("NOT good").select(F.col("id").alias("target"), F.lit("PRF-INVALID-RELATION").alias("code"), says.alias("reason"))
