"""Scan, compile, recompile and export: the operators put together over folders of Parquet and JSON Lines.

Only configuration, locks, staging and the manifest live on the driver; all that is tabular stays DataFrames. The
metadata provider is built in: profiles come from front matter, claims from a table, and other providers plug in as a
function from evidence to claims (``mapInPandas`` fits).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import text as X
from ..operators import candidates as C
from ..operators import claims as CL
from ..operators import coverage as CV
from ..operators import evidence as E
from ..operators import export as EX
from ..operators import normalize as N
from ..operators import packets as P
from ..operators import parse as PA
from ..operators import relations as R
from ..operators import rerank as RR
from ..schemas import CLAIM, DIMENSIONS, SCHEMA_VERSION
from ..sources import scan as SC
from ..sources.tables import materialise
from ..sources.workspace import Workspace, WorkspaceError, content_hash, publish, staging, table_hash

PARSER_KEY = f"attestor-parser:1:{SCHEMA_VERSION}"


@dataclass
class Intent:
    id: str
    goal: str
    users: list[str]
    tasks: list[str]
    questions: list[str]
    unresolved_conflicts_allowed: bool = True
    as_of: str = "2024-01-01"
    warnings_as_errors: bool = False
    precedence: list[str] = field(default_factory=list)

    def validate(self) -> list[str]:
        """All rules that the intent breaks."""
        import re

        out = [] if re.fullmatch(r"[a-z][a-z0-9_-]*", self.id or "") else ["id_invalid"]
        out += ["goal_required"] if not (self.goal or "").strip() else []
        for name in ("users", "tasks", "questions"):
            values = getattr(self, name)
            out += [f"{name}_required"] if not values else []
            out += [f"{name}_blank"] if any(not (v or "").strip() for v in values) else []
            out += [f"{name}_repeated"] if len(set(values)) < len(values) else []
        return out

    def wants_checklist(self) -> bool:
        text = " ".join([self.goal, *self.tasks, *self.questions]).lower()
        return any(w in text for w in ("チェックリスト", "リリース", "checklist", "release"))


def load_intent(path: str | Path) -> Intent:
    """An intent from YAML (or JSON, which is YAML); unknown keys are an error. Without a YAML parser only JSON is read."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return Intent(**json.loads(text))
    return Intent(**yaml.safe_load(text))


@dataclass
class CorpusSettings:
    """What corpus.yaml beside the source root says: globs with their authority and lifecycle, and authorities in order
    of precedence."""

    authority_hints: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    authority_precedence: list[str] = field(default_factory=list)


def corpus_settings(source_root: str | Path) -> CorpusSettings:
    """Settings of the collection; none without the file or a YAML parser."""
    path = Path(source_root).parent / "corpus.yaml"
    if not path.is_file():
        return CorpusSettings()
    try:
        import yaml
    except ImportError as e:
        raise WorkspaceError("corpus.yaml needs a YAML parser") from e
    found = yaml.safe_load(path.read_text()) or {}
    hints = [(h["pattern"], h.get("authority"), h.get("lifecycle")) for h in found.get("authority_hints") or []]
    return CorpusSettings(hints, list(found.get("authority_precedence") or []))


def render_profile(precedence: list[str]) -> str:
    """The retrieval contract of a build as YAML."""
    lines = [f'schema_version: "{SCHEMA_VERSION}"', "require_evidence: true", "filters: [intent_id, as_of]", f"authority_precedence: {json.dumps(precedence, ensure_ascii=False)}", f"authority_score_step: {RR.AUTHORITY_STEP}"]
    lines += ["rerank:", f"  algorithm: {RR.NAME}", f"  candidate_limit: {RR.LIMIT}", "  candidate_set: preserve", "  tie_breaker: original_rank", "  role_offsets:"]
    return "\n".join([*lines, *(f"    {role}: {offset}" for role, offset in RR.OFFSETS.items())]) + "\n"


def scan(spark: SparkSession, root: str, workspace: Workspace, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Scan a folder into the workspace: catalog, parsed units, manifest. Returns the catalog.

    Files are hashed as bytes. What is no UTF-8, empty, or beyond the size limit, is in state error with a warning; no
    file ends the scan. Units of documents that the last scan parsed already, with the same content, are taken over."""
    with workspace.lock("scan"):
        workspace.bind_source_root(root)
        files = SC.glob_filter(SC.read_files(spark, root), include, exclude)
        seen = materialise(SC.mark_duplicates(SC.inspect_content(files, max_bytes)).withColumn("parser_key", F.lit(PARSER_KEY)))
        current = seen.drop("text")
        previous = workspace.read_catalog(spark)
        if previous is None:
            previous = spark.createDataFrame([], SC.CATALOG)
        live = previous.filter("state <> 'removed'")
        scanned = materialise(SC.parse_cache(SC.changes(current, live), live, PARSER_KEY))
        gone = SC.removed(current, live)
        row = SC.summary(scanned, gone).first().asDict()
        gone_paths = [r["path"] for r in gone.orderBy("path").collect()]
        row["cache_hits"] = scanned.filter("cache_hit").count()
        fresh = seen.filter("state = 'parsed'").join(scanned.filter("NOT cache_hit").select("path"), "path", "left_semi")
        units = PA.parse_markdown(fresh.filter(F.col("format").isin("md", "markdown"))).unionByName(PA.parse_text(fresh.filter("format = 'txt'")))
        kept = workspace.read_table(spark, "units")
        if kept is not None and row["cache_hits"]:
            units = kept.join(scanned.filter("cache_hit").select("source_id"), "source_id", "left_semi").select(*units.columns).unionByName(units)
        workspace.write_table(units, "units")
        workspace.write_table(SC.duplicate_aliases(current), "aliases")
        scan_id = hashlib.sha256(json.dumps([row, str(previous.count())], sort_keys=True).encode()).hexdigest()[:16]
        workspace.write_catalog(SC.upsert(previous, current, scan_id))
        workspace.write_manifest({"schema_version": SCHEMA_VERSION, "source_root": root, "summary": row, "removed_paths": gone_paths})
        return workspace.read_catalog(spark)


def front_matter(units: DataFrame) -> DataFrame:
    """What the front matter of a source says, one row of each source that has some; what it leaves open is null."""
    t = F.col("text")
    fm = lambda k: X.front_matter_value(t, k)
    flag = lambda k: F.when(fm(k) == "true", True).when(fm(k) == "false", False)
    level = F.when(fm("force").isin("mandatory", "recommended"), fm("force")).when(fm("force").isNotNull(), "informational")
    return units.filter("kind = 'metadata'").select(
        "source_id", fm("document_id").alias("document_id"), F.coalesce(fm("revision"), fm("version")).alias("revision"), fm("document_type").alias("document_type"), F.when(fm("document_type").isNotNull(), X.role_from_type(fm("document_type"))).alias("role"), fm("status").alias("status"),
        level.alias("level"), fm("force_rank").try_cast("int").alias("authority_rank"), flag("approved").alias("approved"), X.front_matter_scope(t).alias("scope"), F.coalesce(fm("valid_from"), fm("effective_from")).alias("valid_from"), F.coalesce(fm("valid_to"), fm("effective_to")).alias("valid_to"),
        flag("official_record").alias("official_record"), fm("scenario").alias("scenario"), fm("purpose").alias("purpose"), fm("position").alias("position"), fm("position_target_document_id").alias("position_target_document_id"), fm("position_target_revision").alias("position_target_revision"),
    )


def document_profiles(units: DataFrame, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles, diagnostics): extracted profiles that hold, the fallback for other sources, and what front matter says
    over both; beside each profile the type, status, scenario, purpose and position of its front matter. With no
    provider every source has its fallback, which needs no diagnostic."""
    meta = front_matter(units)
    if extracted is None:
        base, problems = N.fallback_profiles(units), None
    else:
        base, problems = N.validate_profiles(extracted, units)
    over = N.overlay(base.drop("evidence"), meta)
    scopes = meta.select("source_id", F.col("scope").alias("m_scope"), "document_type", "status", "scenario", "purpose", "position", "position_target_document_id", "position_target_revision")
    rows = over.join(scopes, "source_id", "left").withColumn("scope", F.coalesce("m_scope", "scope")).drop("m_scope")
    return rows, problems if problems is not None else units.sparkSession.createDataFrame([], "target string, code string")


def postings(units: DataFrame, profiles: DataFrame, claims: DataFrame) -> DataFrame:
    """(source_id, key_kind, key): what two documents can have in common, for the candidate graph."""
    scope = S.exploded(profiles, "source_id").select("source_id", F.lit("scope").alias("key_kind"), F.concat_ws(":", "dim", F.lower("value")).alias("key"))
    ids = profiles.filter("document_id IS NOT NULL").select("source_id", F.lit("document").alias("key_kind"), F.lower("document_id").alias("key"))
    said = claims.select(F.explode("evidence.source_id").alias("source_id"), F.lit("claim").alias("key_kind"), F.concat_ws(":", X.normalized_key(F.col("predicate")), X.normalized_key(F.col("subject"))).alias("key"))
    body = units.filter("kind NOT IN ('metadata', 'heading')")
    quotes = body.select("source_id", F.lit("quote").alias("key_kind"), F.explode(X.quoted_phrases(F.col("text"))).alias("key"))
    words = body.select("source_id", F.explode(X.shingles(F.col("text"))).alias("key")).distinct()
    w = Window.partitionBy("source_id").orderBy(F.xxhash64("key"), "key")
    lexical = words.withColumn("n", F.row_number().over(w)).filter("n <= 64").select("source_id", F.lit("lexical").alias("key_kind"), "key")
    return scope.unionByName(ids).unionByName(said).unionByName(quotes).unionByName(lexical)


def _bare(edges: DataFrame, docs: DataFrame, units: DataFrame) -> DataFrame:
    """Edges by rule with the whole relation schema: scope and dates of the source document, evidence of both ends (their
    front matter, or else their shortest unit)."""
    none = F.array().cast("array<string>")
    key = F.struct(F.when(F.col("kind") == "metadata", 0).otherwise(1).alias("turn"), F.char_length("text").alias("n"), "line_start", "evidence_id")
    proof = units.groupBy("source_id").agg(F.min(key).alias("u")).select("source_id", F.struct("source_id", F.col("u.evidence_id").alias("evidence_id")).alias("ref"))
    rows = edges.join(docs.select("source_id", "scope", "valid_from", "valid_to"), "source_id", "left").join(proof.withColumnRenamed("ref", "sr"), "source_id", "left").join(proof.select(F.col("source_id").alias("target_id"), F.col("ref").alias("tr")), "target_id", "left")
    return rows.select("id", "kind", "position", "source_id", "target_id", none.alias("source_clauses"), none.alias("target_clauses"), "scope", "valid_from", "valid_to", F.array_compact(F.array("sr", "tr")).alias("evidence"))


def derive_relations(profiles: DataFrame, units: DataFrame, claims: DataFrame, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relations, candidate edges, unresolved slots): extracted relations and positions of front matter; stale guidance
    refined; coverage of document families; incident changes; of relations of a dossier those that its purpose allows,
    one of a kind between two documents; and the slots that it requires."""
    graph = materialise(C.candidate_graph(postings(units, profiles, claims)))
    pos = R.front_matter_positions(profiles.select("source_id", "position", "position_target_document_id", "position_target_revision"), profiles.withColumn("ordinal", F.col("source_id")))
    first = _bare(pos.select("id", "kind", "position", "source_id", "target_id"), profiles, units)
    if extracted is not None:
        first = first.unionByName(extracted.select(*first.columns))
    first = materialise(first)
    ends = first.select("source_id", "target_id")
    refined = R.refine_stale_guidance(first, profiles, R.claim_pairs(ends, claims, False))
    covered = materialise(CV.family_coverage(materialise(refined), profiles, claims, units, materialise(CV.coverage_pairs(graph, first))))
    names = F.concat(*[F.transform(S.dim(F.col("scope"), d), X.normalized_key) for d in DIMENSIONS])
    told = C.body_references(units.filter("kind <> 'metadata'"), profiles).join(profiles.select(F.col("source_id").alias("target_id"), X.normalized_key(F.col("document_id")).alias("d")), "target_id").groupBy("source_id").agg(F.collect_set("d").alias("told"))
    docs = profiles.filter("scenario IS NOT NULL AND purpose IS NOT NULL").join(told, "source_id", "left")
    docs = materialise(docs.select("source_id", "scenario", "purpose", "document_type", F.coalesce("status", F.lit("")).alias("status"), R.slot_tokens(F.col("scope")).alias("tokens"), "document_id", F.concat(names, F.coalesce("told", F.array().cast("array<string>"))).alias("names"), F.col("source_id").alias("ordinal")))
    incidents = profiles.filter("scenario IS NOT NULL").select("source_id", "scenario", "document_type", F.coalesce("status", F.lit("")).alias("status"), F.col("source_id").alias("ordinal"))
    covered, added = R.incident_change(incidents, covered, profiles, units)
    shaped = R.slot_dedup(R.slot_shape_filter(materialise(covered.unionByName(added)), docs), docs)
    shaped = materialise(shaped)
    slots = R.slot_relations(docs, profiles, units).join(shaped.select("source_id", "target_id", "kind").distinct(), ["source_id", "target_id", "kind"], "left_anti").select(*shaped.columns)
    relations = materialise(shaped.unionByName(slots))
    asked = profiles.filter("purpose IS NOT NULL").select("source_id", "purpose", "document_type", F.coalesce("status", F.lit("")).alias("status"))
    return relations, graph, R.unresolved_slots(asked, relations)


def build(spark: SparkSession, units: DataFrame, intent: Intent, output: str | Path, extract: Callable[[DataFrame], DataFrame] | None = None, profiles: DataFrame | None = None, relations: DataFrame | None = None, settings: CorpusSettings | None = None, sources: DataFrame | None = None, refresh: bool = False) -> dict:
    """Evidence units to a published build in ``output``; a failed one goes to failed-builds beside it.

    ``extract`` makes claims of evidence; ``profiles`` and ``relations`` are those of a provider. ``sources`` (source_id,
    path) meets the authority hints of ``settings``. ``refresh``: claims are old ones, and take their metadata anew.
    Every stage is a table of the build, written once and read again by the next, so no plan holds more than a stage."""
    problems = intent.validate()
    if problems:
        raise WorkspaceError(f"intent: {', '.join(problems)}")
    settings = settings or CorpusSettings()
    precedence = intent.precedence or settings.authority_precedence
    output, began = Path(output), time.monotonic()
    with staging(output, publish=False) as folder:

        def saved(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(str(folder / name))
            return spark.read.schema(df.schema).parquet(str(folder / name))

        units = saved(units, "units")
        evidence = E.propagate_metadata(units)
        if settings.authority_hints and sources is not None:
            hinted = E.authority_hints(sources.select("source_id", "path"), settings.authority_hints).select("source_id", F.col("authority").alias("a"), F.col("lifecycle").alias("l"))
            evidence = evidence.join(hinted, "source_id", "left").withColumns({"authority": F.coalesce("authority", "a"), "lifecycle": F.coalesce("lifecycle", "l")}).drop("a", "l")
        evidence = saved(evidence, "evidence")
        raw = extract(evidence) if extract else spark.createDataFrame([], CLAIM)
        if not refresh:
            raw = CL.structured_evidence(CL.semantics(materialise(raw)), evidence)
        judged = materialise(CL.rejections(CL.source_metadata(materialise(raw), evidence, refresh), evidence))
        claims = saved(R.first_wins(judged.filter(F.size("reasons") == 0).drop("reasons"), ["id"], "subject"), "claims")
        docs, profile_problems = document_profiles(units, profiles)
        docs = saved(docs, "profiles")
        bad_relations = None
        if relations is not None:
            relations, bad_relations = N.validate_relations(relations, docs, units)
        rel, graph, open_slots = derive_relations(docs, units, claims, relations)
        rel = saved(rel, "relations")
        conflicts = materialise(CL.resolve_conflicts(materialise(CL.conflict_pairs(claims)), intent.as_of, precedence))
        over = CL.relation_overrides(conflicts, claims, rel, docs, intent.as_of).select("conflict_id", F.col("winner").alias("w"), F.col("kind").alias("k"))
        decided = F.col("k").isNotNull()
        conflicts = saved(conflicts.join(over, "conflict_id", "left").select("conflict_id", "l_id", "r_id", F.coalesce("k", "kind").alias("kind"), F.when(decided, "resolved").otherwise(F.col("status")).alias("status"), F.when(decided, F.col("w")).otherwise(F.col("winner")).alias("winner")), "conflicts")
        diag = lambda df, id_, code: df.select(F.col(id_).alias("target"), F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), F.lit("warning").alias("severity"))
        found = [
            diag(conflicts.filter("status = 'unresolved'"), "conflict_id", "CST-UNRESOLVED-CONFLICT"), diag(judged.filter(F.size("reasons") > 0), "id", "EXT-INVALID-CLAIM"), diag(profile_problems, "target", F.col("code")),
            diag(N.profile_diagnostics(docs), "source_id", F.concat(F.lit("PRF-"), F.upper("code"))), diag(open_slots, "source_id", F.col("code")),
        ]
        if bad_relations is not None:
            found.append(diag(bad_relations, "target", F.col("code")))
        if intent.wants_checklist():
            found.append(diag(E.checklist_gaps(units), "evidence_id", "CST-MISSING-OWNER"))
        diagnostics = found[0]
        for more in found[1:]:
            diagnostics = diagnostics.unionByName(more)
        diagnostics = saved(diagnostics, "diagnostics")
        refs = R.relation_evidence(rel, evidence, grounded=rel.select("id", F.explode("evidence").alias("r")).select("id", "r.source_id", "r.evidence_id")).select("id", "source_id", "evidence_id")
        third = rel.select("id", F.explode("evidence").alias("r"), F.col("source_id").alias("s"), F.col("target_id").alias("t")).filter("r.source_id <> s AND r.source_id <> t").select("id", "r.source_id", "r.evidence_id")
        packets = saved(P.complementary_merge(materialise(P.build_packets(rel, materialise(refs.unionByName(third)), intent.id)), rel), "packets")
        count = lambda df: df.count()
        metrics = {
            "source_documents": count(units.select("source_id").distinct()), "evidence_units": count(evidence), "claim_candidates": count(judged), "claims": count(claims), "rejected_claims": count(judged.filter(F.size("reasons") > 0)), "conflicts": count(conflicts),
            "unresolved_conflicts": count(conflicts.filter("status = 'unresolved'")), "document_profiles": count(docs), "document_relations": count(rel), "decision_packets": count(packets), "relation_candidate_edges": count(graph), "duration_ms": int((time.monotonic() - began) * 1000),
        }
        status = CL.build_status(diagnostics, metrics["unresolved_conflicts"], intent.unresolved_conflicts_allowed, intent.warnings_as_errors).first().asDict()
        target = output if status["status"] != "failed" else output.parent / "failed-builds" / output.name
        hashes = {name: table_hash(spark, folder / name) for name in TABLES}
        (folder / "retrieval_profile.yaml").write_text(render_profile(precedence))
        manifest = {"schema_version": SCHEMA_VERSION, "intent": asdict(intent), **status, "metrics": metrics, "artifacts": hashes, "provider": "metadata" if extract is None else getattr(extract, "__name__", "custom")}
        (folder / "manifest.json").write_text(json.dumps(manifest, indent=2, sort_keys=True))
        publish(folder, target)
    return manifest | {"path": str(target)}


TABLES = ("units", "evidence", "claims", "profiles", "relations", "conflicts", "diagnostics", "packets")


def compile_build(spark: SparkSession, workspace: Workspace, intent: Intent, output: str | Path, extract=None, profiles: DataFrame | None = None, relations: DataFrame | None = None) -> dict:
    with workspace.lock("compile"):
        units, root = load_parsed(spark, workspace), workspace.config().get("source_root")
        settings = corpus_settings(root) if root else None
        return build(spark, units, intent, output, extract, profiles, relations, settings, workspace.read_catalog(spark))


def load_parsed(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """Units of the sources that the catalog has as parsed; a manifest of another schema version is an error."""
    manifest = json.loads((workspace.control / "manifest.json").read_text())
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise WorkspaceError("the parsed units have another schema version")
    parsed = workspace.read_catalog(spark).filter("state = 'parsed'").select("source_id").distinct()
    return workspace.read_table(spark, "units").join(parsed, "source_id", "left_semi")


def recompile(spark: SparkSession, source: str | Path, intent: Intent, output: str | Path) -> dict:
    """Rules again over an earlier build's units and claims, whose metadata is taken anew; nothing is extracted."""
    read_manifest(source)
    kept = spark.read.parquet(f"{source}/claims")

    def earlier(_: DataFrame) -> DataFrame:
        return kept

    return build(spark, spark.read.parquet(f"{source}/units"), intent, output, earlier, refresh=True)


def read_manifest(path: str | Path) -> dict:
    manifest = json.loads((Path(path) / "manifest.json").read_text())
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise WorkspaceError("the build has another schema version")
    return manifest


def report(spark: SparkSession, path: str | Path) -> dict:
    rows = spark.read.parquet(f"{path}/diagnostics").groupBy("code", "severity").count().orderBy("code").collect()
    return read_manifest(path) | {"diagnostics": [r.asDict() for r in rows]}


def export_records(spark: SparkSession, path: str | Path) -> DataFrame:
    """(id, payload): units, packets and diagnostics of a build as retrieval records."""
    read_manifest(path)
    t = lambda n: spark.read.parquet(f"{path}/{n}")
    units = EX.records(EX.export_units(t("evidence"), t("claims"), t("conflicts")))
    packets = EX.records(t("packets").withColumn("id", F.concat(F.lit("packet:"), "id")))
    diags = EX.records(t("diagnostics").withColumn("id", F.concat(F.lit("diagnostic:"), F.substring(F.sha2(F.concat_ws(":", "code", "target"), 256), 1, 16))).dropDuplicates(["id"]))
    return EX.assert_unique(units.unionByName(packets).unionByName(diags))


def export_jsonl(spark: SparkSession, path: str | Path, output: str) -> int:
    records = export_records(spark, path)
    records.select("payload").write.text(output)
    return records.count()


def export_delta(spark: SparkSession, base: str | Path, target: str | Path, output: str) -> dict:
    """Upserts and deletes between two builds of one intent, and a commit marker with both manifests' hashes."""
    a, b = read_manifest(base), read_manifest(target)
    if a["intent"]["id"] != b["intent"]["id"]:
        raise WorkspaceError("the builds are of different intents")
    left, right = export_records(spark, base), export_records(spark, target)
    EX.delta(left, right).write.json(output, ignoreNullFields=False)
    row = EX.delta_summary(left, right).first().asDict()
    marker = {"op": "commit", "base": content_hash(Path(base) / "manifest.json"), "target": content_hash(Path(target) / "manifest.json"), **row}
    Path(output, "_commit.json").write_text(json.dumps(marker, sort_keys=True))
    return row
