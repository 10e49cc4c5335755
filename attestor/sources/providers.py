"""Where a model would plug in: providers turn batches of evidence into claims, in the executors, with a cache table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.candidates import bounded_batches, edge_chunks
from ..operators.evidence import profile_score, sliding_batches, top_evidence
from ..schemas import CLAIM, SCOPE

RESPONSE = "batch_id string, response string"


class Extractor(Protocol):
    """identity names provider, model and contract, and so enters the cache key; extract answers one request as JSON."""

    identity: str

    def extract(self, request: str) -> str: ...


class MetadataProvider:
    """No claims: profiles and relations come from front matter alone."""

    identity = "metadata"

    def extract(self, request: str) -> str:
        return '{"claims": []}'


class FixedProvider:
    """The same answer to every request, for tests."""

    identity = "fixed"

    def __init__(self, response: str):
        self.response = response

    def extract(self, request: str) -> str:
        return self.response


def fingerprint(version: str, prompt: str, schema: str) -> str:
    """What a contract is known by: any change of version, prompt or response schema changes it."""
    return hashlib.sha256("\0".join((version, prompt, schema)).encode()).hexdigest()


def requests(units: DataFrame, identity: str, size: int = 12) -> DataFrame:
    """(batch_id, source_id, request, key): one request per batch, its units in order; key is what the cache knows."""
    b = sliding_batches(units, size).join(units.select("source_id", "evidence_id", "text"), ["source_id", "evidence_id"])
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "evidence_id", "text"))), lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["text"].alias("text"))))
    rows = b.groupBy("source_id", "batch").agg(body.alias("request"))
    return rows.select(F.concat_ws(":", "source_id", "batch").alias("batch_id"), "source_id", "request", F.sha2(F.concat(F.lit(f"claims{identity}\0"), "request"), 256).alias("key"))


def answer(missing: DataFrame, provider: Extractor) -> DataFrame:
    """(batch_id, key, response) of requests that the cache does not hold; partitions bound what runs at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["batch_id", "key"]].assign(response=[provider.extract(r) for r in pdf["request"]])

    return missing.select("batch_id", "key", "request").mapInPandas(run, "batch_id string, key string, response string")


def claims_of(responses: DataFrame) -> DataFrame:
    """Claims of all answers, ids from their content; the raw answer is what is cached, so rules can change later."""
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in CLAIM.fields if f.name != "id")
    parsed = responses.select("batch_id", F.explode(F.from_json("response", f"struct<claims: array<struct<{fields}>>>")["claims"]).alias("c")).select("c.*")
    trimmed = parsed.withColumn("subject", F.trim("subject")).withColumn("predicate", F.trim("predicate"))
    key = F.sha2(F.to_json(F.struct(*[c for c in trimmed.columns])), 256)
    return trimmed.withColumn("id", F.concat(F.lit("clm_"), F.substring(key, 1, 32))).dropDuplicates(["id"]).select(*[f.name for f in CLAIM.fields])


KINDS, CACHE_VERSION = ("claims", "profiles", "relations"), 1
_REFS = "evidence: array<struct<source_id: string, evidence_id: string>>"
#: What an answer of each kind must be, beside claims: a list of these under the kind's name.
SHAPES = {
    "profiles": f"source_id: string, document_id: string, revision: string, role: string, level: string, authority_rank: int, approved: boolean, scope: {SCOPE.simpleString()}, valid_from: string, valid_to: string, observed_at: string, official_record: boolean, {_REFS}",
    "relations": f"id: string, kind: string, position: string, source_id: string, target_id: string, source_clauses: array<string>, target_clauses: array<string>, scope: {SCOPE.simpleString()}, valid_from: string, valid_to: string, {_REFS}",
}


def entities_of(responses: DataFrame, kind: str) -> DataFrame:
    """Profiles or relations of all answers, with their ordinal in order of batch and place: what ``validate_profiles``
    and ``validate_relations`` take. An answer that isn't of the shape gives none."""
    rows = responses.select("batch_id", F.posexplode(F.from_json("response", f"struct<{kind}: array<struct<{SHAPES[kind]}>>>")[kind]).alias("place", "x"))
    w = Window.orderBy("batch_id", "place")
    return rows.withColumn("ordinal", F.row_number().over(w)).select("ordinal", "x.*")


def cache_folder(control: str, kind: str) -> str:
    """Where a workspace keeps the answers of one kind."""
    if kind not in KINDS:
        raise ValueError(f"no such kind of cache: {kind}")
    return f"{control}/cache/{kind}.parquet"


def load_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(key, version, response, identity) of the answers kept, of this format version alone; none without a cache."""
    schema = "key string, version int, response string, identity string"
    try:
        return spark.read.schema(schema).parquet(folder).filter(F.col("version") == CACHE_VERSION)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save_cache(answers: DataFrame, folder: str, identity: str) -> None:
    """Appends answers (key, response) whose key the cache does not hold; what is kept is never overwritten."""
    fresh = answers.select("key", F.lit(CACHE_VERSION).alias("version"), "response", F.lit(identity).alias("identity")).dropDuplicates(["key"])
    fresh.join(load_cache(answers.sparkSession, folder).select("key"), "key", "left_anti").write.mode("append").parquet(folder)


def response_schema(kind: str) -> dict:
    """The JSON schema that an answer of a kind must meet: the same fields that are read from it, nothing else."""
    fields = CLAIM if kind == "claims" else T.StructType.fromDDL(SHAPES[kind])

    def of(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(f.dataType) for f in t.fields if not (t is fields and kind == "claims" and f.name == "id")}}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        return {"type": {"boolean": ["boolean", "null"], "integer": ["integer", "null"], "float": ["number", "null"]}.get(t.typeName(), ["string", "null"])}

    return {"type": "object", "required": [kind], "additionalProperties": False, "properties": {kind: {"type": "array", "items": of(fields)}}}


#: Version and instruction of each contract; both, and the schema, are in its fingerprint.
CONTRACTS = {
    "claims": ("1", "List what the units state as claims, each with the units that state it."),
    "profiles": ("1", "Describe each document by role, force, scope and time, with the units that show it."),
    "relations": ("1", "State how the two documents of each pair stand to each other, with the units that show it, or nothing."),
}


def contract(kind: str) -> str:
    """The fingerprint of a kind's contract."""
    version, prompt = CONTRACTS[kind]
    return fingerprint(version, prompt, json.dumps(response_schema(kind), sort_keys=True))


STRATEGIES, GLOBAL_UNITS = ("global", "linear", "dossier"), 512


def _request(rows: DataFrame, by: list[str], kind: str, identity: str) -> DataFrame:
    """(batch_id, request, key) of rows with ``by``, ordinal, source_id, evidence_id and text."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "ordinal", "evidence_id", "text"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["evidence_id"].alias("evidence_id"), x["text"].alias("text"))))
    asked = rows.groupBy(*by).agg(body.alias("request")).select(F.concat_ws(":", *by).alias("batch_id"), "request")
    return asked.withColumn("key", F.sha2(F.concat(F.lit(f"{kind}{identity}{contract(kind)}\0"), "request"), 256))


def profile_requests(units: DataFrame, identity: str, strategy: str = "linear", dossiers: DataFrame | None = None) -> DataFrame:
    """(batch_id, request, key): what profiles are asked from, the eight best units of each source. linear asks for one
    source at a time, dossier for the sources of a dossier (source_id, dossier) in parts of 12, by id, and global for all
    at once, which is an error for more than GLOBAL_UNITS units."""
    best = top_evidence(units, profile_score(F.col("text"), F.col("heading_path")), 8).withColumn("ordinal", F.col("rank"))
    if strategy == "linear":
        return _request(best, ["source_id"], "profiles", identity)
    if strategy == "dossier":
        w = Window.partitionBy("dossier").orderBy("source_id")
        parts = dossiers.select("source_id", "dossier").distinct().withColumn("part", F.floor((F.row_number().over(w) - 1) / 12).cast("string"))
        return _request(best.join(parts, "source_id"), ["dossier", "part"], "profiles", identity)
    if strategy != "global":
        raise ValueError(f"no such strategy: {strategy}")
    if best.limit(GLOBAL_UNITS + 1).count() > GLOBAL_UNITS:
        raise ValueError("too many units for a single request")
    return _request(best.withColumn("all", F.lit("all")), ["all"], "profiles", identity)


def relation_requests(edges: DataFrame, units: DataFrame, identity: str, strategy: str = "linear") -> DataFrame:
    """(batch_id, request, key): what relations are asked from: batches of edges (dossier, a, b) with the three best units
    of each of their documents. linear takes 8 edges at a time, dossier up to 32 edges of at most 12 documents."""
    if strategy not in ("linear", "dossier"):
        raise ValueError(f"no such strategy for relations: {strategy}")
    whole = edges.withColumn("dossier", F.coalesce("dossier", F.lit("")))
    batched = edge_chunks(whole).withColumnRenamed("chunk", "batch") if strategy == "linear" else bounded_batches(whole)
    ends = batched.select("dossier", F.col("batch").cast("string").alias("batch"), F.explode(F.array("a", "b")).alias("source_id")).distinct()
    best = top_evidence(units, profile_score(F.col("text"), F.col("heading_path")), 3).withColumn("ordinal", F.col("rank"))
    return _request(ends.join(best, "source_id"), ["dossier", "batch"], "relations", identity)


def answered(evidence: DataFrame, provider: Extractor, folder: str | None = None) -> DataFrame:
    """(batch_id, key, response) of all batches of claims: kept answers are used, others are asked for and then kept."""
    return answers(requests(evidence, provider.identity), provider, folder)


def answers(asked: DataFrame, provider: Extractor, folder: str | None = None) -> DataFrame:
    """(batch_id, key, response) of requests (batch_id, request, key). With a folder, kept answers are used, and others
    are asked for and then kept, once."""
    if folder is None:
        return answer(asked, provider)
    spark = asked.sparkSession
    cache = load_cache(spark, folder).select("key", "response")
    save_cache(answer(asked.join(cache, "key", "left_anti"), provider), folder, provider.identity)
    return asked.join(load_cache(spark, folder).select("key", "response"), "key").select("batch_id", "key", "response")


def profile_executor(provider: Extractor, folder: str | None = None, strategy: str = "linear") -> Callable[..., DataFrame]:
    """Evidence (and dossiers) to extracted profiles, as ``validate_profiles`` takes them."""
    return lambda units, dossiers=None: entities_of(answers(profile_requests(units, provider.identity, strategy, dossiers), provider, folder), "profiles")


def relation_executor(provider: Extractor, folder: str | None = None, strategy: str = "linear") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Candidate edges and evidence to extracted relations, as ``validate_relations`` takes them."""
    return lambda edges, units: entities_of(answers(relation_requests(edges, units, provider.identity, strategy), provider, folder), "relations")


def extractor(provider: Extractor, folder: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function for ``compile_build(..., extract=)``; with a folder its answers are kept there."""

    def run(evidence: DataFrame) -> DataFrame:
        return claims_of(answered(evidence, provider, folder))

    run.__name__ = provider.identity
    return run


def cache_report(cache: DataFrame) -> DataFrame:
    """By format version: entries and bytes."""
    return cache.groupBy("version").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("response")).alias("bytes"))
