"""Explicit schemas of the persisted entities and their string domains."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"
DIMENSIONS = ("jurisdictions", "entities", "sites", "products", "assets", "persons", "projects", "lots", "contracts")
ROLES = ("normative", "instruction", "record", "analysis", "proposal", "communication", "reference")
FORCE_LEVELS = ("mandatory", "recommended", "informational")
RELATION_KINDS = (
    "operational_position", "supersedes", "amends", "proposes_change_to", "applies_to", "exception_to", "conflicts_with",
    "evaluates", "approves", "implements_decision", "records_execution_of", "order_of_precedence", "derived_from",
)
POSITIONS = ("dominates", "conditional", "non_effective", "unresolved")
PACKET_ROLES = ("governing", "excluded", "contender", "verifier")
DISPOSITIONS = ("canonical", "instance_exception", "execution_record", "historical", "reference", "excluded", "unresolved")
SOURCE_STATES = ("parsed", "duplicate", "unsupported", "error", "removed")
EVIDENCE_KINDS = ("metadata", "heading", "paragraph", "list", "text")

_s, _l, _b = T.StringType(), T.LongType(), T.BooleanType()
_list = T.ArrayType(_s)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCOPE = _struct(**dict.fromkeys(DIMENSIONS, _list))
EVIDENCE_REF = _struct(source_id=_s, evidence_id=_s)
SOURCE = _struct(source_id=_s, path=_s, content_hash=_s, size_bytes=_l, modified_at=T.TimestampType(), format=_s, state=_s, duplicate_of=_s, warnings=_list)
EVIDENCE = _struct(source_id=_s, evidence_id=_s, ordinal=_l, kind=_s, text=_s, line_start=_l, line_end=_l, heading_path=_list, content_hash=_s, confidence=T.FloatType())
CLAIM = _struct(id=_s, subject=_s, predicate=_s, object=_s, condition=_s, valid_from=_s, valid_to=_s, authority=_s, status=_s, confidence=T.FloatType(), evidence=T.ArrayType(EVIDENCE_REF))
PROFILE = _struct(source_id=_s, document_id=_s, revision=_s, role=_s, level=_s, authority_rank=T.IntegerType(), approved=_b, scope=SCOPE, valid_from=_s, valid_to=_s, observed_at=_s, official_record=_b)
RELATION = _struct(id=_s, position=_s, kind=_s, source_id=_s, target_id=_s, source_clauses=_list, target_clauses=_list, scope=SCOPE, valid_from=_s, valid_to=_s)
CANDIDATE = _struct(case_id=_s, ordinal=_l, source_id=_s, relevance=T.DoubleType())
CONTEXT = _struct(case_id=_s, intent_id=_s, as_of=_s, requested_roles=_list, requested_clauses=_list, scope=SCOPE)
PACKET = _struct(id=_s, intent_id=_s, relation_ids=_list, materials=T.ArrayType(_struct(source_id=_s, role=_s, evidence_ids=_list)))
