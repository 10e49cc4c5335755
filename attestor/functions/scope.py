"""The four scope predicates, over structs of nine string arrays. Null arrays count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DIMENSIONS


def dim(scope: Column, name: str) -> Column:
    return F.coalesce(scope[name], F.array().cast("array<string>"))


def scope_of(**dims: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(dims.get(d, empty), empty).alias(d) for d in DIMENSIONS])


def scope_match(required: Column, actual: Column) -> Column:
    """match, missing or mismatch. A required dimension that the other lacks is missing, one without a common value
    (case counts) a mismatch; mismatch beats missing."""
    mismatch, missing = F.lit(False), F.lit(False)
    for d in DIMENSIONS:
        r, a = dim(required, d), dim(actual, d)
        missing |= (F.size(r) > 0) & (F.size(a) == 0)
        mismatch |= (F.size(r) > 0) & (F.size(a) > 0) & ~F.arrays_overlap(r, a)
    return F.when(mismatch, "mismatch").when(missing, "missing").otherwise("match")


def scope_missing(required: Column, actual: Column) -> Column:
    names = F.array(*[F.when((F.size(dim(required, d)) > 0) & (F.size(dim(actual, d)) == 0), F.lit(d)) for d in DIMENSIONS])
    return F.array_compact(names)


def _lower(a: Column) -> Column:
    return F.transform(a, F.lower)


def compatible_for_override(applicability: Column, actual: Column) -> Column:
    """True for an empty scope; else dimensions present on both must share a value (case ignored), one at least."""
    empty, shared, clash = F.lit(True), F.lit(False), F.lit(False)
    for d in DIMENSIONS:
        a, b = dim(applicability, d), dim(actual, d)
        both = (F.size(a) > 0) & (F.size(b) > 0)
        meet = F.arrays_overlap(_lower(a), _lower(b))
        empty &= F.size(a) == 0
        shared |= both & meet
        clash |= both & ~meet
    return empty | (shared & ~clash)


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(_lower(a), _lower(b))) == 0


def scopes_equivalent(left: Column, right: Column) -> Column:
    out = F.lit(True)
    for d in DIMENSIONS:
        a, b = dim(left, d), dim(right, d)
        out &= (F.size(a) == F.size(b)) & _subset(a, b)
    return out


def strict_refinement(narrow: Column, broad: Column) -> Column:
    """The narrow scope lies in the broad one on each dimension that the broad one constrains, and is smaller once."""
    inside, smaller = F.lit(True), F.lit(False)
    for d in DIMENSIONS:
        n, b = dim(narrow, d), dim(broad, d)
        inside &= (F.size(b) == 0) | ((F.size(n) > 0) & _subset(n, b))
        smaller |= ((F.size(b) == 0) & (F.size(n) > 0)) | ((F.size(b) > 0) & (F.size(n) > 0) & (F.size(n) < F.size(b)))
    return inside & smaller


def clause_requested(requested: Column, kind: Column, source_clauses: Column, target_clauses: Column) -> Column:
    """Only amends and order_of_precedence are held to the requested clauses; none requested: true."""
    empty = F.array().cast("array<string>")
    r = F.coalesce(requested, empty)
    clauses = F.concat(F.coalesce(source_clauses, empty), F.coalesce(target_clauses, empty))
    return (F.size(r) == 0) | ~kind.isin("amends", "order_of_precedence") | F.arrays_overlap(r, clauses)


def clauses_overlap(a: Column, b: Column) -> Column:
    clean = lambda c: F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.coalesce(F.arrays_overlap(clean(a), clean(b)), F.lit(False))


def expresses_precedence(kind: Column, position: Column, clauses: Column) -> Column:
    """order_of_precedence, or a conditional edge with a clause that speaks of precedence or priority."""
    says = F.exists(clauses, lambda c: F.lower(c).rlike("優先|precedence|priority"))
    return (kind == "order_of_precedence") | ((position == "conditional") & F.coalesce(says, F.lit(False)))


def exploded(df, owner: str, scope: str = "scope"):
    """(owner, dim, value) rows of a scope column, for joins."""
    def of(d: str) -> Column:
        return F.transform(dim(F.col(scope), d), lambda v: F.struct(F.lit(d).alias("dim"), v.alias("value")))

    pairs = F.concat(*[of(d) for d in DIMENSIONS])
    return df.select(owner, F.explode(pairs).alias("p")).select(owner, "p.dim", "p.value")
