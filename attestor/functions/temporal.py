"""The three date-validity predicates, over dates kept as text. Intervals are closed; null bounds are open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """A date written YYYY-MM-DD, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def _inside(frm: Column, to: Column, at: Column) -> Column:
    return F.coalesce(parse_date(frm) <= at, F.lit(True)) & F.coalesce(parse_date(to) >= at, F.lit(True))


def effective(frm: Column, to: Column, as_of: Column) -> Column:
    """At query time: without a readable as_of only unbounded validity holds; unreadable bounds are ignored."""
    at = parse_date(as_of)
    return F.when(at.isNull(), frm.isNull() & to.isNull()).otherwise(_inside(frm, to, at))


def relation_active(frm: Column, to: Column, as_of: Column) -> Column:
    """At build time: without as_of only unbounded relations hold; an unreadable bound makes a relation inactive."""
    at = parse_date(as_of)
    bad = (frm.isNotNull() & parse_date(frm).isNull()) | (to.isNotNull() & parse_date(to).isNull())
    return F.when(as_of.isNull(), frm.isNull() & to.isNull()).when(bad | at.isNull(), F.lit(False)).otherwise(_inside(frm, to, at))


def claim_active(frm: Column, to: Column, as_of: Column) -> Column:
    """Unreadable bounds are ignored; as_of is always there."""
    return _inside(frm, to, parse_date(as_of))


def validity_disjoint(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    return F.coalesce(parse_date(to_a) < parse_date(from_b), F.lit(False)) | F.coalesce(parse_date(to_b) < parse_date(from_a), F.lit(False))
