"""Evidence preparation: front-matter metadata, authority hints, duplicates' names, batches, checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def propagate_metadata(units: DataFrame) -> DataFrame:
    """Every unit with lifecycle, authority, valid_from and valid_to of its source's last metadata unit."""
    fm = lambda k: X.front_matter_value(F.col("text"), k)
    meta = units.filter("kind = 'metadata'").select("source_id", "line_start", fm("status").alias("lifecycle"), fm("authority").alias("authority"), F.coalesce(fm("valid_from"), fm("effective_from")).alias("valid_from"), F.coalesce(fm("valid_to"), fm("effective_to")).alias("valid_to"))
    last = meta.groupBy("source_id").agg(F.max_by(F.struct("lifecycle", "authority", "valid_from", "valid_to"), "line_start").alias("m"))
    return units.join(last, "source_id", "left").select(*units.columns, "m.lifecycle", "m.authority", "m.valid_from", "m.valid_to")


def authority_hints(sources: DataFrame, hints: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """(…, authority, lifecycle) by ordered globs on the path, the last match that says something winning; then by path
    defaults: below archive/ the lifecycle is retired."""
    path = F.col("path")
    pick = lambda k: [F.when(path.rlike(X.glob_regex(h[0])), F.lit(h[k])) for h in reversed(hints) if h[k] is not None]
    authority, lifecycle = pick(1), pick(2)
    retired = F.when(path.rlike("(^|/)archive/"), F.lit("retired"))
    return sources.withColumn("authority", F.coalesce(*authority, F.lit(None).cast("string"))).withColumn("lifecycle", F.coalesce(*lifecycle, retired))


def sliding_batches(units: DataFrame, size: int = 12) -> DataFrame:
    """(source_id, batch, evidence_id, ordinal): a whole source if it fits, else windows of ``size`` units that overlap
    by min(2, size - 1). Windows start at k * (size - overlap), so each unit finds its batches by arithmetic."""
    step = size - min(2, size - 1)
    w = Window.partitionBy("source_id")
    rows = units.withColumn("ordinal", F.row_number().over(w.orderBy("line_start")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / step).cast("int"))
    low = F.greatest(F.lit(0), F.ceil((F.col("ordinal") - size + 1) / step).cast("int"))
    high = F.least(last, F.floor(F.col("ordinal") / step).cast("int"))
    return rows.withColumn("batch", F.explode(F.sequence(low, high))).select("source_id", "batch", "evidence_id", "ordinal")


def checklist_gaps(units: DataFrame) -> DataFrame:
    """(source_id, heading, line): checklist lines without an owner, under headings where any line names one."""
    rows = units.select("source_id", "evidence_id", F.try_element_at(F.col("heading_path"), F.lit(-1)).alias("heading"), F.explode(X.lines(F.col("text"))).alias("line"))
    rows = rows.filter(F.col("line").rlike(r"^\s*[-*+] \[[ xX]\]")).withColumn("owned", F.col("line").rlike("担当[:：]"))
    any_owner = F.max(F.col("owned")).over(Window.partitionBy("source_id", "heading"))
    return rows.withColumn("any", any_owner).filter("any AND NOT owned").select("source_id", "evidence_id", "heading", X.trim(F.col("line")).alias("line"))


#: Terms that speak for a unit as evidence of its document's profile.
SIGNALS = ("amend", "conflict", "derived", "exception", "precedence", "supersed", "system of record", "uncontrolled", "例外", "修正", "優先", "決定", "準拠", "反映していない", "参照", "実施", "承認", "改訂", "旧版", "更新", "正式", "現行", "由来", "矛盾", "終了", "置き換", "記録", "適用", "食い違")


def profile_score(text, heading_path):
    """1000 for front matter, 20 per signal term in heading path or text, 2 under a heading; 5 less for headings and for
    what only says what a section is about, never below 0."""
    lower = F.lower(F.concat_ws(" ", F.array_join(heading_path, " "), text))
    hits = sum((F.contains(lower, F.lit(t)).cast("int") for t in SIGNALS), F.lit(0))
    trimmed = X.trim(text)
    score = F.when(trimmed.startswith("---"), 1000).otherwise(0) + hits * 20 + F.when(F.size(heading_path) > 0, 2).otherwise(0)
    return F.greatest(F.lit(0), score - F.when(trimmed.startswith("#") | F.contains(text, F.lit("この節では")), 5).otherwise(0))


def top_evidence(units: DataFrame, score, k: int, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """The k best units of each group by score, ties to the earlier; rank is kept. The limit goes below the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "line_start")
    return units.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
