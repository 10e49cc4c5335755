"""Markdown and plain text to evidence units, with windows over lines and no state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def number_lines(docs: DataFrame) -> DataFrame:
    """(source_id, path, line_no from 1, line)."""
    return docs.select("source_id", "path", F.posexplode(X.lines(F.col("text"))).alias("p", "line")).select("source_id", "path", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def evidence_lines(docs: DataFrame) -> DataFrame:
    """Every non-blank line as a unit of its own, for texts without blank lines."""
    rows = number_lines(docs).filter(X.trim(F.col("line")) != "")
    return rows.select("source_id", X.evidence_id(F.col("source_id"), F.col("line_no"), F.col("line_no"), F.col("line")).alias("evidence_id"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("line").alias("text"))


def parse_text(docs: DataFrame) -> DataFrame:
    """Blocks between blank lines as ``text`` units (gap and island by a running count of block starts)."""
    w = Window.partitionBy("source_id").orderBy("line_no")
    rows = number_lines(docs).withColumn("blank", X.trim(F.col("line")) == "")
    starts = ~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))
    blocks = rows.withColumn("block", F.sum(starts.cast("int")).over(w)).filter("NOT blank")
    return _units(blocks.withColumn("kind", F.lit("text")).withColumn("heading_path", F.array().cast("array<string>")))


def parse_markdown(docs: DataFrame) -> DataFrame:
    """Front matter, headings with their path, lists and paragraphs.

    The heading path at a line holds, for each level, the last heading of that level that no later heading of a lower
    level ended; levels without one are left out."""
    w = Window.partitionBy("source_id").orderBy("line_no")
    everything = Window.partitionBy("source_id")
    rows = number_lines(docs).withColumn("fence", X.trim(F.col("line")) == "---")
    rows = rows.withColumn("opens", F.max(F.when((F.col("line_no") == 1) & F.col("fence"), 1)).over(everything))
    rows = rows.withColumn("front_end", F.min(F.when(F.col("fence") & (F.col("line_no") > 1), F.col("line_no"))).over(everything))
    in_front = F.coalesce((F.col("opens") == 1) & (F.col("line_no") <= F.col("front_end")), F.lit(False))
    rows = rows.withColumn("front", in_front)
    level = F.when(~F.col("front"), X.heading_level(F.col("line")))
    rows = rows.withColumn("level", level).withColumn("blank", ~F.col("front") & (X.trim(F.col("line")) == ""))
    lower = {k: F.max(F.when(F.col("level") < k, F.col("line_no"))).over(w) for k in range(1, 7)}
    path = []
    for k in range(1, 7):
        at = F.max(F.when(F.col("level") == k, F.col("line_no"))).over(w)
        text = F.last(F.when(F.col("level") == k, X.heading_text(F.col("line"))), ignorenulls=True).over(w)
        path.append(F.when(at > F.coalesce(lower[k], F.lit(0)), text))
    rows = rows.withColumn("heading_path", F.array_compact(F.array(*path)))
    before = F.lag(F.struct("blank", "front", F.col("level").isNotNull().alias("head"))).over(w)
    starts = ~F.col("blank") & (before.isNull() | before["blank"] | before["head"] | F.col("level").isNotNull() | (before["front"] != F.col("front")))
    blocks = rows.withColumn("block", F.sum(starts.cast("int")).over(w)).filter("NOT blank")
    first = F.first("line").over(Window.partitionBy("source_id", "block").orderBy("line_no"))
    kind = F.when(F.col("front"), "metadata").when(F.col("level").isNotNull(), "heading").when(X.is_list(first), "list").otherwise("paragraph")
    return _units(blocks.withColumn("kind", kind))


def _units(lines: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    units = lines.groupBy("source_id", "block").agg(F.first("kind").alias("kind"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.array_join(ordered, "\n").alias("text"), F.first("heading_path").alias("heading_path"))
    return units.select("source_id", X.evidence_id(F.col("source_id"), F.col("line_start"), F.col("line_end"), F.col("text")).alias("evidence_id"), "kind", "line_start", "line_end", "text", "heading_path")


def titles(units: DataFrame) -> DataFrame:
    """(source_id, title): the first heading of level 1."""
    heads = units.filter((F.col("kind") == "heading") & (X.heading_level(F.col("text")) == 1))
    return heads.groupBy("source_id").agg(F.min(F.struct("line_start", X.heading_text(F.col("text")).alias("title"))).alias("t")).select("source_id", "t.title")


def render_markdown(units: DataFrame) -> DataFrame:
    """(source_id, markdown): a readable listing of a source's units in order."""
    row = F.struct("line_start", F.concat(F.lit("## "), "kind", F.lit(" ["), F.col("line_start"), F.lit("-"), F.col("line_end"), F.lit("]\n\n"), "text", F.lit("\n")).alias("s"))
    return units.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), "\n").alias("markdown"))
