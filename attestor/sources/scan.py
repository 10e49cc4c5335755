"""Scanning a collection: files to source rows, exact duplicates, changes between scans, and the scan's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

SKIPPED = (".git", ".attestor", "node_modules")
PARSED_FORMATS = ("md", "markdown", "txt")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as (path, content, size_bytes, modified_at), path relative to it. Spark lists no files of zero
    bytes, so these have no row."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "^.*?" + root.rstrip("/").replace("\\", "/").split(":")[-1].lstrip("/").replace(".", r"\.") + "/"
    path = X.normalize_path(F.regexp_replace("path", base, ""))
    return df.select(path.alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def glob_filter(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose path matches any include (all, if none) and no exclude; never below SKIPPED folders."""
    path = F.col("path")
    keep = ~path.rlike("(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")(/|$)")
    if include:
        keep &= path.rlike("|".join(f"(?:{X.glob_regex(p)})" for p in include))
    if exclude:
        keep &= ~path.rlike("|".join(f"(?:{X.glob_regex(p)})" for p in exclude))
    return files.filter(keep)


def inspect(files: DataFrame, text: Column, max_bytes: int | None = None) -> DataFrame:
    """Adds source_id, content_hash, size_bytes, format and state: parsed, unsupported, or error beyond the size limit."""
    size = F.octet_length(text).cast("long")
    fmt = X.file_format(F.col("path"))
    over = size > max_bytes if max_bytes is not None else F.lit(False)
    state = F.when(over, "error").when(fmt.isin(*PARSED_FORMATS), "parsed").otherwise("unsupported")
    return files.withColumns({
        "source_id": X.source_id(F.col("path")), "content_hash": F.sha2(text, 256), "size_bytes": size, "format": fmt, "state": state,
    })


def inspect_content(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files (path, content, size_bytes, modified_at) with what ``inspect`` adds, the text of those to be parsed and
    warnings. The hash is that of the bytes. A file beyond the size limit, and one of a format to be parsed that is no
    UTF-8 or has no text, is in state error and says why."""
    fmt = X.file_format(F.col("path"))
    raw = F.col("content").cast("string")
    wanted = fmt.isin(*PARSED_FORMATS)
    over = F.col("size_bytes") > max_bytes if max_bytes is not None else F.lit(False)
    broken = wanted & ~F.is_valid_utf8(raw)
    empty = wanted & ~broken & (X.trim(F.when(F.is_valid_utf8(raw), raw)) == "")
    why = F.when(over, "beyond the size limit").when(broken, "no UTF-8").when(empty, "empty")
    none = F.array().cast("array<string>")
    return files.select(
        "path", X.source_id(F.col("path")).alias("source_id"), F.sha2("content", 256).alias("content_hash"), "size_bytes", "modified_at", fmt.alias("format"), F.when(why.isNotNull(), "error").when(wanted, "parsed").otherwise("unsupported").alias("state"),
        F.when(why.isNotNull(), F.array(why)).otherwise(none).alias("warnings"), F.when(wanted & why.isNull(), raw).alias("text"),
    )


def mark_duplicates(sources: DataFrame) -> DataFrame:
    """state duplicate and duplicate_of for all but the first path of each content hash, whatever its format.

    The first path comes from an aggregate, not from a window: a hash that very many files share stays spread."""
    first = sources.filter("state <> 'error'").groupBy(F.col("content_hash").alias("h")).agg(F.min("path").alias("first_path"))
    joined = sources.join(first, sources["content_hash"] == first["h"], "left").drop("h")
    dup = (F.col("state") != "error") & (F.col("path") != F.col("first_path"))
    return joined.withColumn("duplicate_of", F.when(dup, F.col("first_path"))).withColumn("state", F.when(dup, "duplicate").otherwise(F.col("state"))).drop("first_path")


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current with change: added, changed or unchanged against the catalog of the previous scan."""
    old = previous.select("path", F.col("content_hash").alias("old_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") != F.col("content_hash"), "changed").otherwise("unchanged")
    return current.join(old, "path", "left").withColumn("change", change).drop("old_hash")


def removed(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("path"), "path", "left_anti").select("path")


def parse_cache(current: DataFrame, previous: DataFrame, parser_key: str) -> DataFrame:
    """cache_hit: the previous scan parsed the same content with the same parser."""
    old = previous.filter("state = 'parsed'").select("path", "content_hash", F.col("parser_key").alias("k"), F.lit(True).alias("hit"))
    joined = current.join(old, ["path", "content_hash"], "left")
    return joined.withColumn("cache_hit", F.coalesce(F.col("hit") & (F.col("k") == parser_key) & (F.col("state") == "parsed"), F.lit(False))).drop("hit", "k")


#: The catalog: a row of each path ever seen.
CATALOG = "path string, source_id string, content_hash string, size_bytes long, modified_at timestamp, format string, state string, duplicate_of string, warnings array<string>, parser_key string, first_seen_scan string, last_seen_scan string, changed_scan string"


def upsert(catalog: DataFrame, seen: DataFrame, scan_id: str) -> DataFrame:
    """The next catalog: rows of this scan replace rows of their path, keeping when it was first seen, and when last
    changed if its content is the same; others are kept and become removed. Columns that either side lacks are null."""
    names = [c.split()[0] for c in CATALOG.split(", ")]
    types = dict(c.split() for c in CATALOG.split(", "))
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names])
    a, b = full(catalog).alias("a"), full(seen).alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    new = F.col("b.path").isNotNull()
    own = {
        "path": F.coalesce("b.path", "a.path"), "state": F.when(new, F.col("b.state")).otherwise("removed"), "first_seen_scan": F.coalesce("a.first_seen_scan", F.lit(scan_id)), "last_seen_scan": F.when(new, F.lit(scan_id)).otherwise(F.col("a.last_seen_scan")),
        "changed_scan": F.when(new & ~F.col("a.content_hash").eqNullSafe(F.col("b.content_hash")), F.lit(scan_id)).otherwise(F.col("a.changed_scan")),
    }
    return joined.select(*[own.get(c, F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c) for c in names])


def summary(scanned: DataFrame, gone: DataFrame) -> DataFrame:
    """One row of counters by state and by change, with the bytes scanned."""
    n = lambda c: F.count_if(c).alias
    s, ch = F.col("state"), F.col("change")
    row = scanned.agg(
        F.count(F.lit(1)).alias("total"), n(s == "parsed")("parsed"), n(s == "duplicate")("duplicates"), n(s == "unsupported")("unsupported"), n(s == "error")("errors"),
        n(ch == "added")("added"), n(ch == "changed")("changed"), n(ch == "unchanged")("unchanged"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_scanned"),
    )
    return row.crossJoin(gone.agg(F.count(F.lit(1)).alias("removed")))  # two tables of one row each


def duplicate_aliases(sources: DataFrame) -> DataFrame:
    """(source_id, aliases): sorted paths of the duplicates of each primary source."""
    dup = sources.filter("state = 'duplicate'").groupBy(F.col("duplicate_of").alias("path")).agg(F.sort_array(F.collect_list("path")).alias("aliases"))
    return sources.filter("state <> 'duplicate'").select("path", "source_id").join(dup, "path").select("source_id", "aliases")
