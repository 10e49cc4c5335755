"""Incremental scan: new files of a folder as a stream, merged into a catalog of first paths by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import parse as PA
from ..sources import scan as SC


def source_stream(spark: SparkSession, root: str) -> DataFrame:
    """Whole files as they appear: (path, content, size_bytes, modified_at)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    base = "^.*?" + root.rstrip("/").lstrip("/").replace(".", r"\.") + "/"
    return files.select(X.normalize_path(F.regexp_replace("path", base, "")).alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def scan_stream(spark: SparkSession, root: str, output: str, checkpoint: str) -> None:
    """Process what is new and stop. Each micro-batch writes its source rows and units under its own number, so that a
    batch that runs again after a failure replaces what it wrote before."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = SC.inspect_content(batch).persist()
        rows.drop("text").write.mode("overwrite").parquet(f"{output}/sources/batch={number}")
        docs = rows.filter("state = 'parsed'")
        units = PA.parse_markdown(docs.filter(F.col("format").isin("md", "markdown"))).unionByName(PA.parse_text(docs.filter("format = 'txt'")))
        units.write.mode("overwrite").parquet(f"{output}/units/batch={number}")
        rows.unpersist()

    source_stream(spark, root).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_sources(spark: SparkSession, output: str) -> DataFrame:
    """The catalog after all batches: the latest row of each path, duplicates marked."""
    rows = spark.read.parquet(f"{output}/sources")
    latest = rows.groupBy("path").agg(F.max_by(F.struct("source_id", "content_hash", "size_bytes", "format", "state"), F.struct("modified_at", "batch")).alias("r")).select("path", "r.*")
    return SC.mark_duplicates(latest)


def content_counts(stream: DataFrame) -> DataFrame:
    """Running number of files per format within windows of modification time, late files included for a day."""
    rows = stream.select(X.file_format(F.col("path")).alias("format"), "modified_at").withWatermark("modified_at", "1 day")
    return rows.groupBy(F.window("modified_at", "1 hour"), "format").agg(F.count(F.lit(1)).alias("files"))
