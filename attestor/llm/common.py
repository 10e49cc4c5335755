"""What the operators of this subpackage share: the checkpoint folder, table access and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names, which outlives any executor."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding each value to a Python string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows, so that what becomes Python objects at once stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, or the checkpoint folder already set. Only where
    Spark runs on this machine alone (tests) and neither is set, a temporary folder; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="attestor-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_table(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: compressed, and read by column."""
    path = f"{shared_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """Documents as (key long, doc_id, text): key orders as doc_id does and is unique to a document.

    Usually key is doc_id. Only if an id is null or repeated (a check that reads the id column alone) are the
    distinct (doc_id, text) rows numbered in order of doc_id (null last) and of the text's digest; equal rows then
    count as one document. The flag says which of the two was done.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    odd = base.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").limit(1).count() > 0
    if not odd:
        return base.select(F.col("doc_id").alias("key"), "doc_id", "text"), False
    ids = base.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).distinct()
    ranged = shared(ids.withColumn("first", F.coalesce("doc_id", F.lit(2**63 - 1))).repartitionByRange("first", "digest").sortWithinPartitions("first", "digest").select("doc_id", "digest", F.monotonically_increasing_id().alias("key")))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    left = base.withColumn("digest", sha).dropDuplicates(["doc_id", "digest"])
    right = ranged.withColumnRenamed("doc_id", "id2").withColumnRenamed("digest", "digest2")
    joined = left.join(right, left["doc_id"].eqNullSafe(right["id2"]) & (left["digest"] == right["digest2"]))
    return joined.select("key", "doc_id", "text"), True


def unsigned(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:  # pointer jumping
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (before == label).all():
            break
    return label
