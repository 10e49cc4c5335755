"""Intermediate tables in the folder that the cluster shares: they outlive executors and cut the plans behind them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the checkpoint folder already set; a temporary one of this machine
    only where Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="attestor-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table of the shared folder, with df's schema."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
