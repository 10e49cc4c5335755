"""Workspace on a file system: control folder, configuration, exclusive lock, published builds, JSON Lines."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEMA_VERSION


class WorkspaceError(RuntimeError):
    pass


class Workspace:
    """Driver-side state only; tables live beside it as Parquet."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.control = self.root / ".attestor"

    @classmethod
    def init(cls, root: str | Path) -> Workspace:
        """Create what is missing; calling it again changes nothing."""
        ws = cls(root)
        (ws.control / "parsed").mkdir(parents=True, exist_ok=True)
        config = ws.control / "config.json"
        if not config.exists():
            config.write_text(json.dumps({"schema_version": SCHEMA_VERSION}))
        return ws

    @classmethod
    def open(cls, root: str | Path) -> Workspace:
        ws = cls(root)
        if not (ws.control / "config.json").exists():
            raise WorkspaceError(f"no workspace in {root}")
        if ws.config()["schema_version"] != SCHEMA_VERSION:
            raise WorkspaceError("the workspace has another schema version")
        return ws

    def config(self) -> dict:
        return json.loads((self.control / "config.json").read_text())

    def bind_source_root(self, root: str) -> None:
        """The first root is kept; another one later is an error."""
        config = self.config()
        if config.setdefault("source_root", root) != root:
            raise WorkspaceError(f"workspace is bound to {config['source_root']}")
        (self.control / "config.json").write_text(json.dumps(config))

    @contextmanager
    def lock(self, operation: str) -> Iterator[None]:
        """Exclusive among scan, compile and recompile; released at the end, whatever happens."""
        with (self.control / "lock").open("a+") as handle:
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise WorkspaceError(f"{operation}: the workspace is in use") from e
            try:
                yield
            finally:
                fcntl.flock(handle, fcntl.LOCK_UN)

    def read_table(self, spark: SparkSession, name: str) -> DataFrame | None:
        """A table of the control folder, or null. If a swap was cut off, the version that was set aside is it."""
        path = self.control / f"{name}.parquet"
        aside = self.control / f"{name}.parquet.old"
        if not path.exists() and aside.exists():
            os.rename(aside, path)
        return spark.read.parquet(str(path)) if path.exists() else None

    def write_table(self, df: DataFrame, name: str) -> None:
        """Written beside the old table, which is renamed before the new one takes its name: at no moment is there
        neither. The new rows may come from the old file."""
        path, aside = self.control / f"{name}.parquet", self.control / f"{name}.parquet.old"
        fresh = self.control / f"{name}.parquet.{uuid.uuid4().hex}"
        df.write.parquet(str(fresh))
        if path.exists():
            shutil.rmtree(aside, ignore_errors=True)
            os.rename(path, aside)
        os.rename(fresh, path)
        shutil.rmtree(aside, ignore_errors=True)
        df.sparkSession.catalog.refreshByPath(str(path))

    def read_catalog(self, spark: SparkSession) -> DataFrame | None:
        return self.read_table(spark, "catalog")

    def write_catalog(self, catalog: DataFrame) -> None:
        self.write_table(catalog, "catalog")

    def write_manifest(self, manifest: dict) -> None:
        (self.control / "manifest.json").write_text(json.dumps(manifest, indent=2, sort_keys=True, default=str))


def publish(folder: Path, output: Path) -> None:
    """The finished folder becomes ``output`` in one rename."""
    if output.exists():
        raise WorkspaceError(f"{output} exists")
    output.parent.mkdir(parents=True, exist_ok=True)
    os.rename(folder, output)


@contextmanager
def staging(output: str | Path, publish: bool = True) -> Iterator[Path]:
    """A hidden sibling folder that becomes ``output`` in one rename at the end, unless ``publish`` is off and the block
    does so itself; removed if the block fails."""
    output = Path(output)
    if output.exists():
        raise WorkspaceError(f"{output} exists")
    hidden = output.parent / f".{output.name}.{uuid.uuid4().hex}"
    hidden.mkdir(parents=True)
    try:
        yield hidden
        if publish:
            os.rename(hidden, output)
    finally:
        shutil.rmtree(hidden, ignore_errors=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, lines that aren't objects of the schema are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=True)


def content_hash(path: str | Path) -> str:
    """sha256: and the digest of a file, or of a folder's data files in order of their names."""
    digest, path = hashlib.sha256(), Path(path)
    for p in [path] if path.is_file() else sorted(x for x in path.rglob("*") if x.is_file() and not x.name.startswith((".", "_"))):
        with p.open("rb") as handle:
            while block := handle.read(1 << 16):
                digest.update(block)
    return f"sha256:{digest.hexdigest()}"


def table_hash(spark: SparkSession, path: str | Path) -> str:
    """sha256: and the digest over the digests of a table's files; the files are read where their blocks are."""
    files = spark.read.format("binaryFile").load(f"{path}/*.parquet").select(F.sha2("content", 256).alias("h"))
    return f"sha256:{hashlib.sha256(''.join(sorted(r['h'] for r in files.collect())).encode()).hexdigest()}"


def cache_key(prefix: str, identity: str, request: str) -> str:
    return hashlib.sha256(f"{prefix}{identity}\0{request}".encode()).hexdigest()


def cache_lookup(requests: DataFrame, cache: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(hits with their response, misses) of requests (key, ...) against cache (key, version, response)."""
    live = cache.filter(f"version = {int(version)}").select("key", "response")
    return requests.join(live, "key"), requests.join(live, "key", "left_anti")
