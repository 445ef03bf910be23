"""Tables that cut lineage, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``; a temporary one is made
only where that setting is absent and Spark runs in one process, as in tests.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of numbers that a broadcast side may have at most, and its bytes where it holds texts; beyond it joins are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 1 << 26

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder, and a cluster's machines share no temporary one")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="leafmill-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = f"file://{_own[0]}"
    return root.rstrip("/")


def local_path(uri: str) -> str | None:
    """The mounted path of a file URI; None where the shared folder is no file system."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_file(uri: str, blob: bytes) -> None:
    write_parts(uri, [np.frombuffer(blob, np.uint64)])


def write_parts(uri: str, parts: Iterable[np.ndarray]) -> None:
    """A file of the shared folder from parts, of which one at a time is held; a second attempt replaces the first."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own := f"{path}.{os.getpid()}", "wb") as to:
            for part in parts:
                to.write(part.tobytes())
        os.replace(own, path)
    else:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        with fs.open_output_stream(path) as to:
            for part in parts:
                to.write(part.tobytes())


def read_file(uri: str) -> np.ndarray:
    """uint64 words of a file of the shared folder, memory-mapped where it is mounted."""
    if path := local_path(uri):
        return np.memmap(path, dtype=np.uint64, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint64)
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint64)


class Scratch:
    """Tables of one operator run; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/leafmill/{what}-{uuid.uuid4().hex}"
        self._made = 0
        atexit.register(self.drop)

    def path(self, what: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made}-{what}"

    def save(self, df: DataFrame, what: str = "table", tidy: bool = False) -> DataFrame:
        """The table, written and read again; tidy: its shuffle files go at once, not when the driver collects its garbage."""
        at = self.path(what)
        # Python tasks hold a few batches each; small ones keep their memory low whatever the texts' length.
        own = {_BATCH: "8m"} | ({_TIDY: "true"} if tidy else {})
        default = {k: self.spark.conf.get(k, None) for k in own}
        for k, v in own.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            for k, v in default.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        found = self.spark.read.schema(df.schema).parquet(at)
        found._scratch_path = at
        return found

    def drop(self, *tables: DataFrame) -> None:
        for at in [t._scratch_path for t in tables] or [self.root]:
            if path := local_path(at):
                shutil.rmtree(path, ignore_errors=True)
            else:
                try:
                    jvm = self.spark._jvm
                    where = jvm.org.apache.hadoop.fs.Path(at)
                    where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                except Exception:  # noqa: BLE001 - at exit the session may be gone; the folder is temporary
                    pass


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and no others, so that extra columns can't clash with ours."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def restrict(rows: DataFrame, keys: DataFrame, n_keys: int, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``keys`` (of n_keys rows): broadcast while that is small, else shuffled."""
    return rows.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys.hint("shuffle_hash"), on, "left_semi")


def broadcast(keys: DataFrame) -> DataFrame:
    """A side whose rows were counted and found to be at most BROADCAST_ROWS."""
    return F.broadcast(keys)
