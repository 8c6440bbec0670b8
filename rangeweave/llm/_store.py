"""Shared storage: where to put files that every executor can read, and how to write them whole."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only where it is unset (as in tests) a local folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not root:
        root = Path(tempfile.mkdtemp(prefix="rangeweave-")).as_uri()
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else Path(root).absolute().as_uri()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: later reads need none of its lineage.

    The table goes with the session, if ``drop_tables`` has not taken it before.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, which otherwise stay until some later collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


BATCH_ROWS = 1000  # texts that go to a Python worker at once
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Spark send at most ``BATCH_ROWS`` rows at once: it holds a batch outside its heap, and the worker holds it too."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class WholeFile:
    """Written under a name of its own and moved into place when complete, so that a retried task repeats nothing."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.tmp), 0

    def write(self, data: bytes) -> int:
        """Returns the offset at which ``data`` begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def open_file(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)
