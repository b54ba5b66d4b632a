"""Tables between the passes of one query, where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import evimine

#: Bytes of a row group for narrow tables that several passes compute on.
FINE = 4 << 20
_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let the workers import this package wherever they start, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(evimine.__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="evimine-code-")) / "evimine_operators.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


def folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, gone when the driver ends.

    Without that setting a temporary folder serves if driver and executors are one process; on a cluster it is an error, as each host would write
    to its own disk.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    key = f"{context.applicationId} {base}"
    if key not in _FOLDERS:
        if not base:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="evimine-")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/evimine-scratch-{context.applicationId}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[key] = path.toString()
    return _FOLDERS[key]


def stored(df: DataFrame, block: int | None = None) -> DataFrame:
    """df written once and read back: later passes neither repeat nor depend on what came before.

    block: bytes of a row group, which is the least that one task reads; a narrow table of many rows is else read by few.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", block) if block else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    own = folder(spark).partition(":")[2] or folder(spark)
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in parent:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def kept(df: DataFrame, block: int | None = None):
    """A stored copy that goes at the end of the block, for results that are read within it."""
    table = stored(df, block)
    try:
        yield table
    finally:
        drop(table)
