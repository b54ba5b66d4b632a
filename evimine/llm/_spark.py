"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import evimine

_SHIPPED: set[str] = set()
_FOLDERS: dict[tuple[str, str | None], str] = {}


def ship(spark: SparkSession) -> None:
    """Let the workers import this package wherever they start, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(evimine.__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="evimine-code-")) / "evimine_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that all executors see; it goes when the driver ends.

    It lies under spark.checkpoint.dir. Without that setting a temporary folder serves if driver and executors are one process; on a cluster it is
    an error, as each host would write to its own disk.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    key = (context.applicationId, base)
    if key not in _FOLDERS:
        alone = context.master == "local" or context.master.startswith("local[")
        if not (base or alone):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        under = base or tempfile.mkdtemp(prefix="evimine-")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{under.rstrip('/')}/evimine-{context.applicationId}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _FOLDERS[key] = folder.toString()
    return _FOLDERS[key]


def forget(spark: SparkSession) -> None:
    """Let the driver notice what is no longer used, frames held in cycles first: only then does Spark drop the shuffle files behind it."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor never replays what came before; what earlier cuts were made of is forgotten first."""
    spark = df.sparkSession
    forget(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_fold(column: str, folds: int):
    """crc32 of the id written as text, modulo folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
