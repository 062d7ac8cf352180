"""What every operator needs from the session: shipped code, a shared folder, lineage cuts.

Paths and code shipping go through the JVM's gateway, so a classic session is needed, not Spark Connect.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Python functions are pickled by reference, so workers must be able to import the modules they come from,
    wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_marlpit_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="marlpit-code-")
    archive = os.path.join(folder, "marlpit_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(archive)
    sc._marlpit_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local folder serves a local master, as in tests; on a cluster executors would not see it, so
    there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "marlpit-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/marlpit/{name}-{uuid.uuid4().hex}"
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def uncut(*dfs: DataFrame) -> None:
    """Delete what ``cut`` wrote for these tables, which nothing may read any more."""
    for df in dfs:
        system, where = _file_system(df.sparkSession, df._cut_at)
        system.delete(where, True)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths, stripped, that are there, in the order given."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p.strip())
        if where.getFileSystem(conf).exists(where):
            found.append(p.strip())
    return found
