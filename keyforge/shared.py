"""What all executors of a cluster share: the scratch folder, and this package on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are on one machine: one process, or those of a local cluster."""
    return spark.sparkContext.master.split("[")[0] in ("local", "local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the session names none, a local master or local cluster gets a temporary folder; on a cluster of several machines
    that is an error, as a folder of one machine isn't shared. Checkpoints are deleted once nothing
    refers to them, and those that are left when the application ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = named or sc.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="keyforge-")
        _delete_on_exit(spark, f"file://{found}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
        _delete_on_exit(spark, sc.getCheckpointDir())
    conf = sc._jsc.sc().conf()
    if not conf.contains(_CLEAN):
        conf.set(_CLEAN, "true")
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    _delete_on_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by its path on this machine, or as a file that is sent to the others."""
    sc = spark.sparkContext
    if getattr(sc, "_keyforge_shipped", False):
        return
    root = str(_PACKAGE.parent)
    have = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    if not sc.master.startswith("local"):
        with tempfile.TemporaryDirectory() as folder:  # Spark copies the file before this returns
            path = Path(folder, f"{_PACKAGE.name}-{uuid.uuid4().hex}.zip")
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(_PACKAGE.rglob("*.py")):
                    z.write(p, p.relative_to(_PACKAGE.parent))
            sc.addPyFile(str(path))
    sc._keyforge_shipped = True
