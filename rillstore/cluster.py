"""What a job needs from the cluster it runs on: code on the executors, a shared folder, cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_rillstore_shipped", None) == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rillstore-"), "rillstore_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("rillstore", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._rillstore_shipped = sc.applicationId


_MADE: list[str] = []


@atexit.register
def _drop_made() -> None:
    """Delete what :func:`shared_dir` gave out, if the application still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # the application is ending: what is left is the folder's owner's to clean
            return


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir`` and is deleted when the driver's Python ends. Only where that
    setting is unset on one machine (tests) a temporary folder is made and set as the checkpoint folder; on a
    cluster the setting is needed.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rillstore-shared-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/rillstore-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
