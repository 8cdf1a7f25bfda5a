"""Folders and settings of the session that a query runs in."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only on a single machine where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cuelane-shared-"))
    return sc.getCheckpointDir()


def join_in_place(spark: SparkSession) -> None:
    """Lets joins use rows where they lie: sides that are dealt by the recording already are not dealt again by recording
    and bucket, segment or position. Spark's own setting, which deals them again, stays for sides that are not dealt yet."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per session, so that workers can import it wherever the driver started."""
    sc = spark.sparkContext
    if getattr(sc, "_cuelane_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="cuelane-"), "cuelane_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._cuelane_shipped = True
