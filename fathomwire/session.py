"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_fathomwire_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._fathomwire_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors see: ``spark.checkpoint.dir``.

    Where none is set, a session on one machine takes a temporary one; a cluster without one is an error, as its executors
    would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files have fewer splits than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by ``keys``: a file of few row groups has rows for few of its splits, however many there are."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
