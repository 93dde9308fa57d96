"""Session settings shared by the jobs."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tollgate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job made for itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def computed_once(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep later filters on the given (default: all) columns above their computation.

    A filter on a computed column is otherwise pushed down by repeating the column's whole
    expression, which for parsing, signing and scoring doubles the work. The columns pass through
    a one-row ``inline``, below which such filters are not pushed; the others stay prunable.
    """
    columns = df.columns if columns is None else columns
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder this package was loaded from on the path of Python workers started from now on.

    That is enough where executors run on this machine; on a cluster the package has to be
    installed or shipped, and the extra entry does nothing.
    """
    root = str(Path(__file__).resolve().parents[1])
    given = spark.sparkContext.environment
    paths = [p for p in given.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        given["PYTHONPATH"] = os.pathsep.join([root, *paths])


def tune(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on; all can be changed in a running session.

    Methods above 8000 bytes of bytecode are never compiled by the JVM. Spark should then use
    its per-operator code, which it splits into small methods.
    """
    let_workers_import(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark
