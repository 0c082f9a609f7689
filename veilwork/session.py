"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
# Rows of a task, and tasks, of a table that is dealt out.
TASK_ROWS, MOST_TASKS = 10_000, 1000


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once a session.

    Workers that inherit a PYTHONPATH naming the repository need nothing; to others a zip of the
    package goes through Spark's own file server.
    """
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get("spark.veilwork.shipped", "") == spark.sparkContext.applicationId:
        return
    at = Path(tempfile.mkdtemp(prefix="veilwork-")) / "veilwork.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((ROOT / "veilwork").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(at))
    spark.conf.set("spark.veilwork.shipped", spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; where it is unset (single-machine tests), one temporary folder a session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once, as Parquet under `shared_dir`, and reads them back: later steps start from the files, whoever is lost."""
    path = f"{shared_dir(df.sparkSession)}/veilwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of few bytes whose rows are much work, dealt by its key over tasks of about `TASK_ROWS` rows.

    Spark sizes tasks by bytes, so 100,000 such rows are one task's, and no row group is shared between tasks. The rows are counted
    from the files' footers.
    """
    rows = table(spark, sf_dir, name)
    tasks = min(MOST_TASKS, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, key) if tasks > 1 else rows
