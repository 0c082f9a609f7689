"""Written tables in the folder that driver and executors share.

Lineage is cut by writing Parquet under `spark.checkpoint.dir`, through Spark's own writers, so the
files survive a lost executor and may lie in any store that Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..session import shared_dir

#: Tables written inside each `scratch` that is open.
_OPEN: list[list[DataFrame]] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a task holds little text on either side of the pipe; a session's own settings stay."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", usual) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def new_path(spark: SparkSession, name: str) -> str:
    small_batches(spark)
    return f"{shared_dir(spark)}/veilwork/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once and reads them back: later steps start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.veilwork_path = path
    for made in _OPEN:
        made.append(back)
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.veilwork_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are written inside the block when it ends, but for those given to what it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _OPEN.remove(made)
        discard(*(df for df in made if not any(df is x for x in kept)))


def ordered(kind: DataType) -> bool:
    """Whether Spark can order values of a type."""
    inner = [f.dataType for f in kind] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return not isinstance(kind, (MapType, VariantType)) and all(map(ordered, inner))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
