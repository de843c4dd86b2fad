"""Running on a cluster: shipping code, the shared folder, materialized tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lotusflow-code-")) / "lotusflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def arrow_map(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` whose function may use this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, where the input has fewer partitions than cores.

    For operators that spend far more on a row than it costs to move it. What is moved
    is bounded: an input of more than a file split for each core has enough partitions
    and is left as it is. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing and Spark runs on one machine (tests) a
    temporary folder is used; a cluster without the setting gets a folder in the
    warehouse, never a machine-local one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        made = tempfile.mkdtemp(prefix="lotusflow-shared-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    return spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/lotusflow-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


_made: dict[str, list[str]] = {}


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context.applicationId not in _made:
        _made[context.applicationId] = []
        atexit.register(remove_folders, spark)
    _made[context.applicationId].append(path)


def remove_folders(spark: SparkSession) -> None:
    """Remove the folders of ``materialize`` and ``shared_folder``; DataFrames read from them are lost."""
    try:
        context = spark.sparkContext
        for path in _made.pop(context.applicationId, []):
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: S110 - the application may have ended before
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Cuts the lineage without depending on any single executor: a lost executor
    costs a re-read of the files, not a recomputation. The files are removed when the
    application ends, or by ``remove_folders``.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
