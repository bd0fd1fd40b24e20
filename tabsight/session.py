"""Where intermediate tables go, and how they are saved."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_local_scratch: list[str] = []
# All intermediate tables of one driver process lie in one folder.
_RUN = uuid.uuid4().hex


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without the setting; on a cluster a machine-local
    folder would be lost with its executor, so an unset value is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="tabsight-"))
    return _local_scratch[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/tabsight-{_RUN}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove the intermediate tables of this run, once its results are written: they
    may still be read from them until then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/tabsight-{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the files.

    Later plans read the saved rows with column pruning, so they neither repeat the
    work nor depend on executors that may be lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a task that computes much for each of its rows: at least, and about at most.
SPREAD_LEAST, SPREAD_ROWS = 2_048, 1_048_576


def spread(df: DataFrame, rows: int, key: str | None = None, least: int = SPREAD_LEAST) -> DataFrame:
    """``df``, of about so many rows, dealt to tasks for all cores, by ``key`` if it has one.

    A table of few bytes is read by few tasks, one for each row group of its files, which
    is no way to read one whose rows cost much more to work on than to read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * -(-rows // (cores * SPREAD_ROWS)) if rows > cores * least else max(1, rows // least)
    return df.repartition(tasks, key) if key else df.repartition(tasks)


def ship_functions_of(module: str) -> None:
    """Send this module's Python functions with the tasks that use them, so executors
    need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
