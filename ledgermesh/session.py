"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_cleared_at_exit: set[str] = set()
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
_writers: dict[str, list] = {}


def get_spark(app: str = "ledgermesh", cpus: int | None = None) -> SparkSession:
    """A session with adaptive execution; ``cpus`` sets a local master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", os.environ.get("LEDGERMESH_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ledgermesh-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's staged tables, inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """While a table is written, shuffle files are deleted when the write that made them ends."""
    run = spark.sparkContext.applicationId
    with _writing:
        before = _writers.setdefault(run, [0, spark.conf.get(_SHUFFLES_END, None)])
        before[0] += 1
        spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        with _writing:
            before[0] -= 1
            if not before[0]:
                del _writers[run]
                spark.conf.unset(_SHUFFLES_END) if before[1] is None else spark.conf.set(_SHUFFLES_END, before[1])


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back without lineage.

    Staged tables live until ``unstage`` or ``clear_stages``, or until the application ends in good
    order. The shuffle files of the write are not needed after it, and go with it.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.parquet(path)
    if spark.sparkContext.applicationId not in _cleared_at_exit:
        _cleared_at_exit.add(spark.sparkContext.applicationId)
        atexit.register(_clear_if_alive, spark)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        _delete(df.sparkSession, df._staged_path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt in turn over all shuffle partitions, before work that costs much more than their bytes tell.

    The count is given, as adaptive execution would merge partitions of few bytes into
    one task again; no key is, so neither a hot key nor nulls meet in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def clear_stages(spark: SparkSession) -> None:
    """Delete the staged tables of this application; results that read them are void afterwards."""
    _delete(spark, run_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_if_alive(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        clear_stages(spark)
