"""Session helpers: settings for tests and single machines, and tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "mensura", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with UTC, adaptive execution and ANSI mode; on a cluster pass the cluster's own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": os.environ.get("MENSURA_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": "8",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names in spark.checkpoint.dir.

    Only where none is named on one machine (tests) a temporary one is made; on a cluster that is an error, as each executor
    would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="mensura-shared-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named


#: Tables that cut() wrote and that aren't deleted yet.
_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes the tables that cut() wrote; what was read from them can't be read any more. Runs at the interpreter's end as well."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def _clear_at_end(spark: SparkSession) -> None:
    try:
        clear(spark)
    except Exception:  # noqa: BLE001
        pass  # the session has ended before; whoever named the folder empties it


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once as a table in the shared folder and read again.

    It survives the loss of executors, its size is known to the planner, and unlike a checkpoint it is computed once. clear()
    deletes these tables.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/mensura-{uuid.uuid4().hex}"
    if not _written:
        atexit.unregister(_clear_at_end)
        atexit.register(_clear_at_end, spark)
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that cut() returned and that nothing reads any more, and lets go of the shuffle files of what was computed before.

    Such files stay until the driver collects its garbage, which may be long after; None is passed over.
    """
    for df in tables:
        if df is not None and df._written in _written:
            _written.remove(df._written)
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spark = next((df.sparkSession for df in tables if df is not None), None)
    if spark is not None:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
