"""Session set-up for local runs, and the shared folder used on any cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(app_name: str = "querygrove", cores: int | str = "*",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench.  A cluster passes its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary
    folder: there the driver and the executors are one process on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="querygrove-")
    return _LOCAL_FOLDERS[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for a table written by one job."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_and_read(df, name: str):
    """Write ``df`` once to the shared folder and return it as a scan.

    Cuts the lineage with a table that outlives any executor.  Runs one job.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
