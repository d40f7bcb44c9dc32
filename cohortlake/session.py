"""Session settings for local runs; a cluster's own settings are left alone. Tables staged in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder.
LOCAL_FOLDER = "/tmp/checkpoints/cohortlake"
#: Folders staged by this process that still stand.
STAGED: list[str] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cohortlake")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir, noted for removal. A cluster must name that folder; a local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    STAGED.append(path := f"{(root or LOCAL_FOLDER).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read back: evaluated once, with a lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None, before: int = 0) -> None:
    """Delete the folders staged after the first `before` ones; what reads them is of no use then. Without a live session only local
    folders can be removed, which is what a stopped local session leaves."""
    live = spark is not None and spark.sparkContext._jsc is not None
    for path in STAGED[before:]:
        if live:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        elif "://" not in path.removeprefix("file://"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    del STAGED[before:]


@atexit.register
def _release_at_exit() -> None:
    try:
        release(SparkSession.getActiveSession())
    except Exception:  # the JVM may be gone
        release()
