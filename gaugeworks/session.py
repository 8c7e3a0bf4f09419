"""The Spark session of tests, bench and examples."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share: below spark.checkpoint.dir, or else the warehouse. It goes when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if not _FOLDERS:
        atexit.register(_drop_folders)
    _FOLDERS.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, read back: what is read twice is computed once, and survives lost executors."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _drop_folders() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may be gone already
        for folder in _FOLDERS if spark else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: int | str = 8, app: str = "gaugeworks", partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings every query assumes: UTC and adaptive execution."""
    there = SparkSession.getActiveSession()
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if there is None or not there.conf.get("spark.checkpoint.dir", None):
        builder = builder.config("spark.checkpoint.dir", "/tmp/checkpoints/gaugeworks")  # local: driver and executors are one process
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
