"""What the corpus operators share: inputs, the shared work folder, row keys and fold arithmetic."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Work:
    """The folders and tables that were written while it was open; drop() deletes them.

    What is written while none is open belongs to the application and is deleted when the driver's Python ends.
    """

    _open: contextvars.ContextVar[Work | None] = contextvars.ContextVar("work", default=None)
    _application: Work | None = None

    def __init__(self):
        self.folders: list[str] = []
        self.tables: list[str] = []

    def __enter__(self) -> Work:
        self._token = Work._open.set(self)
        return self

    def __exit__(self, *_) -> None:
        Work._open.reset(self._token)

    @classmethod
    def current(cls) -> Work:
        if cls._open.get() is not None:
            return cls._open.get()
        if cls._application is None:
            cls._application = Work()
            atexit.register(cls._application._end)
        return cls._application

    def _end(self) -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            with contextlib.suppress(Exception):  # the session may be gone already
                self.drop(spark)

    def drop(self, spark: SparkSession) -> None:
        for table in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        for folder in self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders, self.tables = [], []


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share: spark.checkpoint.dir, or else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    Work.current().folders.append(path)
    return path


def work_table(name: str) -> str:
    """A fresh table name."""
    table = f"gaugeworks_{name}_{uuid.uuid4().hex}"
    Work.current().tables.append(table)
    return table


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build, name: str) -> DataFrame:
    """build()'s rows as a written table; the working files that it made are deleted."""
    with Work() as own:
        made = build()
    out = materialise(made, name)
    own.drop(made.sparkSession)
    return out


def id_text(column: str = "doc_id") -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(modulus: int, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(id_text(column)), F.lit(modulus))


def row_key() -> Column:
    """64 bits that name a row by doc_id and text; equal rows share it."""
    return F.xxhash64(id_text(), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose row_key is in kept._k, every column unchanged; of repeated rows one stays.

    The semi-join and the window share one exchange on the key.
    """
    others = [f.name for f in docs.schema.fields if f.name not in ("text", "doc_id") and f.dataType.typeName() in ("string", "long", "integer", "double")]
    order = [F.col(f"`{c}`") for c in others] or [F.lit(1)]
    keyed = docs.withColumn("_gw_key", row_key()).join(kept.select(F.col("_k").alias("_gw_key")), "_gw_key", "left_semi")
    first = keyed.withColumn("_gw_nth", F.row_number().over(Window.partitionBy("_gw_key").orderBy(*order)))
    return first.filter("_gw_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def release() -> None:
    """Give back what a task's buffers held: workers live on, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """A function over batches that releases memory when its task ends."""

    @functools.wraps(run)
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return outer


def vocabulary_path(name: str) -> str:
    """A public tokenizer's file; GAUGEWORKS_TOKENIZERS points elsewhere if set."""
    folder = os.environ.get("GAUGEWORKS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
