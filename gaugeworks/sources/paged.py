"""Pages of a mirrored dataset: rows by their index, read from the Parquet row groups that hold them.

The index of a row counts through the files by name and the row groups in them, as the footers tell. A page [offset,
offset + limit) so names its row groups before anything is read: each is a task, which opens one file and decodes one
row group, and conditions on row_index that Spark pushes down narrow the page. The number of rows comes from the footers
alone. Footers are read by threads on the driver, one of some kilobytes for each file. All pages together are one scan
with the number of the page beside each row, so plan and tasks follow the row groups, not the pages.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

READERS = 16
#: Rows of an Arrow batch that a task hands to Spark.
BATCH = 10_000


@dataclass
class RowGroup(InputPartition):
    """Rows [skip, skip + take) of one row group, whose first has the index `first`."""

    path: str
    group: int
    first: int
    skip: int
    take: int


def _opened(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The Parquet files of a folder in the order of their names, or the file itself."""
    system, at = _opened(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.File:
        return [path]
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    names = (f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")
    return [scheme + n for n in sorted(names)]


def _footer(path: str) -> pq.FileMetaData:
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        return pq.ParquetFile(f).metadata


def row_groups(path: str) -> list[tuple[str, int, int]]:
    """(file, row group, rows) in order, from the footers."""
    paths = files_of(path)
    with ThreadPoolExecutor(READERS) as pool:
        footers = list(pool.map(_footer, paths))
    return [(p, g, m.row_group(g).num_rows) for p, m in zip(paths, footers) for g in range(m.num_row_groups)]


def total_rows(path: str) -> int:
    return sum(n for _, _, n in row_groups(path))


class IndexedReader(DataSourceReader):
    """Rows [low, high) by their index; conditions on row_index make the range smaller."""

    def __init__(self, offset: int, limit: int | None):
        self.low, self.high = offset, None if limit is None else offset + limit

    def pushFilters(self, filters):
        """Bounds on row_index narrow the page; every other condition is Spark's."""
        for f in filters:
            bounds = {EqualTo: (0, 1), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1)}.get(type(f))
            if bounds is None or f.attribute != ("row_index",):
                yield f
                continue
            if bounds[0] is not None:
                self.low = max(self.low, f.value + bounds[0])
            if bounds[1] is not None:
                self.high = f.value + bounds[1] if self.high is None else min(self.high, f.value + bounds[1])


class PageReader(IndexedReader):
    def __init__(self, path: str, columns: list[str], offset: int, limit: int | None):
        super().__init__(offset, limit)
        self.path, self.columns = path, columns

    def partitions(self):
        out, first = [], 0
        for path, group, n in row_groups(self.path):
            skip, end = max(0, self.low - first), n if self.high is None else min(n, self.high - first)
            if skip < end:
                out.append(RowGroup(path, group, first, skip, end - skip))
            first += n
        return out or [RowGroup("", 0, 0, 0, 0)]

    def read(self, partition):
        if not partition.take:
            return
        system, at = _opened(partition.path)
        with system.open_input_file(at) as f:
            told = pq.ParquetFile(f).read_row_group(partition.group, columns=self.columns).slice(partition.skip, partition.take)
        start = partition.first + partition.skip
        index = pa.array(range(start, start + told.num_rows), pa.int64())
        yield from told.add_column(0, "row_index", index).combine_chunks().to_batches(BATCH)


class Pages(DataSource):
    """Format `gaugeworks_pages`. Options: path (a file or folder), offset, limit, columns (by comma; all if none are named)."""

    @classmethod
    def name(cls) -> str:
        return "gaugeworks_pages"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c]

    def schema(self) -> StructType:
        paths = files_of(self.options["path"])
        if not paths:
            return StructType([StructField("row_index", LongType())])
        system, at = _opened(paths[0])
        with system.open_input_file(at) as f:
            stored = pq.ParquetFile(f).schema_arrow
        fields = from_arrow_schema(stored).fields
        return StructType([StructField("row_index", LongType()), *[f for f in fields if not self._columns() or f.name in self._columns()]])

    def reader(self, schema: StructType) -> PageReader:
        limit = self.options.get("limit")
        return PageReader(self.options["path"], schema.fieldNames()[1:], int(self.options.get("offset", 0)), None if limit is None else int(limit))


def pages(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """row_index and the columns of rows [offset, offset + limit)."""
    if offset < 0 or limit is not None and limit < 1:
        raise ValueError("an offset is at least 0, a limit at least 1")
    spark.dataSource.register(Pages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(Pages.name()).option("path", path).option("offset", offset)
    reader = reader if limit is None else reader.option("limit", limit)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def numbered_pages(spark: SparkSession, path: str, size: int, columns: list[str] | None = None) -> DataFrame:
    """row_index, the columns and page of all rows: pages of `size` rows, numbered from 0, in one scan of the row groups."""
    if size < 1:
        raise ValueError("a page has at least 1 row")
    page = (F.col("row_index") - F.pmod("row_index", F.lit(size))) / F.lit(size)
    return pages(spark, path, columns=columns).withColumn("page", page.cast("long"))
