"""Datasets: resolving names, choosing splits, paged reads, a write-once batch cache, custom sources."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gaugeworks.functions.hashing import cache_key
from gaugeworks.functions.json_values import inferred_types, parsed, typed

#: Schemes of the remote hub, order of preference among splits, rows of a page.
HUB_SCHEMES = ("hf", "huggingface")
SPLIT_ORDER = ("test", "validation", "eval", "train")
PAGE = 100


class DatasetError(ValueError):
    pass


@dataclass(frozen=True)
class Coordinates:
    """Where rows come from. `hub` datasets are read from a mirror folder root/<id>/config=<c>/split=<s>."""

    kind: str
    dataset: str
    config: str | None = None
    split: str | None = None
    revision: str | None = None

    @property
    def source_id(self) -> str:
        return ":".join(["hf" if self.kind == "hub" else self.kind, self.dataset, *(x for x in (self.config, self.split) if x)])


def resolve(source: str) -> Coordinates:
    """hf://, huggingface://, and our own file:// and table://."""
    scheme, mark, name = source.partition("://")
    if not mark:
        raise DatasetError(f"{source!r} has no scheme; use hf://<dataset>")
    if scheme not in (*HUB_SCHEMES, "file", "table"):
        raise DatasetError(f"unknown scheme {scheme!r}")
    if not name.strip("/"):
        raise DatasetError(f"{source!r} names no dataset")
    return Coordinates("hub" if scheme in HUB_SCHEMES else scheme, name)


def pick_split(splits: Sequence[str], wanted: str | None = None) -> str:
    if wanted is not None:
        if wanted not in splits:
            raise DatasetError(f"there is no split {wanted!r}; there are {', '.join(splits)}")
        return wanted
    if not splits:
        raise DatasetError("the dataset has no splits")
    return next((s for s in SPLIT_ORDER if s in splits), splits[0])


def _folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the partition folders key=value below a path, through Spark's own file systems."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        raise DatasetError("dataset_unavailable")
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{key}="))


class Catalog:
    """Mirror of hub datasets below a root folder, as Parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def configs(self, dataset: str, revision: str | None = None) -> list[str]:
        return _folders(self.spark, f"{self.root}/{dataset}", "config")

    def splits(self, dataset: str, config: str, revision: str | None = None) -> list[str]:
        return _folders(self.spark, f"{self.root}/{dataset}/config={config}", "split")

    def resolved(self, source: str, config: str | None = None, split: str | None = None, revision: str | None = None) -> Coordinates:
        at = resolve(source)
        if at.kind != "hub":
            return at
        if config is None:
            known = self.configs(at.dataset, revision)
            if not known:
                raise DatasetError("dataset_unavailable")
            config = known[0]
        return Coordinates("hub", at.dataset, config, pick_split(self.splits(at.dataset, config, revision), split), revision)

    def rows(self, at: Coordinates, first: int | None = None) -> DataFrame:
        """All rows. `first` says how many are wanted; a catalog that fetches rows stops there."""
        if at.kind == "table":
            return self.spark.table(at.dataset)
        path = at.dataset if at.kind == "file" else f"{self.root}/{at.dataset}/config={at.config}/split={at.split}"
        return self.spark.read.json(path) if path.endswith((".json", ".jsonl")) else self.spark.read.parquet(path)

    def total_rows(self, at: Coordinates) -> int | None:
        return self.rows(at).count()


def effective_limit(requested: int | None, total: int | None) -> int:
    if requested is not None and requested < 1:
        raise DatasetError("a limit is at least 1")
    if total is None and requested is None:
        raise DatasetError("the number of rows is unknown: give a limit")
    return min(x for x in (requested, total) if x is not None)


class BatchCache:
    """Pages of a dataset, written once under root/<key>/<offset>_<limit> and read back after that."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, at: Coordinates, offset: int, limit: int) -> str:
        return f"{self.root}/{cache_key(at.dataset, at.config or '', at.split or '', at.revision)}/{offset}_{limit}"

    def batch(self, at: Coordinates, rows: DataFrame, order: Sequence[str], offset: int, limit: int, json: str | None = None, index: str | None = None) -> DataFrame:
        """A page of rows. Where `json` names a column of JSON rows, the page is written as typed columns, the union of its keys.

        Where `index` names a column that counts the rows from 0, the page is a condition on it, which a paged source
        answers without reading others, and the column stays. JSON rows are read from their source once.
        """
        path = self.path(at, offset, limit)
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path):
            page = rows.orderBy(*order).offset(offset).limit(limit) if index is None else rows.filter((F.col(index) >= offset) & (F.col(index) < offset + limit))
            if json:
                page.write.mode("overwrite").parquet(f"{path}.raw")
                page = typed_rows(self.spark.read.parquet(f"{path}.raw"), json, index)
            page.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def typed_rows(rows: DataFrame, json_column: str, index: str | None = None) -> DataFrame:
    """JSON rows as columns: keys sorted, types inferred over all rows, missing keys null. The key list comes to the driver.

    The index column, if one is named, comes first; a key of its name is left out.
    """
    kinds = sorted((r["key"], r["type"]) for r in inferred_types(rows, json_column).collect())
    v = parsed(F.col(json_column))
    return rows.select(*([F.col(index)] if index else []), *[typed(v, k, t).alias(k) for k, t in kinds if k != index])


class PagedReader(DataSourceReader):
    def __init__(self, source, rows: int, page: int, source_id: str):
        self.source, self.rows, self.page, self.source_id = source, rows, page, source_id

    def partitions(self):
        return [InputPartition((o, min(self.page, self.rows - o))) for o in range(0, self.rows, self.page)] or [InputPartition((0, 0))]

    def read(self, partition):
        offset, n = partition.value
        for i, row in enumerate(self.source.load_batch(offset, n) if n else ()):
            yield offset + i, json.dumps(row)


class PagedSource(DataSource):
    """A custom source as a Spark data source: row_index, json. Options: batch_size, max_rows.

    Subclasses say `source_id`, `initialize()` (returns the number of rows, or None if it is unknown) and
    `load_batch(offset, n)`; pages are read by as many tasks.
    """

    source_id = "custom"

    @classmethod
    def name(cls) -> str:
        return cls.source_id

    def schema(self) -> str:
        return "row_index long, json string"

    def initialize(self) -> int | None:
        raise NotImplementedError

    def load_batch(self, offset: int, n: int) -> list[dict]:
        raise NotImplementedError

    def reader(self, schema):
        most = self.options.get("max_rows")
        rows = effective_limit(int(most) if most else None, self.initialize())
        return PagedReader(self, rows, int(self.options.get("batch_size", PAGE)), self.source_id)


def local_bundle(files: dict[str, bytes], digests: dict[str, str], definition: str = "definition.toml", most_files: int = 32, most_bytes: int = 10 << 20, most_total: int = 50 << 20) -> dict[str, bytes]:
    """Check a bundle of definition files: count, sizes, SHA-256, safe names, one definition."""
    import hashlib

    if len(files) > most_files:
        raise DatasetError(f"more than {most_files} files")
    if sum(map(len, files.values())) > most_total or any(len(x) > most_bytes for x in files.values()):
        raise DatasetError("the bundle is too large")
    for name, data in files.items():
        if os.path.isabs(name) or ".." in name.replace("\\", "/").split("/"):
            raise DatasetError(f"{name!r} leaves the bundle")
        if hashlib.sha256(data).hexdigest() != digests.get(name):
            raise DatasetError(f"{name!r} doesn't have the digest that was announced")
    if sum(os.path.basename(n) == definition for n in files) != 1:
        raise DatasetError("a bundle has exactly one definition")
    return files
