"""Rows of a remote dataset, read over HTTP page by page.

The server tells a dataset's configurations and splits (`/splits`), a split's number of rows (`/size`) and slices of its
rows (`/rows`). Each page of at most 100 rows is one task, which fetches it and no other; conditions on row_index that
Spark pushes down leave pages out before any is fetched. `RemoteCatalog` resolves names as the mirror does and keeps what
it fetched as typed Parquet in the shared folder, so that a dataset goes over the network once.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, InputPartition

from gaugeworks.sources.datasets import PAGE, BatchCache, Catalog, Coordinates, DatasetError, effective_limit
from gaugeworks.sources.paged import IndexedReader

#: Fixed value: the public server of hub datasets.
SERVER = "https://datasets-server.huggingface.co"
PATIENCE = 60.0


def fetched(server: str, what: str, token: str | None = None, **query) -> dict:
    """The server's JSON answer; a dataset that it doesn't have is `dataset_unavailable`."""
    told = urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})
    call = urllib.request.Request(f"{server.rstrip('/')}/{what}?{told}", headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(call, timeout=PATIENCE) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise DatasetError(f"dataset_unavailable: {query.get('dataset')}") from None
        raise DatasetError(f"/{what} answered {e.code}") from None
    except (OSError, ValueError) as e:
        raise DatasetError(f"/{what}: {e}") from None


def remote_total(server: str, token: str | None, dataset: str, config: str, split: str, revision: str | None) -> int | None:
    """The number of rows of a split, None if the server doesn't know it."""
    splits = (fetched(server, "size", token, dataset=dataset, config=config, split=split, revision=revision).get("size") or {}).get("splits") or ()
    return next((s["num_rows"] for s in splits if s.get("num_rows") is not None and s.get("split", split) == split), None)


class RemoteReader(IndexedReader):
    def __init__(self, place: dict, token: str | None, page: int, offset: int, limit: int | None, total: int | None):
        super().__init__(offset, limit)
        self.place, self.token, self.page, self.total = place, token, page, total

    def partitions(self):
        if self.total is None and self.high is None:
            raise DatasetError("the number of rows is unknown: give a limit")
        end = min(x for x in (self.total, self.high) if x is not None)
        return [InputPartition((o, min(self.page, end - o))) for o in range(self.low, end, self.page)] or [InputPartition((0, 0))]

    def read(self, partition):
        offset, n = partition.value
        if not n:
            return
        place = dict(self.place)
        rows = fetched(place.pop("server"), "rows", self.token, **place, offset=offset, length=n).get("rows") or []
        if self.total is not None and len(rows) < n:
            raise DatasetError(f"rows {offset} to {offset + n - 1}: the server gave {len(rows)} of {n}")
        for i, item in enumerate(rows[:n]):
            yield offset + i, json.dumps(item.get("row"))


class RemoteRows(DataSource):
    """Format `gaugeworks_remote`. Options: server, dataset, config, split, revision, token, page, offset, limit."""

    @classmethod
    def name(cls) -> str:
        return "gaugeworks_remote"

    def schema(self) -> str:
        return "row_index long, json string"

    def reader(self, schema) -> RemoteReader:
        o = self.options
        place = {k: o.get(k) for k in ("server", "dataset", "config", "split", "revision")}
        total = remote_total(token=o.get("token"), **place)
        return RemoteReader(place, o.get("token"), int(o.get("page", PAGE)), int(o.get("offset", 0)), int(o["limit"]) if o.get("limit") else None, total)


class RemoteCatalog(Catalog):
    """Hub datasets from a server; what was fetched stays below root."""

    def __init__(self, spark: SparkSession, root: str, server: str | None = None, token: str | None = None):
        super().__init__(spark, root)
        self.server, self.token = server or os.environ.get("HF_DATASETS_SERVER") or SERVER, token or os.environ.get("HF_TOKEN")
        self.cache = BatchCache(spark, f"{self.root}/remote")

    def _splits(self, dataset: str, config: str | None, revision: str | None) -> list[dict]:
        return fetched(self.server, "splits", self.token, dataset=dataset, config=config, revision=revision).get("splits") or []

    def configs(self, dataset: str, revision: str | None = None) -> list[str]:
        return list(dict.fromkeys(s.get("config", "") for s in self._splits(dataset, None, revision)))

    def splits(self, dataset: str, config: str, revision: str | None = None) -> list[str]:
        return [s.get("split", "") for s in self._splits(dataset, config, revision) if s.get("config", config) == config]

    def total_rows(self, at: Coordinates) -> int | None:
        return super().total_rows(at) if at.kind != "hub" else remote_total(self.server, self.token, at.dataset, at.config, at.split, at.revision)

    def page(self, at: Coordinates, offset: int = 0, limit: int | None = None) -> DataFrame:
        """row_index and json of rows [offset, offset + limit), fetched whenever they are read."""
        if at.config is None or at.split is None:
            raise DatasetError("the source isn't resolved yet")
        self.spark.dataSource.register(RemoteRows)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options = {"server": self.server, "dataset": at.dataset, "config": at.config, "split": at.split, "revision": at.revision, "token": self.token, "offset": offset, "limit": limit}
        return self.spark.read.format(RemoteRows.name()).options(**{k: v for k, v in options.items() if v is not None}).load()

    def rows(self, at: Coordinates, first: int | None = None) -> DataFrame:
        """row_index and typed columns, of all rows or the first ones; fetched once, read from the shared folder after that."""
        if at.kind != "hub":
            return super().rows(at, first)
        n = effective_limit(first, self.total_rows(at))
        return self.cache.batch(at, self.page(at, 0, n), ["row_index"], 0, n, "json", index="row_index")
