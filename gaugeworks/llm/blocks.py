"""Blocks of rows in shared files, and exchanges of packed numpy arrays between blocks and key ranges.

A block is a few megabytes of rows as one compressed Arrow stream. The table of blocks is bucketed by
block id, so that results that come back for a block meet it without moving its rows again. What blocks
and the owners of key ranges tell each other are sorted arrays, one per (block, range), not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import work_folder, work_table

BLOCK_BYTES = 4 << 20
#: Bytes of text whose keys one owner sees.
OWNED_BYTES = 16 << 20


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _cut(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held, texts = TaskContext.get().partitionId() << 24, [], 0, 0

        def flush():
            table = pa.Table.from_batches(parts)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([texts], pa.int64()), pa.array([_packed(table)], pa.binary())], names=["block", "n", "n_bytes", "payload"])

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(column).to_pylist()], np.int64) + 64
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), block_bytes - held, side="right")))
                parts.append(batch.slice(at, n))
                got = int(sizes[at : at + n].sum())
                held, texts, at = held + got, texts + got - 64 * len(sizes[at : at + n]), at + n
                if held >= block_bytes or at < batch.num_rows:
                    yield flush()
                    block, parts, held, texts = block + 1, [], 0, 0
        if parts:
            yield flush()

    return run


def write_blocks(rows: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n, n_bytes, payload; rows has a binary column text."""
    import pyarrow.compute  # noqa: F401

    spark = rows.sparkSession
    table = work_table(name)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = rows.mapInArrow(_cut(block_bytes), "block long, n long, n_bytes long, payload binary")
    blocks.write.bucketBy(buckets, "block").option("path", work_folder(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def key_ranges(blocks: DataFrame, owned_bytes: int = OWNED_BYTES) -> int:
    """Number of key ranges: it grows with the blocks, so that an owner's share doesn't."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(4 * max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-total // owned_bytes))


def with_answers(blocks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """blocks with an array of the structs that came back for each; blocks themselves don't move."""
    fields = [c for c in answers.columns if c != "block"]
    told = answers.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(column))
    return blocks.join(told, "block", "left")


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of 64-bit keys starts in a sorted array, and its end."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


def packed_rows(kind: int, block: int, keys: np.ndarray, columns: list[np.ndarray], parts: int) -> list[tuple]:
    """One row per range that has keys: kind, range, block, number, bytes of keys and of the columns."""
    cuts = ranges(keys, parts)
    return [(kind, r, block, b - a, b"".join([keys[a:b].tobytes(), *(c[a:b].tobytes() for c in columns)])) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]


PACKED = "kind int, part int, block long, n long, data binary"


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "part", "block", "n", "data"])


def answered(packed: DataFrame, answer: Callable[[int, np.ndarray, list[bytes]], list[bytes]], kinds_apart: bool = True) -> DataFrame:
    """The owner of each (kind, range), or of each range, sees its arrays in block order and answers each of them.

    answer(kind, sizes, data) returns one byte string for each array; kind is that of the first one.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("kind", "ascending")])
        kind = table.column("kind")[0].as_py()
        replies = answer(kind, table.column("n").to_numpy(), table.column("data").to_pylist())
        return pa.table({"kind": table.column("kind"), "part": table.column("part"), "block": table.column("block"), "n": table.column("n"), "data": pa.array(replies, pa.binary())})

    return packed.groupBy(*["kind"] * kinds_apart, "part").applyInArrow(run, PACKED)


def joined(answers: list[dict], kind: int, dtype) -> np.ndarray:
    """A block's answers of one kind, in key order."""
    mine = sorted((a["part"], a["data"]) for a in answers or () if a["kind"] == kind)
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(d, dtype) for _, d in mine)])


def columns_of(sizes: np.ndarray, data: list[bytes], dtypes: list) -> list[np.ndarray]:
    """The packed columns of all arrays, each concatenated."""
    out = [[] for _ in dtypes]
    for n, raw in zip(sizes.tolist(), data):
        at = 0
        for column, dtype in zip(out, dtypes):
            column.append(np.frombuffer(raw, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
    return [np.concatenate(c) for c in out]
