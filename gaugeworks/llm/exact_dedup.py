"""Exact deduplication over an extendible-hash index on shared files.

1. Each task folds the equal texts it meets into entries (one text, many rows) and writes rows and entries. A copy
   that half of the corpus repeats leaves a task as one entry.
2. Entries go to the bucket files of the index by the leading bits of their key, as many as two buckets for `capacity`
   bytes need. Every bucket that holds more, and more than one key, splits: its file is read and written again as two,
   by one more bit, and the directory doubles whenever a splitting bucket is as deep as the directory itself.
3. An owner task per bucket streams its file, chains the entries that share a 64-bit key and compares normalised
   bytes inside the chain. Memory holds the bucket's distinct texts.
4. Rows look up the class of their entry. An entry has at most one task's rows, so no key is hot.

A key whose entries alone exceed the capacity (a text that very many tasks have met) can't be split by its bits. Its
entries are dealt to tasks by their number first, folded there as in step 1, and what is left goes to the bucket.

Cases: a null text is empty; empty texts equal each other; a null doc_id ranks below every other; of
repeated rows with one doc_id exactly one stays; a very long text is one entry, larger than its bucket's
capacity if need be; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, materialise, release, released, row_key, work_folder, work_table

#: A-Z only: the 26 other pairs of Unicode stay apart.
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MAX_DEPTH = 20

INDEX = "doc_id long, uid long, _k long, entry_id long, sha binary, leader boolean, key long, n long, top_null boolean, top_doc long, top_uid long, n_bytes long, text binary"
_INDEX = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("_k", pa.int64()), ("entry_id", pa.int64()), ("sha", pa.binary()), ("leader", pa.bool_()), ("key", pa.int64()), ("n", pa.int64()), ("top_null", pa.bool_()), ("top_doc", pa.int64()), ("top_uid", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.binary())])


def rank(doc_id: int | None, uid: int) -> tuple:
    return (doc_id is not None, doc_id or 0, uid)


def _fold_rows(combine_bytes: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        entries: dict[tuple, list] = {}
        rows: list[tuple] = []
        held = 0

        def flush():
            cols = [[] for _ in _INDEX]
            for doc_id, own, key, entry in rows:
                text, first, sha, n, top = entry
                lead = own == first
                line = (doc_id, own, key, first, sha, lead) + ((int.from_bytes(sha[:8], "big", signed=True), n, not top[0], top[1], top[2], len(text), text) if lead else (None,) * 7)
                for c, v in zip(cols, line):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _INDEX)], schema=_INDEX)

        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = (text or b"").translate(FOLD)
                sha = hashlib.sha256(text).digest()
                slot = entries.setdefault((sha, len(text)), [])
                entry = next((e for e in slot if e[0] == text), None)
                if entry is None:
                    entry = [text, uid, sha, 0, (False, 0, -1)]
                    slot.append(entry)
                    held += len(text)
                entry[3] += 1
                entry[4] = max(entry[4], rank(doc_id, uid))
                rows.append((doc_id, uid, key, entry))
                uid += 1
                if held > combine_bytes or len(rows) >= 50_000:
                    yield flush()
                    entries, rows, held = {}, [], 0
        if rows:
            yield flush()

    return run


class Directory:
    """Slots for the leading `depth` bits of a key; each names a bucket with its own, local depth."""

    def __init__(self, depth: int):
        self.depth, self.slots, self.local = depth, list(range(1 << depth)), [depth] * (1 << depth)
        self.prefix = list(range(1 << depth))

    def split(self, bucket: int) -> tuple[int, int]:
        """Two new buckets for the old one's keys: those with 0 and those with 1 as the next bit."""
        depth, prefix = self.local[bucket], self.prefix[bucket]
        if depth == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        zero = len(self.local)
        self.local += [depth + 1, depth + 1]
        self.prefix += [2 * prefix, 2 * prefix + 1]
        half = 1 << (self.depth - depth - 1)
        first = 2 * prefix * half
        self.slots[first : first + 2 * half] = [zero] * half + [zero + 1] * half
        return zero, zero + 1

    def find(self, key: int) -> int:
        """The bucket of a signed 64-bit key."""
        return self.slots[(key % (1 << 64)) >> (64 - self.depth)] if self.depth else self.slots[0]


ENTRIES = ["key", "entry_id", "n", "top_null", "top_doc", "top_uid", "n_bytes", "text"]


def _chained(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list]:
    """[key, text, entries, rows, top] of each distinct text of a group whose ENTRIES begin at column `at`."""
    chains: dict[int, list] = {}
    for batch in batches:
        for key, entry, n, null, doc, uid, _, text in zip(*(batch.column(at + i).to_pylist() for i in range(len(ENTRIES)))):
            chain = chains.setdefault(key, [])
            link = next((c for c in chain if c[1] == text), None)
            if link is None:
                link = [key, text, [], 0, (False, 0, -1)]
                chain.append(link)
            link[2].append(entry)
            link[3] += n
            link[4] = max(link[4], (not null, doc, uid))
    for chain in chains.values():
        yield from chain


_CLASSES = pa.schema([("entry_id", pa.int64()), ("keep_null", pa.bool_()), ("keep_doc", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])
CLASSES = "entry_id long, keep_null boolean, keep_doc long, keep_uid long, group_size long"


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's entries with their classes."""
    done = []
    for _, _, entries, n, top in _chained(batches, 1):
        done += [(e, not top[0], top[1], top[2], n) for e in entries]
        if len(done) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _CLASSES)], schema=_CLASSES)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _CLASSES)], schema=_CLASSES)
    release()


_MERGED = pa.schema([("into", pa.int64()), ("key", pa.int64()), ("entry_id", pa.int64()), ("n", pa.int64()), ("top_null", pa.bool_()), ("top_doc", pa.int64()), ("top_uid", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.binary())])
MERGED = "into long, key long, entry_id long, n long, top_null boolean, top_doc long, top_uid long, n_bytes long, text binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct text of a share of a key's entries, and a row without text for each entry that went into it."""
    for key, text, entries, n, top in _chained(batches, 2):
        rows = [(entries[0], key, entries[0], n, not top[0], top[1], top[2], len(text), text)] + [(entries[0], key, e) + (None,) * 6 for e in entries]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MERGED)], schema=_MERGED)


def _write_buckets(entries: DataFrame, n: int) -> DataFrame:
    """A table of files by bucket, written by about a task a bucket."""
    spark = entries.sparkSession
    table = work_table("dedup")
    files = min(100_000, max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    entries.select("bucket", *ENTRIES).repartitionByRange(n, "bucket").write.option("compression", "zstd").bucketBy(files, "bucket").option("path", work_folder(spark, "dedup-buckets")).format("parquet").saveAsTable(table)
    return spark.table(table)


def build_index(entries: DataFrame, capacity: int) -> tuple[Directory, list[DataFrame]]:
    """The directory, and tables of bucket files: a split bucket's entries are in a later table, where its halves are."""
    spark = entries.sparkSession
    total = entries.agg(F.sum("n_bytes")).first()[0] or 0
    tree = Directory(min(MAX_DEPTH, max(0, (2 * total // capacity).bit_length())))
    bucket = F.shiftrightunsigned("key", 64 - tree.depth) if tree.depth else F.lit(0)
    table, tables = _write_buckets(entries.withColumn("bucket", bucket.cast("int")), len(tree.slots)), []
    while True:
        sizes = table.groupBy("bucket").agg(F.sum("n_bytes").alias("held"), (F.min("key") < F.max("key")).alias("several")).filter((F.col("held") > capacity) & F.col("several"))
        full = sorted(r["bucket"] for r in sizes.collect() if tree.local[r["bucket"]] < MAX_DEPTH)  # buckets, 2^MAX_DEPTH at most
        if not full:
            return tree, [*tables, table]
        bits = {b: tree.local[b] for b in full}
        split = spark.createDataFrame([(b, 63 - bits[b], *tree.split(b)) for b in full], "bucket int, shift int, zero int, one int")
        halves = table.join(F.broadcast(split), "bucket")
        one = F.expr("shiftrightunsigned(key, shift) & 1") == 1
        tables.append(table.join(F.broadcast(split.select("bucket")), "bucket", "left_anti"))
        table = _write_buckets(halves.withColumn("bucket", F.when(one, F.col("one")).otherwise(F.col("zero"))), 2 * len(full))


def exact_dedup(docs: DataFrame, capacity: int = 64 << 20, combine_bytes: int = 24 << 20) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 and _k, the row's key for keep_rows()."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("_k"), F.col("text").cast("string").cast("binary").alias("text"))
    index = materialise(rows.mapInArrow(_fold_rows(combine_bytes), INDEX), "dedup-entries")
    entries = index.filter("leader").select(*ENTRIES)
    hot = entries.groupBy("key").agg(F.sum("n_bytes").alias("held"), F.count(F.lit(1)).alias("told")).filter((F.col("held") > capacity) & (F.col("told") > 1)).select("key", F.ceil(F.col("held") / capacity).alias("shares"))
    hot = materialise(hot, "dedup-hot")
    merged = None
    if hot.limit(1).count():
        share = F.pmod(F.xxhash64("entry_id"), F.col("shares")).alias("share")
        merged = materialise(entries.join(hot, "key").select("key", share, F.struct(*ENTRIES).alias("e")).select("key", "share", *[F.col(f"e.{c}").alias(f"_{c}") for c in ENTRIES]).groupBy("key", "share").applyInArrow(_merge, MERGED), "dedup-merged")
        entries = entries.join(hot, "key", "left_anti").select(*ENTRIES).unionByName(merged.filter("text is not null").select(*ENTRIES))
    _, tables = build_index(entries, capacity)
    parts = [t.select("bucket", *ENTRIES).groupBy("bucket").applyInArrow(_own, CLASSES) for t in tables]
    classes = materialise(functools.reduce(DataFrame.unionByName, parts), "dedup-classes")
    if merged is not None:
        told = merged.filter("text is null").select("entry_id", "into").join(classes.withColumnRenamed("entry_id", "into"), "into").drop("into")
        classes = classes.join(merged.select("entry_id").distinct(), "entry_id", "left_anti").unionByName(told.select(*classes.columns))
    return index.select("doc_id", "uid", "_k", "entry_id", "sha").join(classes, "entry_id").select(
        "doc_id",
        F.when(~F.col("keep_null"), F.col("keep_doc")).alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "_k",
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).drop("_k")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
