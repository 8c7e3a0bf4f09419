"""N-gram Jaccard self-join by chosen paths, and the classes that its links form.

Documents are sets of five-word shingles. Equal sets are one set with copies from the start. Every set has
a min-hash of COORDINATES values; a coordinate's value is a sampled token of the set.

Chosen path: a run starts with all sets in one node. A node with more than `leaf` sets is split: it picks
one coordinate by its own hash, and a second one in a quarter of the cases, so a set passes to 1 / 0.8
children on average; sets with the same value share a child. Small nodes are leaves. After MAX_DEPTH
levels what is left is a leaf of any size, cut into cells of two chunks each, so that its pairs are
compared by many tasks. In a leaf all pairs are compared by their min-hash, and those that are near by
their whole sets. A pair whose min-hashes agree in a share a of the coordinates survives a level with
probability p = 1 - (1 - a)(1 - a/4). All runs draw from the same coordinates, so the runs that reach the
target recall even in the deepest leaves follow from the expectation of (1 - p^MAX_DEPTH)^runs over the
binomial distribution of a at the threshold.

A pair counts in the smallest leaf that both are in. Tasks emit link counts and one edge per set to the
root of its links in the cell, never the pairs; edges become classes by large-star and small-star rounds.
Work inside a leaf is bounded by its pairs, which at the last level are mostly links.

Cases: words are runs of anything but white space U+0009..U+000D and space, A-Z lower-cased; a text of
one to four words is one shingle; a null, empty or blank text has no shingle, no link and a class of its
own; repeated rows are copies of each other; null ids rank first for the class id only if all of a class
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.blocks import unpacked, with_answers, write_blocks
from gaugeworks.llm.common import documents, materialise, released, row_key
from gaugeworks.llm.windows import C1, C2, C3

WORDS, COORDINATES, MAX_DEPTH = 5, 64, 3
_FACTORS = (np.arange(1, COORDINATES + 1, dtype=np.uint64) * C1) | np.uint64(1)
MEMBERS = "block long, at int, doc_id long, _k long, set long, size int, signature binary"
CELL = "leaf long, i int, j int, chunk int, set long, copies long, block long, at int, leaves array<long>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * C3
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted 64-bit shingle hashes; words' hashes come from a bounded memory."""

    def __init__(self, remembered: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def shingles(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.remembered:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(WORDS, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = _mixed((out + h[k : k + n]) * C2)
        return np.unique(out)

    @staticmethod
    def signature(shingles: np.ndarray) -> np.ndarray:
        if len(shingles) <= 2048:
            return _mixed(shingles[:, None] * _FACTORS).min(axis=0) >> np.uint64(32)
        parts = [_mixed(shingles[a : a + 2048, None] * _FACTORS).min(axis=0) for a in range(0, len(shingles), 2048)]
        return np.min(parts, axis=0) >> np.uint64(32)


@released
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            table = unpacked(payload.as_py())
            sets, sizes, signatures = [], [], []
            for text in table.column("text").to_pylist():
                s = shingler.shingles(text)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                signatures.append(shingler.signature(s).astype("<u4").tobytes() if len(s) else None)
            n = table.num_rows
            yield from pa.table([pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), table.column("doc_id"), table.column("_k"), pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], names=[c.split()[0] for c in MEMBERS.split(", ")]).combine_chunks().to_batches()


def children(nodes: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their child nodes): each node picks its coordinates, each row passes to the child of its value."""
    h = _mixed(nodes * C1)
    one = (h % np.uint64(COORDINATES)).astype(np.int64)
    two = (one + 1 + ((h >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    extra = np.flatnonzero((h >> np.uint64(40)) % np.uint64(4) == 0)
    rows = np.arange(len(nodes))
    first = _mixed((h + signatures[rows, one]) * C2)
    second = _mixed((h[extra] + np.uint64(1 << 33) + signatures[extra, two[extra]]) * C2)
    return np.concatenate([rows, extra]), np.concatenate([first, second])


def _split(runs: int):
    """Rows (node, set, copies, block, at, signature) to their children; node null: to the roots of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
            rows, nodes = np.arange(batch.num_rows), batch.column(0)
            if nodes.null_count:
                rows = np.repeat(rows, runs)
                start = _mixed(np.tile(np.arange(1, runs + 1, dtype=np.uint64), batch.num_rows) * C3)
            else:
                start = nodes.to_numpy().view(np.uint64)
            at, child = children(start, signatures[rows])
            taken = batch.take(pa.array(rows[at]))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *taken.columns[1:5]], names=["node", "set", "copies", "block", "at"])

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted stream whose first `keys` values are equal."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[:keys] != rows[0][:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def near(rows: list[tuple], signatures: np.ndarray, leaves: list[list[int]], slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that may be links and that no smaller leaf holds. rows start with leaf, i, j, chunk."""
    leaf, i, j = rows[0][:3]
    chunk = np.array([r[3] for r in rows])
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    pairs = []
    for a in range(0, len(left), 64):
        part = left[a : a + 64]
        equal = np.zeros((len(part), len(right)), np.int16)
        for c in range(COORDINATES):
            equal += signatures[part, c][:, None] == signatures[right, c]
        x, y = np.nonzero(equal >= slack * COORDINATES)
        pairs.append((part[x], right[y]))
    x, y = (np.concatenate(p) for p in zip(*pairs)) if pairs else (left[:0], right[:0])
    if i == j:
        x, y = x[x < y], y[x < y]
    width = max(map(len, leaves))
    # Leaves below this one, as numbers; a place without one never equals another row's.
    table = np.full((len(rows), width), -1, np.int64)
    names = {v: n for n, v in enumerate(sorted({v for own in leaves for v in own if v < leaf}))}
    for r, own in enumerate(leaves):
        smaller = [names[v] for v in own if v < leaf]
        table[r, : len(smaller)] = smaller
    earlier = np.zeros(len(x), bool)
    for c in range(width):
        mine = table[x, c]
        earlier |= (mine >= 0) & (mine[:, None] == table[y]).any(axis=1) if len(x) <= 200_000 else np.concatenate([(mine[k : k + 200_000, None] == table[y[k : k + 200_000]]).any(axis=1) for k in range(0, len(x), 200_000)]) & (mine >= 0)
    return x[~earlier], y[~earlier]


def _wanted(slack: float):
    """Rows (cell, set, copies, block, at, leaves, signature) of sets that are near another of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        names = [c.split()[0] for c in CELL.split(", ")]
        out = []
        for rows in groups(batches, 3):
            if len(rows) < 2:
                continue
            signatures = np.frombuffer(b"".join(r[9] for r in rows), "<u4").reshape(-1, COORDINATES)
            x, y = near(rows, signatures, [r[8] for r in rows], slack)
            out += [rows[r][:9] for r in np.unique(np.concatenate([x, y])).tolist()]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


@released
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the rows that cells want of them: one row per cell and set, with its shingles."""
    shingler = Shingler()
    for batch in batches:
        for payload, told in zip(batch.column(0), batch.column(1)):
            texts = unpacked(payload.as_py()).column("text")
            made: dict[int, bytes] = {}
            rows = []
            for w in told.as_py() or ():
                if w["at"] not in made:
                    made[w["at"]] = shingler.shingles(texts[w["at"]].as_py()).tobytes()
                rows.append((w["leaf"], w["i"], w["j"], w["chunk"], w["set"], w["copies"], w["leaves"], made[w["at"]]))
                if len(rows) >= 1000:
                    yield _fetched(rows)
                    rows = []
            if rows:
                yield _fetched(rows)


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["leaf", "i", "j", "chunk", "set", "copies", "leaves", "shingles"])


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist())], np.int64)
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[shared]]
    row = row[shared]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        here = (column >= a) & (column < a + 4096)
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[here], column[here] - a] = 1
        total += part @ part.T
    return total[x, y].astype(np.int64)


def _verify(threshold: float, slack: float):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in groups(batches, 3):
            sets = [np.frombuffer(r[7], np.uint64) for r in rows]
            signatures = np.stack([Shingler.signature(s) for s in sets])
            x, y = near(rows, signatures, [r[6] for r in rows], slack)
            sizes = np.array([len(s) for s in sets])
            both = shared_counts(sets, x, y)
            # in ten-thousandths, so that the comparison is between integers
            ok = both * 10_000 >= round(threshold * 10_000) * (sizes[x] + sizes[y] - both)
            x, y = x[ok], y[ok]
            copies = np.array([r[5] for r in rows], np.int64)
            links = np.bincount(x, weights=copies[y], minlength=len(rows)) + np.bincount(y, weights=copies[x], minlength=len(rows))
            name = np.array([r[4] for r in rows], np.int64)
            root = name.copy()  # smallest name among those linked inside this cell
            while len(x):
                least = np.minimum(root[x], root[y])
                if (root[x] == least).all() and (root[y] == least).all():
                    break
                np.minimum.at(root, x, least)
                np.minimum.at(root, y, least)
            out += [(int(name[r]), int(links[r]), int(root[r])) for r in np.flatnonzero(links).tolist()]
            if len(out) > 5000:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["set", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """set, root: the smallest set of each component. edges: u, v. Large-star and small-star rounds to a fixed point."""
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = materialise(small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("u").alias("set"), F.col("v").alias("root"))
        mark = seen


def runs_for(threshold: float, recall: float) -> int:
    """The least number of runs that miss at most 1 - recall of the pairs at the threshold in leaves of the last level."""
    counts = range(COORDINATES + 1)
    chance = [math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in counts]
    lost = [1 - (1 - (1 - k / COORDINATES) * (1 - k / COORDINATES / 4)) ** MAX_DEPTH for k in counts]
    runs = 1
    while sum(c * x**runs for c, x in zip(chance, lost)) > 1 - recall and runs < 1000:
        runs += 1
    return runs


def shingle_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, leaf: int = 1000, chunk: int = 500, slack: float = 0.5) -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of its class), n_links (other documents at the threshold or above), keeper (one row of each class) and _k."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("_k"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = write_blocks(rows, "shingles")
    members = materialise(blocks.select("block", "payload").mapInArrow(_members, MEMBERS), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "block", "at")
    sets = materialise(members.filter("set is not null").groupBy("set").agg(F.count(F.lit(1)).alias("copies"), F.min(rank).alias("first"), F.min_by("signature", rank).alias("signature")), "sets")
    runs = runs_for(threshold, recall)
    carried = ["set", "copies", F.col("first.block").alias("block"), F.col("first.at").alias("at"), "signature"]
    level, leaves = sets.select(F.lit(None).cast("long").alias("node"), *carried), None
    for depth in range(1, MAX_DEPTH + 1):
        split = materialise(level.mapInArrow(_split(runs), "node long, set long, copies long, block long, at int"), "paths")
        # Written first, so that both sides of the join are plain exchanges and a node of any size can be cut in tasks.
        sizes = materialise(split.groupBy("node").count().filter("count > 1"), "sizes")
        known = materialise(split.join(sizes, "node"), "nodes")
        done = known if depth == MAX_DEPTH else known.filter(F.col("count") <= leaf)
        leaves = done if leaves is None else leaves.unionByName(done)
        open_ = known.filter(F.col("count") > leaf)
        if depth == MAX_DEPTH or not open_.limit(1).count():
            break
        level = open_.select("node", "set", "copies", "block", "at").join(sets.select("set", "signature"), "set").select("node", "set", "copies", "block", "at", "signature")
    # Large leaves are cut into chunks; a cell compares two of them.
    chunks = F.when(F.col("count") > leaf, F.ceil(F.col("count") / chunk)).otherwise(F.lit(1)).cast("int")
    placed = leaves.select(F.col("node").alias("leaf"), "set", "copies", "block", "at", chunks.alias("chunks"), F.pmod(F.xxhash64("set"), chunks).cast("int").alias("chunk"))
    lists = leaves.groupBy("set").agg(F.collect_list("node").alias("leaves")).join(sets.select("set", "signature"), "set")
    cells = placed.join(lists, "set").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("leaf", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "set", "copies", "block", "at", "leaves", "signature")
    cells = cells.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "set")
    wanted = materialise(cells.mapInArrow(_wanted(slack), CELL), "wanted")
    fetched = with_answers(blocks.select("block", "payload"), wanted, "told").filter("told is not null").select("payload", "told").mapInArrow(_fetch, "leaf long, i int, j int, chunk int, set long, copies long, leaves array<long>, shingles binary")
    met = fetched.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "set")
    links = materialise(met.mapInArrow(_verify(threshold, slack), "set long, links long, root long"), "links")
    linked = links.groupBy("set").agg(F.sum("links").alias("links"))
    rooted = components(links.select(F.col("set").alias("u"), F.col("root").alias("v")))
    told = sets.join(linked, "set", "left").join(rooted, "set", "left").withColumn("root", F.coalesce("root", "set"))
    firsts = told.groupBy("root").agg(F.min("first").alias("least"))
    told = told.join(firsts, "root").select("set", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    whole = members.join(told, "set", "left")
    alone = F.col("set").isNull()
    return whole.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | ((F.col("least.block") == F.col("block")) & (F.col("least.at") == F.col("at")))).alias("keeper"),
        "_k",
    )


def op10_shingle_join(spark, sf_dir):
    return shingle_join(documents(spark, sf_dir)).drop("_k")
