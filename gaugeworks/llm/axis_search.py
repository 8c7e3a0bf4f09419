"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables and exact reranking.

1. **Classes.** Equal vectors are one class with its `k + 1` smallest ids: no other member can be among anybody's k
   nearest. So a vector that a third of the rows share is one entry of the index, and is searched for once.
2. **Hash.** A table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
   transform, padded to a power of two) and names them by their nearest signed axis, the coordinate of largest magnitude
   with its sign. There are 2 x length axes a table.
3. **Probes.** A query asks a table's axes from the nearest on. How many is fitted: a sample of at most `sample` query
   classes (the smallest hashes) is searched exactly, in one pass over all classes; the smallest number of probes that
   finds `recall` of their neighbours holds for every query. If none does, all axes are asked, and the search is exact.
4. **Cells.** Classes go to the cell of their axis in each table, queries to the cells they ask. A cell of more than
   `held` components is cut into slices by hash and its queries go to each: a task holds one slice, and queries pass by in
   batches, so near copies that fill an axis cost no task more than a slice. Sizes of cells are counted first (one number
   per axis and table).
5. **Rerank.** Within a slice, exact cosines in double precision choose each query's k + 1 best classes; those of all
   cells are ranked again by (score, smallest id). Members, less the query's own id, make the result.
6. Queries that found fewer than k candidates, if there are any, ask all axes of one table, which is exact.

Work: a query meets the classes of its axes. That is the stated query set against a share of all rows that the fitted
number of probes sets, not a constant number of rows; data move once a table, queries once a probe.

Cases: vectors null, zero or with null or non-finite components take no part, nor do rows without an id, and vectors of
another length than the commonest, to which no cosine is defined. A repeated row counts once; an id with two vectors is
two queries, and both are candidates. Fewer than k candidates are all returned; no rows give no rows. Ties go to the
smaller id. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import materialise, released
from gaugeworks.llm.vectors import dimension, embeddings, matrix, usable

TABLES, SAMPLE, RECALL, SEED = 4, 200, 0.95, 20_240_601
#: Components that a slice holds, queries that pass it at once, and pairs that are reranked at once.
HELD, BATCH, PAIRS = 1_500_000, 256, 20_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, in place of log2(length) butterflies; not normalised, which changes no axis."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _axes_of(dims: int) -> int:
    """Signed axes of a table."""
    return 2 << max(0, dims - 1).bit_length()


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of rows, padded to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng((SEED, table)).choice((-1.0, 1.0), (3, d))
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = _hadamard(out * s)
    return out


def axes(x: np.ndarray, table: int) -> np.ndarray:
    """The nearest signed axis: i for +e_i, d + i for -e_i."""
    r = rotated(x, table)
    at = np.abs(r).argmax(axis=1)
    return at + len(r[0]) * (r[np.arange(len(r)), at] < 0) if len(r) else at


def probes(x: np.ndarray, table: int) -> np.ndarray:
    """All signed axes of a table, nearest first."""
    r = rotated(x, table)
    return np.argsort(-np.concatenate((r, -r), axis=1), axis=1, kind="stable")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; a pair's value doesn't depend on the rows around it."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) if x.size and (np.abs(x).max() > 1e100 or np.abs(x).max(axis=1).min() < 1e-100) else x for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _first(q: np.ndarray, score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best by (score, least)."""
    order = np.lexsort((least, -score, q))
    return order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]


def _best(queries: np.ndarray, rows: np.ndarray, units: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows by (score, least). Products choose with a margin, cosines decide.

    Rows of one direction are ties that all pass the margin, so pairs are reranked some at a time.
    """
    near = unit(queries) @ units.T
    k = min(k, len(rows))
    edge = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k]
    q, r = np.nonzero(near >= edge[:, None] - 1e-12)
    score = np.concatenate([cosines(queries[q[i : i + PAIRS]], rows[r[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)])
    best = _first(q, score, least[r], k)
    return q[best], r[best], score[best]


_CELL = ("cell", "kind", "key", "ids", "vec")


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names=list(names))


def classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """One row per distinct vector: a key, its k + 1 smallest ids, whether some id is a query, vec.

    Copies are folded in the tasks that read them before anything moves: rows by (vector, id), then ids by a limit
    within groups.
    """
    once = rows.groupBy("vec", "vec_id").agg(F.lit(1).alias("_")).drop("_")
    asked = once.filter(F.col("vec_id") % every == 0).groupBy("vec").agg(F.lit(True).alias("asked"))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = once.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return few.join(asked, "vec", "left").select(F.concat_ws(":", F.col("ids")[0], F.xxhash64("vec")).alias("key"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "vec")  # an id may have two vectors


def _exact_sample(index: DataFrame, sample: list, dims: int, tables: int, k: int) -> list[tuple[int, list[int]]]:
    """(query, the axes of a true neighbour) for each neighbour of the sampled classes, by a pass over all classes."""
    asked, own = np.array([r["vec"] for r in sample], dtype=np.float64), np.array([r["key"] for r in sample])

    @released
    def scan(batches):
        held = np.zeros(0, int), np.zeros((0, dims)), np.zeros(0), np.zeros(0, int)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x, key, least = matrix(part["vec"], dims)[1], np.array(part["key"].to_pylist()), part["least"].to_numpy()
                q, r, score = _best(asked, x, unit(x), least, k + 1)
                other = own[q] != key[r]
                held = tuple(np.concatenate(c) for c in zip(held, (q[other], x[r[other]], score[other], least[r[other]])))
                best = _first(held[0], held[2], held[3], k)
                held = tuple(c[best] for c in held)
        q, x, score, least = held
        named = np.stack([axes(x, t) for t in range(tables)], axis=1) if len(x) else np.zeros((0, tables), int)
        yield _batch((q.astype(np.int32), score, least, pa.array(named.tolist(), pa.list_(pa.int32()))), ("q", "score", "least", "axes"))

    found = index.select("key", F.col("ids")[0].alias("least"), "vec").mapInArrow(scan, "q int, score double, least long, axes array<int>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least"))
    return [(r["q"], r["axes"]) for r in found.withColumn("_nth", nth).filter(F.col("_nth") <= k).select("q", "axes").collect()]  # sample x k rows


def fitted_probes(index: DataFrame, dims: int, tables: int, k: int, sample: int, recall: float) -> int:
    """The smallest number of axes a table at which the sampled queries find `recall` of their true neighbours."""
    some = index.filter("asked").orderBy(F.xxhash64("key"), "key").limit(sample).select("key", "vec").collect()
    most = _axes_of(dims)
    if not some:
        return most
    true = _exact_sample(index, some, dims, tables, k)
    asked = np.array([r["vec"] for r in some], dtype=np.float64)
    order = [np.argsort(probes(asked, t), axis=1) for t in range(tables)]  # the place of each axis in a query's order
    places = sorted(min(int(order[t][q, a]) for t, a in enumerate(named)) for q, named in true)
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)] + 1 if places else most


def _searched(index: DataFrame, asked: DataFrame, dims: int, tables: int, ask: int, k: int, held: int) -> DataFrame:
    """key of the query, score, ids of a found class: the k + 1 best of each slice. index: key, ids, vec; asked: key, vec."""
    spark = index.sparkSession
    most = _axes_of(dims)

    def named(batches):
        for batch in batches:
            x = unit(matrix(batch["vec"], dims)[1])
            yield _batch([axes(x, t).astype(np.int32) for t in range(tables)], [f"a{t}" for t in range(tables)])

    axis = F.posexplode(F.array(*[f"a{t}" for t in range(tables)])).alias("t", "axis")
    counted = index.select("vec").mapInArrow(named, ", ".join(f"a{t} int" for t in range(tables))).select(axis).groupBy("t", "axis").count()
    slices, total = np.ones(tables * most, np.int64), 0
    for r in counted.collect():  # tables x axes rows at most
        slices[r["t"] * most + r["axis"]], total = -(-r["count"] // max(1, held // dims)), total + r["count"]
    first = slices.cumsum() - slices  # the number of each cell's first slice

    @released
    def placed(batches):
        for batch in batches:
            x = unit(matrix(batch["vec"], dims)[1])
            for t in range(tables):
                at = t * most + axes(x, t)
                yield _batch((first[at] + batch["deal"].to_numpy() % slices[at], np.zeros(len(x), np.int8), batch["key"], batch["ids"], batch["vec"]), _CELL)

    @released
    def sent(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                x = unit(matrix(part["vec"], dims)[1])
                for t in range(tables):
                    at = t * most + probes(x, t)[:, :ask]
                    count = slices[at.reshape(-1)]
                    row = np.repeat(np.repeat(np.arange(len(x)), at.shape[1]), count)
                    nth = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
                    cells = np.repeat(first[at.reshape(-1)], count) + nth
                    for some in range(0, len(row), 10_000):  # a query of many slices is many rows
                        take = pa.array(row[some : some + 10_000])
                        yield _batch((cells[some : some + 10_000], np.ones(len(take), np.int8), part["key"].take(take), part["ids"].take(take), part["vec"].take(take)), _CELL)

    @released
    def met(batches):
        """Rows come by (cell, kind): a slice's classes are held, its queries are answered as they pass."""
        at, come, done = -1, [], None
        for batch in batches:
            cells, kinds = batch["cell"].to_numpy(), batch["kind"].to_numpy()
            starts = np.flatnonzero((np.diff(cells, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for low, high in pairwise([*starts, len(cells)]):
                if cells[low] != at:
                    at, come, done = cells[low], [], None
                part = batch.slice(low, high - low)
                if not kinds[low]:
                    come.append(part)
                    continue
                if come:
                    whole = pa.Table.from_batches(come)
                    x, ids, come = matrix(whole["vec"], dims)[1], whole["ids"].combine_chunks(), []
                    done = x, unit(x), pc.list_element(ids, 0).to_numpy(), ids
                if done is not None:
                    x, units, least, ids = done
                    for some in range(0, part.num_rows, BATCH):
                        own = part.slice(some, BATCH)
                        q, r, score = _best(matrix(own["vec"], dims)[1], x, units, least, k + 1)
                        yield _batch((own["key"].take(pa.array(q)), score, ids.take(pa.array(r))), ("key", "score", "ids"))

    schema = "cell long, kind byte, key string, ids array<long>, vec " + index.schema["vec"].dataType.simpleString()
    queries = asked.select("key", F.array().cast("array<long>").alias("ids"), "vec")
    deal = F.pmod(F.xxhash64("key"), F.lit(1 << 31)).alias("deal")
    rows = index.select("key", "ids", "vec", deal).mapInArrow(placed, schema).unionByName(queries.mapInArrow(sent, schema))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * dims // (20 * held))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell", "kind").mapInArrow(met, "key string, score double, ids array<long>")


def nearest(rows: DataFrame, k: int = 5, every: int = 50, tables: int = TABLES, held: int = HELD, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score. rows: vec_id, embedding; queries are ids that `every` divides."""
    zero = F.forall("vec", lambda x: x == 0)
    kept = usable(rows, "vec_id").filter(F.col("vec_id").isNotNull() & ~zero)
    dims = dimension(kept)
    shown = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return rows.sparkSession.createDataFrame([], shown)
    kept = kept.filter(F.size("vec") == dims)
    index = materialise(classes(kept, k, every), "vector-classes")
    asked = index.filter("asked").select("key", "vec")
    ask = fitted_probes(index, dims, tables, k, sample, recall)
    found = _answers(_searched(index, asked, dims, tables, ask, k, held), k)
    found = materialise(found, "vector-answers")
    told = _results(kept, index, found, k, every)
    few = asked.join(found.filter(F.col("found") > k).select("key"), "key", "left_anti")  # k others at least are named by k + 1
    if few.limit(1).count():
        whole = materialise(_answers(_searched(index, few, dims, 1, _axes_of(dims), k, held), k), "vector-exact")
        told = _results(kept, index, found.join(whole, "key", "left_anti").unionByName(whole), k, every)
    return told


def _answers(hits: DataFrame, k: int) -> DataFrame:
    """key, candidates (score, ids) of its k + 1 best classes, and how many ids they have. What several cells found counts once."""
    nth = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0]))
    best = hits.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).groupBy("key", "score", "ids").agg(F.lit(1).alias("_"))
    told = best.groupBy("key").agg(F.collect_list(F.struct("score", "ids")).alias("candidates"))
    return told.withColumn("found", F.aggregate("candidates", F.lit(0), lambda n, c: n + F.size(c["ids"])))


def _results(rows: DataFrame, index: DataFrame, found: DataFrame, k: int, every: int) -> DataFrame:
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec", "vec_id").agg(F.lit(1).alias("_"))
    known = queries.join(index.filter("asked").select("vec", "key"), "vec").select("vec_id", "key")
    pair = F.flatten(F.transform("candidates", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("away"), i.alias("vec_id")))))
    others = F.filter(pair, lambda p: p["vec_id"] != F.col("_query"))
    told = known.withColumnRenamed("vec_id", "_query").join(found, "key").select(F.col("_query").alias("query_id"), F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("nth", "c"))
    return told.select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), "c.vec_id", (-F.col("c.away")).alias("score"))


def op12_axis_search(spark, sf_dir):
    return nearest(embeddings(spark, sf_dir))
