"""Vector code compression: product codes of four bytes from codebooks in exact integer arithmetic.

A component c is the integer floor(1024 * c); a vector is cut into four equal parts, each with a codebook of up to 256
entries. Rounds of assigning every part to its nearest entry and of moving entries to the floored means of their parts
are passes over all rows: a task adds up its own parts (4 x 256 rows of sums at most), and the driver sees the sums of
the whole table, whose size is set by parameters alone.

The nearest entry of a part is found by segment-mean lower bounds. For a block of L components with sums s, t and
residual norms r, q about the blocks' means,

    |x - c|^2  >=  (s - t)^2 / L + (r - q)^2

so the sum of it over the blocks of a part bounds the distance from below; it is itself the squared distance of two
short points, a mean and a norm for each block, and one product of matrices gives it for all rows and entries. One block
comes first, then four, then eight: each level takes the exact distance to its most promising entry and lets go of all whose bound
is beyond the least of these. The survivors get exact integer distances. Bounds are doubles with a margin far above
their rounding, so no entry that could be nearest, or as near, ever goes.

Cases: rows whose vector is null or has null or non-finite components are dropped. All-equal and repeated rows are
coded alike; the first codebook takes rows by (vec_id, vector), so repeated ids don't depend on the order of input, and
null ids come last. Fewer than 256 rows give a codebook of as many entries; no rows give no rows. Vectors of another
length than the commonest keep their row with null code and error, and count in no codebook and no label's sum. A
length that four doesn't divide, and a component of 65,536 or more (whose distances don't fit a long for sure), raise.
Columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gaugeworks.llm.common import materialise, released
from gaugeworks.llm.vectors import dimension, embeddings, matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Blocks of a part, coarse to fine, before exact distances.
LEVELS = (1, 4, 8)
LARGEST = 2**26
CHUNK = 1024


def integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError("a component of 65536 or more can't be coded exactly")
    return scaled.astype(np.int64)


def _sketch(x: np.ndarray, count: int) -> np.ndarray:
    """Rows as points whose squared distances are the bound: each block's mean and residual norm, scaled by its length."""
    bounds = np.unique(np.linspace(0, x.shape[1], count + 1).astype(int))
    length = np.diff(bounds)
    sums = np.add.reduceat(x, bounds[:-1], axis=1)
    squares = np.add.reduceat(x * x, bounds[:-1], axis=1)
    return np.concatenate((sums / np.sqrt(length), np.sqrt((length * squares - sums * sums) / length)), axis=1)


def _bounds(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all sketches of rows and entries, less a margin for the rounding of products of this size."""
    own, others = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", entries, entries)
    return own - 2 * (x @ entries.T) + others - 1e-12 * (own + others) - 1e-3


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of x the nearest entry (the lowest index of ties), its exact squared distance; and how many exact distances were taken."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    within = np.full(len(x), np.inf)
    possible, taken = np.ones((len(x), len(entries)), bool), 0
    for count in LEVELS:
        bound = _bounds(_sketch(x, count), _sketch(entries, count))
        likely = x - entries[bound.argmin(axis=1)]
        within, taken = np.minimum(within, (likely * likely).sum(axis=1)), taken + len(x)
        possible &= bound <= within[:, None]
    row, entry = np.nonzero(possible)
    apart = x[row] - entries[entry]
    exact = np.einsum("ij,ij->i", apart, apart)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(exact, first)
    index = np.minimum.reduceat(np.where(exact == np.repeat(least, np.diff(first, append=len(row))), entry, len(entries)), first)
    return index, least, taken + len(row)


def _coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts) entries and squared distances. books: parts x entries x width."""
    width = books.shape[2]
    index, error = np.empty((len(x), PARTS), np.int64), np.empty((len(x), PARTS), np.int64)
    for at in range(0, len(x), CHUNK):
        for p in range(PARTS):
            index[at : at + CHUNK, p], error[at : at + CHUNK, p], _ = nearest(x[at : at + CHUNK, p * width : (p + 1) * width], books[p])
    return index, error


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    _, k, width = books.shape

    @released
    def sums(batches):
        count, total = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), np.int64)
        for batch in batches:
            x = integers(matrix(batch["vec"], PARTS * width)[1])
            index, _ = _coded(x, books)
            for p in range(PARTS):
                count[p] += np.bincount(index[:, p], minlength=k)
                np.add.at(total[p], index[:, p], x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(count)
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry])]
        columns += [pa.array(total[part, entry, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    schema = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(width))
    whole = rows.select("vec").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for r in whole.collect():  # PARTS x ENTRIES rows at most
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def codebooks(rows: DataFrame, dims: int) -> np.ndarray:
    """parts x entries x width. rows: vec_id and vec."""
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components can't be cut into {PARTS} equal parts")
    first = rows.filter(F.size("vec") == dims).orderBy(F.asc_nulls_last("vec_id"), "vec").limit(ENTRIES).collect()
    x = integers(np.array([r["vec"] for r in first], dtype=np.float64).reshape(len(first), dims))
    books = x.reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        books = _moved(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_rows(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with code (two hex digits a part) and error in place of vec."""
    dims = PARTS * books.shape[2]
    others = [f for f in rows.schema.fields if f.name != "vec"]

    @released
    def coded(batches):
        for batch in batches:
            whole, values = matrix(batch["vec"], dims)
            index, error = _coded(integers(values), books)
            text, sums = np.full(len(whole), None, object), np.zeros(len(whole), np.int64)
            text[whole] = ["".join(f"{i:02x}" for i in r) for r in index.tolist()]
            sums[whole] = error.sum(axis=1)
            columns = [batch[f.name] for f in others] + [pa.array(text, pa.string()), pa.array(sums, mask=~whole)]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in others], "code", "error"])

    return rows.mapInArrow(coded, StructType([*others, StructField("code", StringType()), StructField("error", LongType())]))


def code_compression(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256. rows: vec_id, embedding, label.

    Sums by label are written before they are joined, so that a label with a third of the rows can be cut into several
    tasks.
    """
    kept = usable(rows, "vec_id", "label")
    dims = dimension(kept)
    if dims is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = codebooks(kept, dims)
    coded = materialise(code_rows(kept, books), "codes")
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    told = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_code_compression(spark, sf_dir):
    return code_compression(embeddings(spark, sf_dir))


def _sql() -> str:
    """The rounds as DuckDB SQL; squared distances by products of doubles, which are exact for these integers."""
    near = """SELECT r.id, r.p, min_by(b.e, (r.q - 2 * list_inner_product(r.v, b.v) + b.q, b.e)) AS e, min(r.q - 2 * list_inner_product(r.v, b.v) + b.q) AS d FROM parts r JOIN b{0} b ON r.p = b.p GROUP BY r.id, r.p"""
    square = "list_inner_product(v, v) AS q"
    out = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS (SELECT id, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS v FROM kept, range({PARTS}) t(p)),
parts AS MATERIALIZED (SELECT *, {square} FROM cut),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v, q FROM parts WHERE id <= {ENTRIES}),\n"""
    for i in range(ROUNDS):
        out += f"""n{i} AS MATERIALIZED ({near.format(i)}),
m{i} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT r.p, n.e, i, floor(sum(r.v[i]) / count(*)) AS m FROM n{i} n JOIN parts r USING (id, p), range(1, len(r.v) + 1) t(i) GROUP BY r.p, n.e, i) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, v, {square} FROM (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (p, e))),\n"""
    return out + f"""last AS ({near.format(ROUNDS)}),
codes AS (SELECT id, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (id), book"""


SQL = _sql()
