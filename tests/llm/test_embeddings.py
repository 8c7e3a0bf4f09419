"""Operators on vectors: plain numpy or SQL beside them, hot vectors, and tables with everything that goes wrong."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from gaugeworks.llm import axis_search, code_compression, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, vec array<int>, `key` string, code int, n string, cell long, ids string, axis int"
DIR = "/root/testdata/sf0.01"


def table(spark, rows):
    """rows: (vec_id, embedding, label); the other columns clash with names that operators use."""
    return spark.createDataFrame([(*r, [1], "k", 3, "n", 9, "i", 2) for r in rows], SCHEMA)


def awkward(dims=8, n=300, seed=5):
    r = np.random.default_rng(seed)
    made = [(i, r.normal(0, 0.4, dims).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    hot = made[7][1]
    made += [(1000 + i, hot, 1) for i in range(150)] + [made[3], made[3]]
    made += [(2000, None, 1), (2001, [None] * dims, 1), (2002, [math.nan] + [0.5] * (dims - 1), 2), (2003, [math.inf] * dims, None), (2050, [0.0] * dims, 1), (2051, [-0.0] * dims, 1)]
    return made + [(None, hot, None), (2100, [0.25] * (dims + 1), 4), (2101, [], None)]


def usable(rows, dims=8):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(c is not None and math.isfinite(c) for c in r[1])]


def odd(rows, dims=8):
    return [r for r in rows if r[1] is not None and len(r[1]) != dims and all(c is not None and math.isfinite(c) for c in r[1])]


def brute_codes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 1024).astype(np.int64)
    w = x.shape[1] // 4
    parts = [x[:, p * w : (p + 1) * w] for p in range(4)]
    books = [p[:256].copy() for p in parts]

    def assign():
        d = [((p[:, None, :] - b[None]) ** 2).sum(axis=2) for p, b in zip(parts, books)]
        return [m.argmin(axis=1) for m in d], sum(m.min(axis=1) for m in d)

    for _ in range(4):
        at, _ = assign()
        for p, b, a in zip(parts, books, at):
            for e in set(a.tolist()):
                own = p[a == e]
                b[e] = [int(c) // len(own) for c in own.sum(axis=0)]
    at, error = assign()
    label = defaultdict(int)
    for r, e in zip(rows, error.tolist()):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()
    return Counter((r[0], "".join(f"{a[i]:02x}" for a in at), int(error[i]), label[r[2]], digest) for i, r in enumerate(rows))


def test_codes_equal_brute_force(spark):
    rows = awkward()
    told = Counter(tuple(r) for r in code_compression.code_compression(table(spark, rows).repartition(5)).collect())
    want = brute_codes(usable(rows))
    digest, labels = next(iter(want))[4], {r[2]: None for r in rows}
    for r in usable(rows):
        labels[r[2]] = next(k[3] for k in want if k[0] == r[0])
    assert told == want + Counter((r[0], None, None, labels.get(r[2]), digest) for r in odd(rows))


def test_codes_of_few_or_no_rows(spark):
    rows = [(5, [0.1, 0.2, 0.3, 0.4], 1), (4, [0.1, 0.2, 0.3, 0.4], None), (6, [-0.5, 0.2, 9.0, 0.4], 1)]
    told = Counter(tuple(r) for r in code_compression.code_compression(table(spark, rows)).collect())
    assert told == brute_codes(rows)
    assert code_compression.code_compression(table(spark, rows).filter("vec_id < 0")).count() == 0
    with pytest.raises(ValueError):
        code_compression.code_compression(table(spark, [(1, [0.5] * 6, 1)])).count()


def test_bounds_keep_the_nearest(spark):
    """Ties, equal entries and far entries: always the lowest index of the nearest; and bounds leave out most entries of clustered parts."""
    r = np.random.default_rng(1)
    for spread in (1, 40, 2000):
        centres = r.integers(-3000, 3000, (40, 16))
        x = centres[r.integers(0, 40, 500)] + r.integers(-spread, spread + 1, (500, 16))
        entries = np.concatenate([x[:100], x[:100], centres])
        index, least, taken = code_compression.nearest(x, entries)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        assert spread == 2000 or taken < 0.3 * d.size


def test_codes_equal_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    want = duck.sql(code_compression.SQL).df().sort_values("vec_id").reset_index(drop=True)
    told = code_compression.op11_code_compression(spark, DIR).toPandas().sort_values("vec_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(told[want.columns], want, check_dtype=False)


def brute_neighbours(rows, k=5, every=50):
    rows = sorted({(r[0], tuple(r[1])) for r in rows if r[0] is not None and any(r[1])})
    x = np.array([r[1] for r in rows], dtype=np.float64)
    size = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, r in enumerate(rows):
        if r[0] % every == 0:
            score = x @ x[i] / (size * size[i])
            out[r[0]] = sorted((-round(float(s), 9), o[0]) for s, o in zip(score, rows) if o[0] != r[0])[:k]
    return out


def test_neighbours_equal_brute_force_when_all_axes_are_asked(spark):
    rows = awkward()
    want = brute_neighbours(usable(rows))
    for held in (axis_search.HELD, 160):  # one slice an axis, and slices of 20 vectors
        told = defaultdict(list)
        for r in axis_search.nearest(table(spark, rows).repartition(4), recall=1.0, sample=10_000, held=held).orderBy("query_id", "rank").collect():
            told[r["query_id"]].append((r["vec_id"], round(r["score"], 9), r["rank"]))
        assert {q: [(-s, v) for v, s, _ in x] for q, x in told.items()} == want
        assert all([n for _, _, n in x] == list(range(1, len(x) + 1)) for x in told.values())


def test_recall_of_the_query(spark):
    for sf_dir in (DIR, "/root/testdata/sf0.1"):
        e = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
        want = brute_neighbours(list(zip(e["vec_id"], e["embedding"])))
        told = axis_search.op12_axis_search(spark, sf_dir).toPandas()
        got = set(zip(told["query_id"], told["vec_id"]))
        pairs = {(q, v) for q, x in want.items() for _, v in x}
        assert len(got) == len(told) == len(pairs) and len(got & pairs) >= 0.9 * len(pairs)


def test_few_candidates(spark):
    vec = lambda *x: list(map(float, x))
    rows = [(0, vec(1, 0, 0), 1), (1, vec(0, 1, 0), 1), (50, vec(-1, 0, 0), 1), (3, vec(2, 0, 0), 1)]
    told = [tuple(r) for r in axis_search.nearest(table(spark, rows)).orderBy("query_id", "rank").collect()]
    assert told == [(0, 1, 3, 1.0), (0, 2, 1, 0.0), (0, 3, 50, -1.0), (50, 1, 1, 0.0), (50, 2, 0, -1.0), (50, 3, 3, -1.0)]
    assert axis_search.nearest(table(spark, rows[:1])).count() == 0 and axis_search.nearest(table(spark, rows).filter("vec_id = 1")).count() == 0
    assert axis_search.nearest(table(spark, rows).filter("false")).count() == 0


def test_queries_short_of_candidates_are_searched_exactly(spark, monkeypatch):
    rows = usable(awkward(n=200))[:200]
    monkeypatch.setattr(axis_search, "fitted_probes", lambda *a: 1)
    told = axis_search.nearest(table(spark, rows), tables=1).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in told} == {q: 5 for q in range(0, 200, 50)}


def test_axes_are_a_rotation():
    x = np.random.default_rng(2).normal(size=(50, 13))
    for t in range(3):
        r = axis_search.rotated(x, t)
        assert np.allclose((r * r).sum(axis=1), (x * x).sum(axis=1)) and np.allclose(r @ r.T, x @ x.T)
        assert (axis_search.probes(x, t)[:, 0] == axis_search.axes(x, t)).all()
        assert (axis_search.axes(-x, t) == (axis_search.axes(x, t) + 16) % 32).all()


def brute_whitening(rows):
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    apart = fit - sums / n
    e, v = np.linalg.eigh(apart.T @ apart / n)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ v / np.sqrt(e), e / np.trace(apart.T @ apart / n)


def test_whitening_equals_brute_force(spark):
    rows = awkward()
    told = whitening.whitening(table(spark, rows).repartition(4)).collect()
    n, apart, w, share = brute_whitening(usable(rows))
    by = defaultdict(list)
    for r in told:
        by[r["component"]].append(r)
    assert set(by) == {None, 1, 2, 3, 4} and {r["n"] for r in told} == {n} and all(r["identity_error"] <= 1e-9 for r in told)
    assert sorted(r["vec_id"] for r in by.pop(None)) == [2100, 2101]
    for c, own in by.items():
        key = lambda v: tuple(sorted(v, key=str))
        given = key((r["vec_id"], r["deviation"], round(r["whitened"], 7) + 0.0) for r in own)
        options = [key((r[0], int(d), round(sign * x, 7) + 0.0) for r, d, x in zip(usable(rows), apart, w[:, c - 1])) for sign in (1, -1)]
        assert any(len(given) == len(o) and all(a[0] == b[0] and a[1] == b[1] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(given, o)) for o in options)
        assert all(abs(r["explained"] / share[c - 1] - 1) < 1e-9 for r in own)


def test_whitening_of_little(spark):
    rows = [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)]
    assert whitening.whitening(table(spark, rows)).count() == 0 and whitening.whitening(table(spark, rows).filter("false")).count() == 0
    told = whitening.whitening(table(spark, [*rows, (3, [1.5, 0.25], None)])).collect()  # one component has variance
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in told) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0)]


def test_deviations_beyond_64_bits():
    x = np.array([[2**40, -(2**40)], [1, 2]])
    n, sums = 10**6, [2**40 + 1, 2 - 2**40]
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
