import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import exact_dedup, repeats, shingle_join, windows
from gaugeworks.llm.common import keep_rows

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def norm(t):
    return (t or "").encode().translate(FOLD)


@pytest.mark.parametrize("capacity, combine", [(1 << 26, 1 << 25), (3000, 2000)])
def test_exact(spark, capacity, combine):
    df = cases.docs(spark).repartition(3)
    rows = df.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    told = exact_dedup.exact_dedup(df, capacity, combine).collect()
    assert len(told) == len(rows) and sum(r["kept"] for r in told) == len(groups)
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in told:
        ids = by_sha[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert r["group_size"] == len(ids) and r["keep_id"] == best and (not r["kept"] or r["doc_id"] == best)
    kept = keep_rows(df, exact_dedup.exact_dedup(df).filter("kept"))
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0


def test_directory_doubles():
    tree = exact_dedup.Directory(2)
    assert tree.split(1) == (4, 5) and tree.depth == 3 and tree.slots == [0, 0, 4, 5, 2, 2, 3, 3] and tree.local[4] == 3
    tree.split(0)
    assert tree.depth == 3 and tree.slots == [6, 7, 4, 5, 2, 2, 3, 3]
    tree.split(5)
    assert tree.depth == 4 and len(tree.slots) == 16 and tree.slots[6:8] == [8, 9]
    for key in (0, 1, -1, (1 << 62) + 5, -(1 << 63), 7 << 59):
        bucket = tree.find(key)
        assert (key % (1 << 64)) >> (64 - tree.local[bucket]) == tree.prefix[bucket]
    assert exact_dedup.Directory(0).find(-5) == 0


def test_index_splits_overfull_buckets(spark):
    """Keys that crowd under a few leading bits; every entry is in one file, that of the bucket the directory names."""
    rows = [(k, i, 1, False, i, i, 10, b"0123456789") for i, k in enumerate([*(j << 48 for j in range(64)), *(-(j << 52) - 1 for j in range(20)), *[77] * 9])]
    df = spark.createDataFrame(rows, "key long, entry_id long, n long, top_null boolean, top_doc long, top_uid long, n_bytes long, text binary")
    tree, tables = exact_dedup.build_index(df, 100)
    told = [r for t in tables for r in t.collect()]
    assert len(told) == len(rows) and len(tables) > 3 and tree.depth == max(tree.local) > 4
    held = Counter()
    for r in told:
        assert tree.find(r["key"]) == r["bucket"]
        held[r["bucket"]] += r["n_bytes"]
    keys = defaultdict(set)
    for r in told:
        keys[r["bucket"]].add(r["key"])
    assert all(n <= 100 or len(keys[b]) == 1 or tree.local[b] == exact_dedup.MAX_DEPTH for b, n in held.items())


def test_a_text_that_every_task_meets(spark):
    """Entries of one text beyond the capacity, and texts that collide nowhere."""
    rows = [(i, "Same text " * 30 if i % 3 else f"own {i}", None) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    told = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df, capacity=600, combine_bytes=200).collect()}
    assert told == {i: (89, 60, i == 89) if i % 3 else (i, 1, True) for i in range(90)}


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize("at_once, parts", [(1 << 20, 2), (1 << 20, 9), (700, 2)])
def test_repeats(spark, at_once, parts):
    df = cases.docs(spark).repartition(parts)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, gone in zip(rows, texts, brute_repeats(texts, repeats.LENGTH)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        want[(i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    told = repeats.remove_repeats(df, at_once=at_once)
    assert told.columns[: len(df.columns)] == df.columns
    got = Counter((r["doc_id"], r["_gw_bytes"], r["_gw_removed"], r["_gw_spans"], r["_gw_sha256"]) for r in told.collect())
    assert got == want


def test_repeats_short_period(spark):
    """Windows that overlap themselves."""
    df = spark.createDataFrame([(1, "ab" * 150), (2, "c" * 199), (3, "d" * 200), (4, "e" * 201)], "doc_id long, text string")
    told = {r["doc_id"]: (r["_gw_removed"], r["_gw_spans"]) for r in repeats.remove_repeats(df).collect()}
    assert told == {1: (300, 1), 2: (0, 0), 3: (0, 0), 4: (201, 1)}
    assert repeats.remove_repeats(cases.empty(spark)).count() == 0


def test_window_minima():
    r = np.random.default_rng(0)
    v = r.integers(0, 1 << 62, 500).astype(np.uint64)
    assert windows.window_minima(v, 7).tolist() == [i + int(np.argmin(v[i : i + 7])) for i in range(494)]


def test_anchors_depend_on_their_window_alone():
    """Values that agree in their upper bits, in buffers of very different length."""
    r = np.random.default_rng(1)
    v = (r.integers(5, 9, 200).astype(np.uint64) << np.uint64(40)) | r.integers(0, 1 << 10, 200).astype(np.uint64)
    want = windows.window_minima(v, 50)
    for n in (1, 1000, 1 << 20):
        rest = np.full(n, (1 << 62) + 5, np.uint64)
        assert (windows.window_minima(np.concatenate([v, rest]), 50)[:151] == want).all()
        assert (windows.window_minima(np.concatenate([rest, v]), 50)[n:] - n == want).all()


@pytest.mark.parametrize("at_once", [1 << 20, 300, 64])
def test_runs_of_a_cut_text(at_once):
    """A text cut into pieces has the same windows under the same digits."""
    data = np.frombuffer(cases.texts()[0].encode() * 3 + b"ab" * 300, np.uint8)
    starts, ends = np.array([0, 90, 100]), np.array([90, 100, len(data)])
    want = {}
    for text, place, n, digit, gram in zip(*(c.tolist() for c in windows.super_windows(data, starts, ends, 60, 12))):
        want.update({(text, place + k): (digit, gram) for k in range(n)})
    got = {}
    for text, place, n, digit, gram in zip(*(c.tolist() for c in windows.super_windows(data, starts, ends, 60, 12, at_once))):
        got.update({(text, place + k): (digit, gram) for k in range(n)})
    assert got == want and len(got) == 31 + (len(data) - 100 - 59)


def test_parts_share_four_fifths():
    place, n, gram = np.array([0, 500, 900]), np.array([161, 7, 1]), np.array([160, 560, 910])
    run, first, size, shared = repeats._parts(place, n, gram, 40)
    got = [(r, w) for r, a, k in zip(run.tolist(), first.tolist(), size.tolist()) for w in range(a, a + k)]
    assert got == [(r, w) for r in range(3) for w in range(place[r], place[r] + n[r])]
    assert (shared >= first + size - 1).all() and (shared + 161 <= first + 200).all() and (size <= 40).all()
    assert (run == 0).sum() == 5


def test_groups():
    high, low = np.array([5, 3, 5, 5, 3, 9], np.uint64), np.array([1, 2, 7, 1, 2, 1], np.uint64)
    number, first, count = windows.grouped(high, low)
    assert number.tolist() == [1, 0, 2, 1, 0, 3] and first.tolist() == [1, 0, 2, 5] and count.tolist() == [2, 2, 1, 1]


def test_passage_in_many_contexts(spark):
    """One passage in hundreds of documents that share nothing else."""
    import random

    r = random.Random(9)
    passage = cases.words(r, 60)
    texts = [(cases.words(r, 30) + " " + passage + " " + cases.words(r, 30)).encode() for _ in range(400)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    told = {r["doc_id"]: r["_gw_removed"] for r in repeats.remove_repeats(df).collect()}
    assert told == {i: sum(gone) for i, gone in enumerate(brute_repeats(texts, 200))}


def brute_join(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = norm(t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], links


@pytest.mark.parametrize("leaf, chunk", [(1000, 500), (3, 2)])
def test_shingle_join(spark, leaf, chunk):
    df = cases.docs(spark).repartition(2)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    roots, links = brute_join(rows)
    told = shingle_join.shingle_join(df, leaf=leaf, chunk=chunk, recall=0.99999)
    want = Counter()
    for k, root in enumerate(roots):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == root]
        want[(rows[k][0], min((i for i in ids if i is not None), default=None), links[k])] += 1
    got = told.collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    assert sum(r["keeper"] for r in got) == len(set(roots))
    assert keep_rows(df, told.filter("keeper")).count() == len(set(roots))


def test_shingle_join_empty(spark):
    assert shingle_join.shingle_join(cases.empty(spark)).count() == 0
    few = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in shingle_join.shingle_join(few).collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0)}


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (5, 5), (4, 9)], "u long, v long")
    assert {(r["set"], r["root"]) for r in shingle_join.components(edges).collect()} == {(i, 1) for i in (2, 3, 4, 8, 9)}


def test_chosen_paths_recall(spark):
    """Pairs just above the threshold, in nodes that must split."""
    import random

    r = random.Random(5)
    rows = []
    for k in range(60):
        w = cases.words(r, 100).split()
        v = w[:91] + cases.words(r, 9).split()  # 87 of 105 shingles shared
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = {x["doc_id"]: x["class_id"] for x in shingle_join.shingle_join(df, leaf=2).collect()}
    assert sum(told[2 * k + 1] == 2 * k for k in range(60)) >= 59


def test_cells(spark):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, 30)).astype(np.uint64) for _ in range(12)]
    x, y = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert shingle_join.shared_counts(sets, x, y).tolist() == want and shingle_join.shared_counts(sets, x[:3], y[:3]).tolist() == want[:3]
    assert F  # noqa: B018
