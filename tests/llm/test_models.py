import math
import sys
import zlib
from collections import Counter
from itertools import product
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import cases
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import lang_id, lattice_lm, toxicity
from gaugeworks.llm.common import fold, vocabulary_path

DIR = "/root/testdata/sf0.01"


def segmentations(pieces, text):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(pieces, text[n:]):
                yield [text[:n], *rest]


def test_lattice_sums_all_segmentations():
    trie = lattice_lm.pieces_of(vocabulary_path("piece_bpe_32k.model"))
    number = {p: i for i, p in enumerate(trie.pieces)}
    words = [b"the", b"a", "é".encode(), b"thing", b"x1", b"\xff"]
    sums = lattice_lm.marginals(trie, trie.start, words)
    uses = np.zeros(len(number))
    for w, got in zip(words, sums):
        paths = [[number[p] for p in s] for s in segmentations(number, b" " + w)]
        weights = [math.exp(trie.start[p].sum()) for p in paths]
        assert math.exp(got) == pytest.approx(sum(weights), rel=1e-9)
        for p, x in zip(paths, weights):
            for i in p:
                uses[i] += 3 * x / sum(weights)
    assert np.allclose(lattice_lm.expectation(trie, trie.start, lattice_lm.bundles(words, np.full(len(words), 3.0)))[0], uses)
    assert lattice_lm.expectation(trie, trie.start, lattice_lm.bundles(words, np.full(len(words), 3.0)))[1] == pytest.approx(3 * sums.sum())
    long, count = [b"ab" * 400], np.array([2.0])
    told = lattice_lm.marginals(trie, trie.start, long)[0], lattice_lm.expectation(trie, trie.start, lattice_lm.bundles(long, count))
    assert told[1][1] == pytest.approx(2 * told[0])
    bundle = next(lattice_lm.bundles(words, np.arange(1.0, len(words) + 1)))
    edges = list(lattice_lm._edges(trie, *bundle[:2]))
    for a, b in zip(lattice_lm._products(edges, np.exp(trie.start), bundle), lattice_lm._sums(edges, trie.start, bundle)):
        assert np.allclose(a, b)
    short = lattice_lm.LONGEST
    try:
        lattice_lm.LONGEST = 1000
        assert lattice_lm.marginals(trie, trie.start, long)[0] == pytest.approx(told[0])
        assert np.allclose(lattice_lm.expectation(trie, trie.start, lattice_lm.bundles(long, count))[0], told[1][0])
    finally:
        lattice_lm.LONGEST = short


def test_scores_against_all_segmentations(spark):
    """score and word_score of a small table by listing every segmentation of every word, learning included."""
    rows = [(0, "the cat"), (1, "The hat a"), (2, "the the x1"), (3, None), (4, ""), (5, "cat zq"), (6, "a\tthe  cat\n"), (7, "é a")]
    trie = lattice_lm.pieces_of(vocabulary_path("piece_bpe_32k.model"))
    number = {p: i for i, p in enumerate(trie.pieces)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    split = {i: (t or "").encode().lower().split() for i, t in rows}
    c = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    paths = {w: [[number[p] for p in s] for s in segmentations(number, b" " + w)] for w in c}

    def next_chances(uses):
        fitted = uses + lattice_lm.PRIOR * len(number) * np.exp(trie.start)
        total = fitted.sum() + ends + lattice_lm.PRIOR
        return fitted / total, (ends + lattice_lm.PRIOR) / total

    (chance, end), before, done = next_chances(np.zeros(len(number))), -math.inf, 0
    for _ in range(8):
        uses, now = np.zeros(len(number)), ends * math.log10(end)
        for w, k in c.items():
            shares = np.array([math.prod(chance[p]) for p in paths[w]])
            now += k * math.log10(shares.sum())
            for p, x in zip(paths[w], shares / shares.sum()):
                for i in p:
                    uses[i] += k * x
        (chance, end), done = next_chances(uses), done + 1
        if now / (sum(c.values()) + ends) - before < 0.01:
            break
        before = now / (sum(c.values()) + ends)
    assert 2 < done <= 8
    assert chance.sum() + end == pytest.approx(1)
    inside = {w: sum(math.prod(chance[number[p]] for p in s) for s in segmentations(number, b" " + w)) for ws in split.values() for w in ws}
    n, v = sum(c.values()) + ends, len(c) + 1
    once, twice = (sum(k == x for k in c.values()) for x in (1, 2))
    d = min(once / (once + 2 * twice), 0.95) if once and twice else 0.5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = {r["doc_id"]: r for r in lattice_lm.lattice_scores(df, fold(10) == 0).collect()}
    for i, ws in split.items():
        assert told[i]["score"] == pytest.approx(sum(math.log10(inside[w]) for w in ws) + math.log10(end))
        want = sum(math.log10(max(c[w] - d, 0) / n + d * v / n * inside[w]) for w in ws) + math.log10(max(ends - d, 0) / n + d * v / n * end)
        assert told[i]["word_score"] == pytest.approx(want)


def test_lattice_remembers_within_bounds():
    trie = lattice_lm.pieces_of(vocabulary_path("piece_bpe_32k.model"))
    lattice = lattice_lm.Lattice(vocabulary_path("piece_bpe_32k.model"), trie.start.tobytes(), remembered=1000)
    for k in range(20):
        words = [f"word{j}".encode() for j in range(k, k + 10)]
        assert np.allclose(lattice.marginals(words), lattice_lm.marginals(trie, trie.start, words)) and lattice.held < 4000


@pytest.mark.parametrize("which", ["cases", "nothing", "held out only"])
def test_base_scores(spark, which):
    df = cases.docs(spark) if which == "cases" else cases.empty(spark)
    if which == "held out only":
        ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
        df = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    rows = df.select("doc_id", "text").collect()
    split = [(r["text"] or "").encode().lower().split() for r in rows]
    held = [zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    c = Counter()
    for w, h in zip(split, held):
        if not h:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r, w, h in zip(rows, split, held):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]) if n else 0.0
        want[(r["doc_id"], h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(base, 3))] += 1
    told = lattice_lm.lattice_scores(df, fold(10) == 0).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in told) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in told)


def test_kneser_ney_is_normalised():
    samples = [Counter({"abab": 3, "ba": 2, "abc": 1}), Counter({"cc": 5, "cab": 1})]
    models = lang_id.Models(["x", "y"], samples, order=3)
    alphabet = ["a", "b", "c"]
    for context in ("", "a", "ab", "cc", "ba"):
        ends = models.word_scores([context])
        # P(word continues with ch) from ratios of prefix probabilities; the end mark takes the rest.
        total = np.exp(ends)
        prefix = {}
        for ch in alphabet:
            prefix[ch] = np.exp(models.word_scores([context + ch]))
        assert (total > 0).all() and all((p > 0).all() for p in prefix.values())
    # All words up to length 7 hold nearly all of the probability that the alphabet's uniform floor leaves.
    sums = np.zeros(2)
    for n in range(0, 8):
        sums += np.exp(models.word_scores(["".join(w) for w in product(alphabet, repeat=n)] if n else [""])).sum(axis=0)
    assert (sums <= 1 + 1e-9).all() and (sums > 0.5).all()


def test_language_id(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    from gaugeworks.llm.lang_id import op6_lang_id

    told = op6_lang_id(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = told[told.held_out]
    assert len(told) == docs.count() and (held.lang_pred == held.lang).mean() > 0.98 and held.rejected.mean() < 0.02
    assert told.score.between(0, 1).all()


def test_language_id_cases(spark):
    df = cases.docs(spark)
    model = lang_id.identifier(df.filter(fold(3) != 1))
    told = lang_id.identified(df, model)
    assert told.columns[: len(df.columns)] == df.columns
    for r in told.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["_gw_lang"] == "und") == (not letters) and 0 <= r["_gw_score"] <= 1 and (letters or r["_gw_rejected"])
    nothing = lang_id.identifier(cases.empty(spark))
    assert {r["_gw_lang"] for r in lang_id.identified(df, nothing).collect()} == {"und"} and lang_id.identified(cases.empty(spark), model).count() == 0


def slow_kneser_ney(samples, word, language, order, d=0.75):
    """Natural log-probability of a word by the textbook recursion over dictionaries of strings."""
    marked = {lang: {"\x02" + w + "\x02": k for w, k in c.items()} for lang, c in samples.items()}
    letters = {ch for c in samples.values() for w in c for ch in w}
    counts = [Counter() for _ in range(order + 1)]
    for w, k in marked[language].items():
        for end in range(1, len(w)):
            for n in range(1, min(order, end + 1) + 1):
                if n == order or n == end + 1:  # highest order, or nothing can stand to the left
                    counts[n][w[end + 1 - n : end + 1]] += k
    for n in range(1, order):
        for gram in {w[end - n : end + 1] for w in marked[language] for end in range(n, len(w))}:
            counts[n][gram[1:]] += 1

    def chance(context, ch):
        n = len(context) + 1
        mine = {g: k for g, k in counts[n].items() if g[:-1] == context}
        lower = chance(context[1:], ch) if context else 1.0 / max(2, len(letters) + 2)
        if not mine:
            return lower
        total = sum(mine.values())
        return max(mine.get(context + ch, 0) - d, 0) / total + min(d * len(mine) / total, 1.0) * lower

    w = "\x02" + word + "\x02"
    return sum(math.log(chance(w[max(0, at - order + 1) : at], w[at])) for at in range(1, len(w)))


def test_kneser_ney_against_the_slow_recursion():
    samples = {"a": Counter({"the": 5, "then": 2, "hat": 1, "a": 7}), "b": Counter({"der": 4, "den": 3, "hut": 1, "\u00fc": 2})}
    words = ["the", "hen", "der", "a", "\u00fc", "zzz", "thethe", "x"]
    for order in (1, 2, 3, 4):
        told = lang_id.Models(["a", "b"], [samples["a"], samples["b"]], order).word_scores(words)
        for i, w in enumerate(words):
            assert told[i].tolist() == pytest.approx([slow_kneser_ney(samples, w, lang, order) for lang in "ab"])


def test_every_language_is_learned(spark):
    """No class is left out, however many there are and however rare or long their rows."""
    words = [chr(97 + i // 26) * 3 + chr(97 + i % 26) * 3 for i in range(150)]
    rows = [(1000 * i + k, f"l{i:03d}", f"{w} {w}") for i, w in enumerate(words) for k in range(3 if i else 400)]
    rows.append((999_999, "long", "qqxqq " * 30_000))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = lang_id.identifier(df, max_rows=200, min_rows=2)
    assert model.models.languages == sorted({r[1] for r in rows})
    told = {r["lang"] for r in lang_id.identified(df, model).filter("_gw_lang = lang").select("lang").distinct().collect()}
    assert told == {r[1] for r in rows}


def slow_logit(network, words):
    """One window, one word and one state at a time."""
    p, h = {k: v.astype(float) for k, v in network.p.items()}, toxicity.HIDDEN
    x = network.inputs(words)[0].astype(float)
    states = {}
    for s, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        state = np.zeros(h)
        for t in order:
            own = x[t] @ p["w" + s] + p["c" + s]
            pushed = state @ p["u" + s]
            z, r = (1 / (1 + np.exp(-(own[k : k + h] + pushed[k : k + h]))) for k in (0, h))
            new = np.tanh(own[2 * h :] + r * pushed[2 * h :])
            state = (1 - z) * new + z * state
            states[s, t] = state
    both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(words))]
    weights = np.exp([v @ p["attend"] for v in both])
    return sum(w * (v @ p["out"]) for w, v in zip(weights / weights.sum(), both)) + p["bias"][0]


def test_scores_against_a_slow_network():
    """The largest logit over all overlapping windows, with short, full and many windows."""
    r = np.random.default_rng(3)
    vocabulary = {f"w{i}": i + 1 for i in range(20)}
    network = toxicity.Network(vocabulary, r.normal(0, 1, 21))
    texts = [" ".join(f"w{i}" for i in r.integers(0, 30, n)) for n in (1, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 3 * toxicity.WINDOW + 7)]
    told = toxicity.Scorer(network).largest(texts)
    for text, got in zip(texts, told):
        words = [toxicity.cleaned(w) for w in text.split()]
        want = max(slow_logit(network, words[a : a + toxicity.WINDOW]) for a in toxicity.windows_of(len(words)))
        assert got == pytest.approx(want, abs=1e-4)


def test_gradient():
    r = np.random.default_rng(0)
    net = toxicity.Network({"bad": 1, "good": 2}, np.array([0, 1.0, -1.0]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["", "bad", "good", "other", "abc"]
    ids = r.integers(1, 5, (3, toxicity.WINDOW))
    ids[0, 20:] = 0
    target, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        x = np.concatenate([(y := net.inputs(words)[0]) @ net.p["wf"] + net.p["cf"], y @ net.p["wb"] + net.p["cb"]], axis=1)
        z = net.logits(x.astype(np.float64), ids, False).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() / weight.sum())

    g = net.gradient(words, ids, target, weight)
    for k in ("out", "attend", "uf", "wb", "cf", "word", "bias", "char"):
        flat = np.argsort(-np.abs(g[k]).ravel())[:2]
        for at in flat:
            place = np.unravel_index(at, g[k].shape)
            old = net.p[k][place]
            net.p[k][place] = old + 1e-2
            up = loss()
            net.p[k][place] = old - 1e-2
            down = loss()
            net.p[k][place] = old
            assert g[k][place] == pytest.approx((up - down) / 2e-2, rel=0.08, abs=2e-5), k


def test_toxicity_held_out(spark):
    told = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    x = told.merge(labels, on="doc_id")
    x = x[x.held_out]
    assert len(told) == 10_000 and told.score.between(0, 1).all() and ((told.score >= 0.3) == (told.predicted == 1)).all()
    caught, wrong = x[x.toxic == 1].predicted.mean(), x[x.toxic == 0].predicted.mean()
    assert caught > 0.8 and wrong < 0.03


def test_toxicity_cases(spark):
    df = cases.docs(spark)
    labels = df.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1).when(F.col("doc_id") % 7 != 0, 0).alias("toxic"))
    scorer = toxicity.fitted(df, labels)
    told = toxicity.toxicity(df, fold(4) == 2, scorer).collect()
    assert len(told) == df.count() and all(0 <= r["score"] <= 1 for r in told)
    one = toxicity.fitted(df, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.toxicity(df, fold(4) == 2, one).collect()} == {0.0}
    assert toxicity.toxicity(cases.empty(spark), fold(4) == 2, scorer).count() == 0
    assert toxicity.windows_of(10) == [0] and toxicity.windows_of(33) == [0, 1] and toxicity.windows_of(80) == [0, 16, 32, 48]
