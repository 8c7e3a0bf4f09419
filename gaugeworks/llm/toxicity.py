"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector (if the learning rows tell enough about it) and as the mean of the vectors
of its character trigrams. Two gated recurrent layers read a window of WINDOW words in either direction,
attention pools their states, and a linear layer gives the window's logit. A document's windows overlap
by half and cover the whole text; its score is the calibrated largest logit. What a word contributes to
the gates is computed once per distinct word.

Learning: at most `max_rows` labelled rows (half of them toxic if there are as many, dealt by a hash of
the id, each of at most `max_chars` characters) are brought to the driver. Words whose frequency differs
between the classes beyond chance have vectors, which start with the log-odds; the windows that learn are each document's one or two with the highest log-odds and, for
rows that are not toxic, a random one. A fifth of the rows is set aside for the logistic calibration,
where rows count by how many of their class the sample left out.

Cases: a null or empty text is one window of padding and has a score; repeated rows are scored alike;
labels repeated for an id count once (the larger value); labels that are null are ignored; with fewer than
two classes to learn from every score is the share of toxic labels; an empty table gives an empty result;
columns other than doc_id and text are ignored, so lang and source cannot matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, fold

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 8, 8, 4096
MARK = "\x02"
THRESHOLD = 0.3


def cleaned(token: str) -> str:
    return token if token.isalnum() else "".join(c for c in token if c.isalnum())


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each character of non-empty words, and where each word starts."""
    points = np.array([*map(ord, MARK + MARK.join(words) + MARK)], np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(np.arange(len(words)) + 1, sizes) + np.arange(sizes.sum())
    h = (points[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[at + 1] * np.uint64(0xBF58476D1CE4E5B9))
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(52)).astype(np.int64) % BUCKETS, starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    """Parameters, the forward pass over windows, and the gradient."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary  # 0: any other word
        words = r.normal(0, 0.05, (len(odds), WORD_DIM))
        words[:, 0] = odds
        p = {"word": words, "char": r.normal(0, 0.05, (BUCKETS, CHAR_DIM))}
        for s in "fb":
            p["w" + s] = r.normal(0, 0.3, (d, 3 * h))
            p["u" + s] = r.normal(0, 0.3, (h, 3 * h))
            p["c" + s] = np.zeros(3 * h)
            p["w" + s][0, 2 * h] = 1.0  # one state starts by carrying the log-odds
            p["c" + s][:h] = -0.5
        p |= {"attend": r.normal(0, 0.1, 2 * h), "out": r.normal(0, 0.1, 2 * h), "bias": np.zeros(1)}
        p["attend"][[0, h]] = 1.0
        p["out"][[0, h]] = 1.0
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of distinct words (empty: padding or punctuation, all zero), with what they were made of."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        some = [w for w in words if w]
        place = np.array([i for i, w in enumerate(words) if w], np.int64)
        x = np.zeros((len(words), WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = self.p["word"][ids]
        buckets = starts = np.zeros(0, np.int64)
        if some:
            buckets, starts = trigrams(some)
            sizes = np.diff(np.append(starts, len(buckets)))
            x[place, WORD_DIM:] = np.add.reduceat(self.p["char"][buckets], starts) / sizes[:, None]
        if len(place) < len(words):
            x[[i for i, w in enumerate(words) if not w]] = 0
        return x, ids, buckets, starts

    def gates(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        x = self.inputs(words)[0]
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)

    def logits(self, table: np.ndarray, ids: np.ndarray, full: bool) -> np.ndarray:
        """Logits of windows given as rows of word numbers; 0 is padding, and full says there is none."""
        n, h = len(ids), HIDDEN
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        for s, cut, order in (("f", 0, range(WINDOW)), ("b", 3 * h, range(WINDOW - 1, -1, -1))):
            u, state = self.p["u" + s], np.zeros((n, h), np.float32)
            side = np.ascontiguousarray(table[:, cut : cut + 3 * h])
            at = 0 if s == "f" else h
            for t in order:
                own = side[ids[:, t]]
                pushed = state @ u
                zr = own[:, : 2 * h]
                zr += pushed[:, : 2 * h]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new = pushed[:, 2 * h :]
                new *= zr[:, h:]
                new += own[:, 2 * h :]
                np.tanh(new, out=new)
                fresh = new + zr[:, :h] * (state - new)
                state = fresh if full else np.where((ids[:, t] > 0)[:, None], fresh, state)
                states[t, :, at : at + h] = state
        e = states @ self.p["attend"]
        if not full:
            e = np.where(ids.T > 0, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        return np.einsum("tn,tn->n", a, states @ self.p["out"]) + self.p["bias"][0]

    def gradient(self, words: list[str], ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss. ids: windows as numbers into words, words[0] is padding."""
        p, h, n = self.p, HIDDEN, len(ids)
        x, word_ids, buckets, starts = self.inputs(words)
        live = (ids > 0)[:, :, None]
        kept, states = {}, {}
        for s, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            table, state = x @ p["w" + s] + p["c" + s], np.zeros((n, h), np.float32)
            kept[s], states[s] = {}, np.empty((WINDOW, n, h), np.float32)
            for t in order:
                own, pushed = table[ids[:, t]], state @ p["u" + s]
                z, r = sigmoid(own[:, :h] + pushed[:, :h]), sigmoid(own[:, h : 2 * h] + pushed[:, h : 2 * h])
                new = np.tanh(own[:, 2 * h :] + r * pushed[:, 2 * h :])
                kept[s][t] = (state, z, r, new, pushed[:, 2 * h :])
                state = np.where(live[:, t], new + z * (state - new), state)
                states[s][t] = state
        both = np.concatenate([states["f"], states["b"]], axis=2)
        e = np.where(ids.T > 0, both @ p["attend"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        value = both @ p["out"]
        logit = (a * value).sum(axis=0) + p["bias"][0]
        d = (sigmoid(logit) - target) * weight / weight.sum()
        da = a * (value - (a * value).sum(axis=0)) * d
        g = {"bias": np.array([d.sum()]), "out": np.einsum("tn,tnk->k", a * d, both), "attend": np.einsum("tn,tnk->k", da, both)}
        dboth = (a * d)[:, :, None] * p["out"] + da[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for s, order, at in (("f", range(WINDOW - 1, -1, -1), 0), ("b", range(WINDOW), h)):
            back, u = np.zeros((n, h), np.float32), p["u" + s]
            gu, dtable = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            for t in order:
                state, z, r, new, pushed = kept[s][t]
                back = back + dboth[t, :, at : at + h]
                out = back * live[:, t]
                dnew = out * (1 - z) * (1 - new * new)
                dz = out * (state - new) * z * (1 - z)
                dr = dnew * pushed * r * (1 - r)
                dpush = np.concatenate([dz, dr, dnew * r], axis=1)
                np.add.at(dtable, ids[:, t], np.concatenate([dz, dr, dnew], axis=1))
                gu += state.T @ dpush
                back = np.where(live[:, t], out * z + dpush @ u.T, back)
            dtable[0] = 0
            g["u" + s], g["w" + s], g["c" + s] = gu, x.T @ dtable, dtable.sum(axis=0)
            dx += dtable @ p["w" + s].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], word_ids, dx[:, :WORD_DIM] * np.array([bool(w) for w in words])[:, None])
        g["char"] = np.zeros_like(p["char"])
        if len(starts):
            sizes = np.diff(np.append(starts, len(buckets)))
            mine = dx[[i for i, w in enumerate(words) if w], WORD_DIM:] / sizes[:, None]
            np.add.at(g["char"], buckets, np.repeat(mine, sizes, axis=0))
        return g


class Scorer:
    """A trained network with its calibration; words' gates come from a bounded memory."""

    def __init__(self, network: Network | None, slope: float = 1.0, shift: float = 0.0, prior: float = 0.0):
        self.network, self.slope, self.shift, self.prior = network, slope, shift, prior

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def largest(self, texts: list[str], remembered: int = 400_000, chunk: int = 4096) -> np.ndarray:
        """The largest window logit of each text."""
        if not hasattr(self, "known") or len(self.known) > remembered:
            self.known: dict[str, int] = {}
            self.table = self.network.gates([""])
        split = [t.lower().split() for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known))
        if new:
            words = [cleaned(t) for t in new]
            known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, *(self.network.gates(words[a : a + 50_000]) for a in range(0, len(words), 50_000))])
        best = np.full(len(texts), -np.inf)
        full, rest, full_of, rest_of = [], [], [], []
        for i, tokens in enumerate(split):
            ids = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
            if len(ids) < WINDOW:
                rest.append(np.pad(ids, (0, WINDOW - len(ids))))
                rest_of.append(i)
                continue
            starts = np.array(windows_of(len(ids)))
            full.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts])
            full_of += [i] * len(starts)
        for rows, owners, whole in ((np.concatenate(full) if full else None, full_of, True), (np.stack(rest) if rest else None, rest_of, False)):
            if rows is not None:
                logits = np.concatenate([self.network.logits(self.table, rows[a : a + chunk], whole) for a in range(0, len(rows), chunk)])
                np.maximum.at(best, np.array(owners), logits)
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.slope * self.largest([t or "" for t in texts]) + self.shift).astype(np.float64)


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, by Newton steps with a little shrinkage."""
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        q = sigmoid(design @ theta)
        g = design.T @ (weight * (q - y)) + 1e-2 * (theta - [1.0, 0.0])
        hess = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, g)
        theta = theta - np.clip(step, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(rows: list[tuple[str, int]], left_out: tuple[float, float] = (1.0, 1.0), max_words: int = 4000, epochs: int = 3, batch: int = 256, seed: int = 7) -> Scorer:
    """rows: (text, label). left_out: rows of the table per row of the sample, for labels 0 and 1."""
    labels = np.array([y for _, y in rows])
    if not len(rows) or labels.min() == labels.max():
        return Scorer(None, prior=float(labels.mean()) if len(rows) else 0.0)
    tokens = [[cleaned(t) for t in text.lower().split()] for text, _ in rows]
    aside = np.arange(len(rows)) % 5 == 4 if len(rows) >= 500 else np.zeros(len(rows), bool)
    seen = {0: Counter(), 1: Counter()}
    for words, y, off in zip(tokens, labels.tolist(), aside.tolist()):
        if not off:
            seen[y].update(set(words) - {""})
    many = {y: max(1, int(((labels == y) & ~aside).sum())) for y in (0, 1)}

    def odds(w: str) -> tuple[float, float]:
        """Log-odds of a word, shrunk, and the likelihood ratio against its being as frequent in either class."""
        a, b = seen[1][w], seen[0][w]
        e = (a + b) * many[1] / (many[0] + many[1])
        ratio = 2 * ((a * math.log(a / e) if a else 0) + (b * math.log(b / (a + b - e)) if b else 0))
        return math.log((a + 0.5) / many[1] / ((b + 0.5) / many[0])) * (1 - 1 / (1 + 0.5 * (a + b))), ratio

    told = {w: odds(w) for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] >= 3}
    # As many words as there are to try, so strong must a word's ratio be.
    chosen = sorted((w for w in told if told[w][1] >= 2 * math.log(len(told) + 1)), key=lambda w: (-told[w][1], w))[:max_words]
    told = {w: told[w][0] for w in chosen}
    vocabulary = {w: i + 1 for i, w in enumerate(chosen)}
    network = Network(vocabulary, np.clip(np.array([0.0, *(told[w] for w in chosen)]), -3, 3), seed)
    # The windows that learn.
    r = np.random.default_rng(seed)
    picked, target, weight = [], [], []
    for words, y, off in zip(tokens, labels.tolist(), aside.tolist()):
        if off or not words:
            continue
        value = np.array([told.get(w, 0.0) for w in words])
        starts = windows_of(len(words))
        peak = np.array([value[s : s + WINDOW].max() for s in starts])
        best = np.argsort(-peak, kind="stable")[: 2 if y == 0 else 1].tolist()
        for k in dict.fromkeys([*best, *([int(r.integers(len(starts)))] if y == 0 else [])]):
            picked.append(words[starts[k] : starts[k] + WINDOW])
            target.append(y)
            weight.append(1.0)
    target, weight = np.array(target, np.float32), np.array(weight, np.float32)
    weight[target == 1] *= max(1.0, (target == 0).sum() / max(1, (target == 1).sum()) / 2)
    names = ["", *sorted({w for p in picked for w in p} - {""})]
    number = {w: i for i, w in enumerate(names)} | {"": 0}
    ids = np.zeros((len(picked), WINDOW), np.int64)
    for i, p in enumerate(picked):
        ids[i, : len(p)] = [number[w] for w in p]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for _ in range(epochs if len(picked) > 1500 else 3 * epochs):
        order = r.permutation(len(picked))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            used, local = np.unique(ids[part], return_inverse=True)
            if used[0]:
                used, local = np.concatenate([[0], used]), local + 1
            g = network.gradient([names[i] for i in used.tolist()], local.reshape(len(part), WINDOW), target[part], weight[part])
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                v = np.clip(v, -1, 1).astype(np.float32)
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                network.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    scorer = Scorer(network)
    fit = np.flatnonzero(aside) if aside.any() and 0 < labels[aside].sum() < aside.sum() else np.arange(len(rows))
    logits = np.concatenate([scorer.largest([rows[i][0] for i in fit[a : a + 500].tolist()]) for a in range(0, len(fit), 500)])
    scorer.slope, scorer.shift = _calibrated(logits, labels[fit].astype(float), np.where(labels[fit] == 1, left_out[1], left_out[0]))
    return scorer


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 40_000) -> Scorer:
    """docs and labels hold the learning rows only."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    positive = min(sizes.get(1, 0), max(max_rows // 2, max_rows - sizes.get(0, 0)))
    deal = [F.xxhash64("doc_id", F.lit("toxic")), F.col("doc_id")]
    sample = told.filter("toxic = 1").orderBy(*deal).limit(positive).unionByName(told.filter("toxic = 0").orderBy(*deal).limit(max_rows - positive))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").collect()  # max_rows ids, and as many texts of max_chars
    rows = [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: r["doc_id"])]
    count = Counter(y for _, y in rows)
    return train(rows, (sizes.get(0, 0) / max(1, count[0]), sizes.get(1, 0) / max(1, count[1])))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                scores = scorer.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, held_out, scorer: Scorer) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by the vocabulary's size
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = fitted(docs.filter(fold(4) != 2), labels.filter(fold(4) != 2))
    return toxicity(docs, fold(4) == 2, scorer)
