"""Language identification by interpolated Kneser-Ney character models, one per language.

A word is read between two boundary marks; the model of a language gives each character the probability
after the `order - 1` before it. Counts of the highest order are true counts, those of lower orders count
distinct left neighbours; every order gives up one discount and the freed mass goes to the next lower,
down to a uniform distribution over the characters seen. All n-grams lie in one sorted array of 64-bit
hashes per order, with a row of interpolated probabilities for the languages beside it, so scoring
is a binary search per character. A document's cross-entropy is its words' summed, divided by its
characters; the lowest wins. Rejection is calibrated on the learning rows: a document is rejected if its
cross-entropy exceeds their mean by `reject_sigmas` deviations at its length, or if it has no letter.

Every lang value of the learning rows has a model, so what is sent to the tasks grows with their number.
The learning sample is bounded: an equal share of `max_rows` documents for each language, at least
`min_rows`, dealt by a hash of the id; a learning text of more than `max_chars` characters gives one
passage of that length, from a place by the same hash. Scoring covers every whole text.

Cases: a null text or one without letters is `und` with score 0; if nothing can be learned from, all are
`und`; equal entropies go to the language that sorts first; repeated rows are judged alike; a very long
text or word is scored whole, 1,000 texts at a time; an empty table gives an empty result; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, fold, id_text, released

UNKNOWN = "und"
MARK = "\x02"
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters_of(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _points(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between marks, and for each predicted character its word and how many characters precede it."""
    text = np.array([*map(ord, MARK + MARK.join(words) + MARK)], dtype=np.uint64)
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    before = np.minimum(np.arange(len(word)) - starts[word] + 1, order - 1)
    return text, word, before


def _grams(text: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place from n-1 on; 64 bits."""
    size = len(text) - n + 1
    h = np.full(max(size, 0), n, dtype=np.uint64)
    for k in range(n):
        h = _mix((h + text[k : k + size]) * MIX)
    return h


class Models:
    """Sorted hash arrays of all languages: per order the n-grams' interpolated probabilities and the contexts' back-off weights."""

    def __init__(self, languages: list[str], samples: list[Counter], order: int = 4, discount: float = 0.75):
        self.languages, self.order = languages, order
        self.uniform = 1.0 / max(2, len({c for s in samples for w in s for c in w}) + 2)
        counted = [self._counted(s, order, discount) for s in samples]
        self.keys, self.values, self.contexts, self.gammas = [], [], [], []
        for n in range(1, order + 1):
            merged = [np.concatenate([np.zeros(0, np.uint64), *(c[n][k] for c in counted)]) for k in range(3)]
            keys, first = np.unique(merged[0], return_index=True)
            context, lower = merged[1][first], merged[2][first]
            shares = np.zeros((len(keys), len(languages)))
            contexts = np.unique(context)
            gammas = np.ones((len(contexts), len(languages)))
            for j, c in enumerate(counted):
                shares[np.searchsorted(keys, c[n][0]), j] = c[n][3]
                gammas[np.searchsorted(contexts, c[n][4]), j] = c[n][5]
            below = self.values[-1][np.searchsorted(self.keys[-1], lower)] if n > 1 else self.uniform
            self.keys.append(keys)
            self.values.append(shares + gammas[np.searchsorted(contexts, context)] * below)
            self.contexts.append(contexts)
            self.gammas.append(gammas)

    @staticmethod
    def _counted(words: Counter, order: int, d: float) -> dict[int, tuple]:
        """n -> n-grams, their contexts, their suffixes, discounted shares; contexts, back-off weights."""
        names = sorted(words)
        weight = np.array([words[w] for w in names], dtype=np.float64)
        text, word, before = _points(names, order)
        ends = np.arange(1, len(word) + 1)
        grams = {n: _grams(text, n) for n in range(1, order + 1)}
        out = {}
        for n in range(1, order + 1):
            full = before + 1 >= n  # the n-gram doesn't reach over the word's start
            at = ends[full] - n + 1
            keys, sample, place = np.unique(grams[n][at], return_index=True, return_inverse=True)
            context = grams[n - 1][at][sample] if n > 1 else np.zeros(len(keys), np.uint64)
            lower = grams[n - 1][at + 1][sample] if n > 1 else np.zeros(len(keys), np.uint64)
            exact = before[full] + 1 == n  # nothing can stand left of a word's start: true counts
            counts = np.bincount(place, weights=weight[word[full]] * (exact | (n == order)), minlength=len(keys))
            if n < order:  # elsewhere the number of distinct characters to the left
                longer = ~exact
                _, distinct = np.unique(grams[n + 1][at[longer] - 1], return_index=True)
                counts += np.bincount(place[longer][distinct], minlength=len(keys))
            contexts, where = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(where, weights=counts), np.bincount(where)
            out[n] = (keys, context, lower, np.maximum(counts - d, 0) / total[where] if len(keys) else counts, contexts, np.minimum(d * kinds / total, 1.0) if len(keys) else counts)
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word (with its end) under each language."""
        text, word, before = _points(words, self.order)
        ends = np.arange(1, len(word) + 1)
        p = np.full((len(word), len(self.languages)), self.uniform)
        scale = np.ones_like(p)
        open_ = np.arange(len(word))
        for n in range(self.order, 0, -1):
            mine = before[open_] + 1 >= n
            now, at = open_[mine], ends[open_[mine]] - n + 1
            if not len(now):
                continue
            found, row = self._find(self.keys[n - 1], _grams(text, n)[at])
            p[now[found]] = self.values[n - 1][row[found]] * scale[now[found]]
            lost = now[~found]
            if len(lost):
                at = at[~found]
                told, row = self._find(self.contexts[n - 1], _grams(text, n - 1)[at] if n > 1 else np.zeros(len(at), np.uint64))
                scale[lost[told]] *= self.gammas[n - 1][row[told]]
            open_ = np.concatenate([lost, open_[~mine]])
        p[open_] *= scale[open_]
        logs = np.log(np.maximum(p, 1e-300))
        return np.stack([np.bincount(word, weights=logs[:, j], minlength=len(words)) for j in range(len(self.languages))], axis=1) if self.languages else np.zeros((len(words), 0))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at


class Identifier:
    """Models with calibration, and a bounded memory of words."""

    def __init__(self, models: Models, mean: float = 0.0, deviation: float = 1.0, spread: float = 1.0, sharpness: float = 1.0, reject_sigmas: float = 6.0):
        self.models, self.mean, self.deviation, self.spread, self.sharpness, self.reject_sigmas = models, mean, deviation, spread, sharpness, reject_sigmas

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table", "sizes")}

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.table, self.sizes = np.zeros((1, len(self.models.languages))), np.zeros(1)

    def entropies(self, texts: list[str | None], remembered: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Per text: summed log-probabilities by language, and the number of characters they are of."""
        if not hasattr(self, "known") or len(self.known) > remembered:
            self.forget()
        split = [(t or "").lower().split() for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known))
        cleaned = {}
        for token in new:
            cleaned.setdefault(letters_of(token), []).append(token)
        words = [w for w in cleaned if w and len(w) <= 4096]
        rows = [np.zeros((0, self.table.shape[1]))]
        for a in range(0, len(words), 20_000):
            rows.append(self.models.word_scores(words[a : a + 20_000]))
        at = len(self.sizes)
        place = {w: at + i for i, w in enumerate(words)}
        self.table = np.concatenate([self.table, *rows])
        self.sizes = np.concatenate([self.sizes, [len(w) + 1.0 for w in words]])
        for w, tokens in cleaned.items():
            if w and w not in place:  # too long to keep: scored once, in parts that the memory holds
                place[w] = len(self.sizes)
                self.table = np.concatenate([self.table, self.models.word_scores([w])])
                self.sizes = np.append(self.sizes, len(w) + 1.0)
            for t in tokens:
                known[t] = place[w] if w else 0
        sums, sizes = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for i, tokens in enumerate(split):
            if tokens:
                ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
                sums[i] = self.table[ids].sum(axis=0)
                sizes[i] = self.sizes[ids].sum()
        return sums, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the document is rejected."""
        sums, sizes = self.entropies(texts)
        if not self.models.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        scaled = -sums / np.maximum(sizes, 1)[:, None]
        best = scaled.argmin(axis=1)
        none = sizes == 0
        # Confidence: the best language's posterior at the calibrated sharpness.
        rise = np.minimum(self.sharpness * np.sqrt(np.maximum(sizes, 1))[:, None] * (scaled - scaled.min(axis=1, keepdims=True)), 700)
        score = 1 / np.exp(-rise).sum(axis=1)
        limit = self.mean + self.reject_sigmas * (self.deviation + self.spread / np.sqrt(np.maximum(sizes, 1)))
        rejected = none | (scaled.min(axis=1) > limit)
        return [UNKNOWN if n else self.models.languages[b] for b, n in zip(best.tolist(), none.tolist())], np.where(none, 0.0, score), rejected


def learn(rows: list[tuple[str, str]], order: int = 4, reject_sigmas: float = 6.0) -> Identifier:
    """rows: (lang, text). A tenth, without the first row of any language, is set aside for the calibration if there are rows enough."""
    languages = sorted({lang for lang, _ in rows})
    firsts = {lang: i for i, (lang, _) in reversed([*enumerate(rows)])}
    apart = [len(rows) >= 100 and i % 10 == 9 and firsts[lang] != i for i, (lang, _) in enumerate(rows)]
    aside = [r for r, x in zip(rows, apart) if x]
    used = [r for r, x in zip(rows, apart) if not x]
    samples = {lang: Counter() for lang in languages}
    for lang, text in used:
        samples[lang].update(w for t in text.lower().split() if (w := letters_of(t)))
    out = Identifier(Models(languages, [samples[lang] for lang in languages], order), reject_sigmas=reject_sigmas)
    known = [r for r in (aside or rows) if letters_of(r[1])]
    if known and languages:
        sums, sizes = out.entropies([t for _, t in known])
        own = -sums[np.arange(len(known)), [languages.index(lang) for lang, _ in known]] / sizes
        long = sizes >= np.median(sizes)
        out.mean, out.deviation = float(np.median(own)), float(max(own[long].std(), 0.02))
        out.spread = float(max(np.sqrt(np.mean((own - out.mean) ** 2 * sizes)) - out.deviation, 0.5))
        gaps = np.sort(-sums / sizes[:, None], axis=1)
        if len(languages) > 1:
            out.sharpness = float(4.0 / max(1e-3, np.median((gaps[:, 1] - gaps[:, 0]) * np.sqrt(sizes))))
    return out


def identifier(docs: DataFrame, max_rows: int = 4000, min_rows: int = 20, max_chars: int = 40_000, order: int = 4) -> Identifier:
    """Learn from the rows of docs that have a lang; docs is already the learning fold."""
    rows = docs.select(id_text().alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    rows = rows.withColumn("deal", F.shiftrightunsigned(F.xxhash64("id", F.lit("lang")), 24))  # 40 bits
    told = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("deal").alias("least"))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in told.collect()}  # a row for each model that follows
    if not sizes:
        return learn([], order)
    share = max(min_rows, max_rows // len(sizes))
    limits = {lang: max(least, math.ceil(share / n * (1 << 40))) for lang, (n, least) in sizes.items()}
    limit, least = (F.create_map(*(F.lit(x) for pair in m.items() for x in pair))[F.col("lang")] for m in (limits, {lang: x for lang, (_, x) in sizes.items()}))
    spare = F.length("text") - max_chars
    passage = F.when(spare <= 0, F.col("text")).otherwise(F.substring("text", F.pmod(F.col("deal"), spare + 1).cast("int") + 1, F.lit(max_chars)))
    sample = rows.filter(F.col("deal") <= limit).select("lang", passage.alias("text"), "deal", "id", (F.col("deal") != least).alias("more"))
    # Each language's first row comes before all others, so the bound leaves none out.
    taken = sample.orderBy("more", "deal", "id", "text").limit(share * len(sizes)).collect()
    return learn([(r["lang"], r["text"]) for r in sorted(taken, key=lambda r: (r["deal"], r["id"], r["text"]))], order)


def _judge(model):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        judge.forget()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                langs, scores, rejected = judge.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
                columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_gw_text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*(n for n in batch.schema.names if n != "_gw_text"), "_gw_lang", "_gw_score", "_gw_rejected"])
        judge.forget()

    return run


def identified(docs: DataFrame, model: Identifier) -> DataFrame:
    """docs with _gw_lang, _gw_score and _gw_rejected; other columns pass through."""
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), "_gw_lang string, _gw_score double, _gw_rejected boolean"])
    return docs.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(model)), schema)  # bounded by the learning sample


def op6_lang_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = identifier(docs.filter(fold(3) != 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identified(rows, model).select("doc_id", "held_out", F.col("_gw_lang").alias("lang_pred"), F.col("_gw_score").alias("score"), F.col("_gw_rejected").alias("rejected"))
