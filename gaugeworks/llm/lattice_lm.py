"""Document likelihood by a lattice over an existing subword vocabulary.

A text is a sequence of words and one end. The lattice of a word (a space before it) has an edge for every vocabulary
piece that fits its bytes, and one per byte for what no piece covers. The word's probability is the sum over all paths,
that is, over all segmentations, by a forward recursion in log space:

    alpha[0] = 0,    alpha[to] = logsumexp over edges (from, to, piece) of alpha[from] + log p(piece)

A document's `score` is the log10 of the product over its words' lattices and the end, which is one more piece. Texts
are sequences of pieces in many ways, all of which count, so the probabilities of all texts sum to 1 at most.

Piece probabilities come from the scores of the vocabulary file. The file orders its pieces by score and the scores are
ranks, so they are read as weights 1 / (rank + 20). Expectation steps over the words of all learning documents follow:
each counts the uses of the pieces under the weights so far, and these and PRIOR uses a piece, dealt by the file's
weights, are the next ones. They end when the learning documents' log10 likelihood gains less than `least_gain` a token,
or after `steps` of them.

`word_score` is an extension beside it: a word's probability is its discounted share of the learning tokens, and the
discounted mass goes by the lattice:

    P(word) = max(c - D, 0) / N  +  D V / N * lattice(word)

c: count of the word, N: learning tokens, V: distinct ones, ends included; D: the absolute discount n1 / (n1 + 2 n2).

The corpus is held as blocks of documents. Each block tells the owner of a range of word hashes how often it has each
distinct word; owners add up over all blocks and answer with the totals. So what is gathered grows with the input, and
no word is ever sent as often as it occurs. The expectation steps work on a table of the distinct learning words and
their counts; a task of a step returns one number a piece.

Words are compared by 64-bit hashes: 10^9 distinct words meet with a chance of 3 %, and a meeting alters one count.

Cases: a null text is empty, and an empty text is the end alone; a very long text is one row of one block, and a very
long word is worked on place by place in memory of a few numbers a byte; if there is nothing to learn from, counts are
0, the base score is that of the formula with N = V = 0 (0 where that is undefined) and the file's weights alone give
the score; repeated rows and ties are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.blocks import PACKED, answered, columns_of, key_ranges, packed_batch, packed_rows, unpacked, with_answers, write_blocks
from gaugeworks.llm.common import documents, fold, materialise, released, vocabulary_path

SPACE = "▁".encode()
NEVER = -1e30
PRIOR = 0.1
LONGEST = 512  # bytes of a word that vectorised recursion takes; longer ones go one by one


class Pieces:
    """A trie over the bytes of an existing vocabulary's pieces, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            text = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.encode().replace(SPACE, b" ")
            spelled[text] = max(model.get_score(i), spelled.get(text, -1e9))
        for b in range(256):
            spelled.setdefault(bytes([b]), min(spelled.values(), default=0.0))
        self.pieces = sorted(p for p in spelled if b" " not in p[1:])
        scores = np.array([spelled[p] for p in self.pieces])
        # The file orders its pieces by score; their weights fall as one over the rank.
        rank = np.empty(len(scores))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
        weight = 1.0 / (rank + 20.0)
        self.start = np.log(weight / weight.sum())
        # Children of the root by byte; of other nodes by the few byte values that stand behind a first one.
        later = sorted({b for p in self.pieces for b in p[1:]})
        self.code = np.zeros(256, np.uint8 if len(later) < 255 else np.uint16)
        self.code[later] = np.arange(1, len(later) + 1)
        self.root = np.zeros(256, np.int32)
        prefixes = sorted({p[:k] for p in self.pieces for k in range(1, len(p) + 1)})
        number = {p: i + 1 for i, p in enumerate(prefixes)}
        self.child = np.zeros((len(prefixes) + 1, len(later) + 1), np.int32)
        self.ends = np.full(len(prefixes) + 1, -1, np.int32)
        for prefix, i in number.items():
            if len(prefix) == 1:
                self.root[prefix[0]] = i
            else:
                self.child[number[prefix[:-1]], self.code[prefix[-1]]] = i
        for i, piece in enumerate(self.pieces):
            self.ends[number[piece]] = i
        self.inner = self.child.any(axis=1)

    def step(self, node: np.ndarray | int, byte: np.ndarray | int):
        return self.child[node, self.code[byte]]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _edges(trie: Pieces, words: np.ndarray, sizes: np.ndarray):
    """All (word, from, to, piece) of words of like size; words: rows of bytes, a space first."""
    n, width = words.shape
    for first in range(width):
        row = np.flatnonzero(sizes > first)
        node, found = None, []
        at = first
        while len(row) and at < width:
            byte = words[row, at]
            node = trie.root[byte] if node is None else trie.step(node, byte)
            at += 1
            ok = (node > 0) & (sizes[row] >= at)
            row, node = row[ok], node[ok]
            piece = trie.ends[node]
            hit = piece >= 0
            if hit.any():
                found.append((at, row[hit], piece[hit]))
            more = trie.inner[node]
            row, node = row[more], node[more]
        yield first, found


def _columns(words: list[bytes]):
    """Words by size: (places, matrix of bytes, sizes)."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(order):
        least = len(words[order[a]])
        b = a
        while b < len(order) and len(words[order[b]]) <= least + 2 and (b - a) < 15_000:
            b += 1
        chosen = order[a:b]
        width = len(words[order[b - 1]]) + 1
        sizes = np.array([len(words[i]) + 1 for i in chosen])
        matrix = np.frombuffer(b"".join((b" " + words[i]).ljust(width, b"\0") for i in chosen), np.uint8).reshape(len(chosen), width)
        yield np.array(chosen), matrix, sizes
        a = b


def _edges_at(trie: Pieces, text: bytes, first: int):
    """(to, piece) of the edges that leave one place."""
    node = 0
    for at in range(first, len(text)):
        node = trie.step(node, text[at]) if node else trie.root[text[at]]
        if not node:
            return
        if trie.ends[node] >= 0:
            yield at + 1, int(trie.ends[node])


def _long_forward(trie: Pieces, weights: np.ndarray, text: bytes) -> np.ndarray:
    """The forward recursion for one long word, place by place."""
    alpha = np.full(len(text) + 1, NEVER)
    alpha[0] = 0.0
    for first in range(len(text)):
        for to, piece in _edges_at(trie, text, first):
            alpha[to] = np.logaddexp(alpha[to], alpha[first] + weights[piece])
    return alpha


def _long_uses(trie: Pieces, weights: np.ndarray, text: bytes, total: np.ndarray, times: float) -> float:
    """Adds the expected uses of the pieces in one long word, in one pass back; returns its log marginal."""
    alpha, beta = _long_forward(trie, weights, text), np.full(len(text) + 1, NEVER)
    beta[-1] = 0.0
    for first in range(len(text) - 1, -1, -1):
        for to, piece in _edges_at(trie, text, first):
            beta[first] = np.logaddexp(beta[first], beta[to] + weights[piece])
            total[piece] += times * np.exp(alpha[first] + weights[piece] + beta[to] - alpha[-1])
    return float(alpha[-1])


def _fitting(weights: np.ndarray) -> float:
    """Bytes of a word up to which no product of chances leaves a double's range."""
    return 650 / -weights.min()


def _split(words: list[bytes]) -> tuple[list[int], list[int]]:
    long = [i for i, w in enumerate(words) if len(w) > LONGEST]
    return ([i for i, w in enumerate(words) if len(w) <= LONGEST] if long else list(range(len(words)))), long


def marginals(trie: Pieces, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log of the sum over all segmentations of each word."""
    out = np.empty(len(words))
    short, long = _split(words)
    for i in long:
        out[i] = _long_forward(trie, weights, b" " + words[i])[-1]
    chances, fits = np.exp(weights), _fitting(weights)
    for where, matrix, sizes in _columns([words[i] for i in short]):
        products = matrix.shape[1] <= fits
        alpha = np.full((len(matrix), matrix.shape[1] + 1), 0.0 if products else NEVER)
        alpha[:, 0] = 1.0 if products else 0.0
        for first, found in _edges(trie, matrix, sizes):
            for to, row, piece in found:
                if products:
                    alpha[row, to] += alpha[row, first] * chances[piece]
                else:
                    alpha[row, to] = np.logaddexp(alpha[row, to], alpha[row, first] + weights[piece])
        last = alpha[np.arange(len(matrix)), sizes]
        out[np.array(short)[where]] = np.log(last) if products else last
    return out


Bundle = tuple[np.ndarray, np.ndarray, np.ndarray]


def bundles(words: list[bytes], counts: np.ndarray) -> Iterator[Bundle]:
    """Words as (matrix of bytes with the space before them, sizes, counts): those of like size together, a long one alone."""
    short, long = _split(words)
    for i in long:
        yield np.frombuffer(b" " + words[i], np.uint8)[None], np.array([len(words[i]) + 1]), counts[i : i + 1]
    for where, matrix, sizes in _columns([words[i] for i in short]):
        yield matrix, sizes, counts[np.array(short)[where]]


def _products(edges: list, chances: np.ndarray, bundle: Bundle) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, their expected uses, and log marginals of words so short that no product of chances leaves a double's range."""
    matrix, sizes, counts = bundle
    alpha = np.zeros((len(matrix), matrix.shape[1] + 1))
    beta = np.zeros_like(alpha)
    alpha[:, 0] = 1.0
    beta[np.arange(len(matrix)), sizes] = 1.0
    for first, found in edges:
        for to, row, piece in found:
            alpha[row, to] += alpha[row, first] * chances[piece]
    for first, found in reversed(edges):
        for to, row, piece in found:
            beta[row, first] += beta[row, to] * chances[piece]
    scale = counts / beta[:, 0]
    used = [np.zeros(0, np.int64), *(piece for _, found in edges for _, _, piece in found)]
    shares = [np.zeros(0), *(alpha[row, first] * scale[row] * chances[piece] * beta[row, to] for first, found in edges for to, row, piece in found)]
    return np.concatenate(used), np.concatenate(shares), np.log(beta[:, 0])


def _sums(edges: list, weights: np.ndarray, bundle: Bundle) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in log space, for words of any size."""
    matrix, sizes, counts = bundle
    alpha = np.full((len(matrix), matrix.shape[1] + 1), NEVER)
    beta = np.full_like(alpha, NEVER)
    alpha[:, 0] = 0.0
    beta[np.arange(len(matrix)), sizes] = 0.0
    for first, found in edges:
        for to, row, piece in found:
            alpha[row, to] = np.logaddexp(alpha[row, to], alpha[row, first] + weights[piece])
    for first, found in reversed(edges):
        for to, row, piece in found:
            beta[row, first] = np.logaddexp(beta[row, first], beta[row, to] + weights[piece])
    used = [np.zeros(0, np.int64), *(piece for _, found in edges for _, _, piece in found)]
    shares = [np.zeros(0), *(np.exp(alpha[row, first] + weights[piece] + beta[row, to] - beta[row, 0]) * counts[row] for first, found in edges for to, row, piece in found)]
    return np.concatenate(used), np.concatenate(shares), beta[:, 0]


def expectation(trie: Pieces, weights: np.ndarray, words: Iterable[Bundle]) -> tuple[np.ndarray, float]:
    """How often each piece is used, over all segmentations by their posterior, times the words' counts; and the words' log likelihood."""
    total, likelihood = np.zeros(len(weights)), 0.0
    chances, fits = np.exp(weights), _fitting(weights)
    for bundle in words:
        matrix, sizes, counts = bundle
        if matrix.shape[1] > LONGEST + 1:
            likelihood += counts[0] * _long_uses(trie, weights, matrix[0].tobytes(), total, counts[0])
            continue
        edges = list(_edges(trie, matrix, sizes))
        used, shares, inside = _products(edges, chances, bundle) if matrix.shape[1] <= fits else _sums(edges, weights, bundle)
        total += np.bincount(used, weights=shares, minlength=len(total))
        likelihood += float((counts * inside).sum())
    return total, likelihood


class Lattice:
    """Marginals of words under fixed weights; those that return come from a memory bounded by bytes."""

    def __init__(self, path: str, weights: bytes, remembered: int = 24 << 20):
        self.trie, self.weights = pieces_of(path), np.frombuffer(weights)
        self.known: dict[bytes, float] = {}
        self.remembered, self.held = remembered, 0

    def marginals(self, words: list[bytes]) -> np.ndarray:
        if self.held > self.remembered:
            self.known, self.held = {}, 0
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, marginals(self.trie, self.weights, new).tolist()))
        out = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        self.held += sum(map(len, new)) + 120 * len(new)
        return out


@lru_cache(maxsize=1)
def lattice_of(path: str, weights: bytes) -> Lattice:
    """One memory of words for all tasks of a Python worker."""
    return Lattice(path, weights)


def _distinct(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Distinct words in order of their hashes, each text's word numbers, and the sorted hashes."""
    known: dict[bytes, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in t.lower().split()), np.int64) for t in texts]
    names = list(known)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in names), np.uint64, len(names))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return [names[i] for i in order.tolist()], [place[i] for i in ids], hashes[order]


#: Words, and bytes of them, that a task holds while it counts or works on them.
HELD_WORDS, HELD_BYTES = 150_000, 16 << 20


def _count(parts: int):
    """Rows of kind 0: counts of the block's distinct words; of kind 1: distinct learning words of a task's blocks and their counts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = {}, 0

        def told():
            sizes, counts = np.fromiter(map(len, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))
            return (1, 0, -1, len(seen), b"".join([sizes.tobytes(), counts.tobytes(), *seen]))

        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = unpacked(payload.as_py())
                names, ids, hashes = _distinct(table.column("text").to_pylist())
                used = np.flatnonzero(~table.column("held_out").to_numpy(zero_copy_only=False))
                counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *(ids[i] for i in used.tolist())]), minlength=len(names))
                for i in np.flatnonzero(counts).tolist():
                    held += len(names[i]) if names[i] not in seen else 0
                    seen[names[i]] = seen.get(names[i], 0) + int(counts[i])
                rows = packed_rows(0, block, hashes, [counts.astype(np.int32)], parts)
                if len(seen) > HELD_WORDS or held > HELD_BYTES:
                    rows.append(told())
                    seen, held = {}, 0
                if rows:
                    yield packed_batch(rows)
        if seen:
            yield packed_batch([told()])

    return run


@released
def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per word of the rows of kind 1."""
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = raw.as_buffer()
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n))])
            words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), raw.slice(16 * n)])
            counts = pa.array(np.frombuffer(raw, np.int64, n, 8 * n))
            for a in range(0, n, 20_000):
                yield pa.RecordBatch.from_arrays([words.slice(a, 20_000).cast(pa.binary()), counts.slice(a, 20_000)], names=["word", "c"])


BUNDLED = "width int, n int, data binary"


@released
def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and counts as bundles, so that no step has to lay them out again."""
    words, counts, held = [], [], 0

    def rows() -> pa.RecordBatch:
        out = [(m.shape[1], len(m), b"".join([sizes.tobytes(), c.tobytes(), m.tobytes()])) for m, sizes, c in bundles(words, np.array(counts, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["width", "n", "data"])

    for batch in batches:
        for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.append(word)
            counts.append(c)
            held += len(word)
            if len(words) >= HELD_WORDS or held > HELD_BYTES:
                yield rows()
                words, counts, held = [], [], 0
    if words:
        yield rows()


def learning_words(packed: DataFrame, parts: int) -> DataFrame:
    """Each distinct learning word once, in bundles, written in as many files as there are ranges, so that steps spread over tasks."""
    rows = packed.filter("kind = 1").select("n", "data").mapInArrow(_listed, "word binary, c long")
    return materialise(rows.repartition(parts, "word").groupBy("word").agg(F.sum("c").alias("c")).mapInArrow(_bundled, BUNDLED), "lattice-words")


def _expect(path: str, weights: np.ndarray):
    """One row a task: expected uses of the pieces in its words, and the words' log likelihood behind them."""

    def laid(batch: pa.RecordBatch) -> Iterator[Bundle]:
        for width, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = raw.as_buffer()
            yield np.frombuffer(raw, np.uint8, n * width, 16 * n).reshape(n, width), np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.float64, n, 8 * n)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = pieces_of(path), np.zeros(len(weights) + 1)
        for batch in batches:
            uses, likelihood = expectation(trie, weights, laid(batch))
            total[:-1] += uses
            total[-1] += likelihood
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    return run


def fitted_weights(words: DataFrame, path: str, tokens: float, ends: float, steps: int, least_gain: float) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the end after expectation steps over `words`, which hold `tokens` words."""
    trie = pieces_of(path)
    weights, end = piece_weights(trie, np.zeros(len(trie.pieces)), ends)
    before = -np.inf
    for _ in range(steps if tokens else 0):
        total = _summed(words.mapInArrow(_expect(path, weights), "data binary"), len(trie.pieces) + 1)
        now = (total[-1] + ends * end) / (tokens + ends) / np.log(10)
        weights, end = piece_weights(trie, total[:-1], ends)
        if now - before < least_gain:
            break
        before = now
    return weights, end


STATISTICS = 4


def _total(kind: int, sizes: np.ndarray, data: list[bytes]) -> list[bytes]:
    """Total counts of each block's distinct hashes. Before them the first block of a range is told the range's statistics,
    others zeros: tokens, kinds of them, kinds seen once and twice."""
    keys, counts = columns_of(sizes, data, [np.uint64, np.int32])
    _, place = np.unique(keys, return_inverse=True)
    whole = np.bincount(place, weights=counts)
    told = whole[place].astype(np.int64)
    statistics = np.array([whole.sum(), (whole > 0).sum(), (whole == 1).sum(), (whole == 2).sum()])
    ends = np.cumsum(sizes)
    return [(statistics * (i == 0)).tobytes() + told[a:b].tobytes() for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist()))]


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a task's vectors of numbers; one row leaves, as long as they."""
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            own = np.frombuffer(raw)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])


def _summed(vectors: DataFrame, size: int) -> np.ndarray:
    """The sum of packed vectors of `size` numbers, by place."""
    out = np.zeros(size)
    for at, x in vectors.mapInArrow(_sum_vectors, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col")).collect():  # a row per place
        out[at] = x
    return out


def _score(path: str, weights: np.ndarray, end: float, n: float, v: float, discount: float, ends: float):
    """end: log-probability of the end. n, v: tokens and kinds of them, ends included."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path, weights.tobytes())
        below, tens = n + 0.1 * (v + 1), np.log(10)
        end_base = np.log10((ends + 0.1) / below) if n else 0.0
        end_word = np.log(max(ends - discount, 0) / n + discount * v / n * np.exp(end)) if n else end
        for batch in batches:
            for payload, told in zip(batch.column(0), batch.column(1)):
                table = unpacked(payload.as_py())
                names, ids, hashes = _distinct(table.column("text").to_pylist())
                c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(a["data"], np.int64, offset=8 * STATISTICS) for a in sorted(told.as_py() or (), key=lambda a: a["part"]))])
                base = np.log10((c + 0.1) / below) if n else np.zeros(len(c))
                inside = lattice.marginals(names)
                with np.errstate(divide="ignore"):
                    word = np.logaddexp(np.log(np.maximum(c - discount, 0) / n), np.log(discount * v / n) + inside) if n else inside
                known = (c > 0).astype(np.int64)
                out = [(len(i) + 1, int(known[i].sum()) + int(ends > 0), int(n), float(base[i].sum() + end_base), float((inside[i].sum() + end) / tens), float((word[i].sum() + end_word) / tens)) for i in ids]
                columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.float64(),) * 3)]
                yield from pa.table([table.column("doc_id"), table.column("held_out"), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"]).combine_chunks().to_batches()

    return run


def piece_weights(trie: Pieces, uses: np.ndarray, ends: float) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the end: uses and PRIOR uses a piece, dealt by the file's weights."""
    fitted = uses + PRIOR * len(uses) * np.exp(trie.start)
    total = fitted.sum() + ends + PRIOR
    return np.log(fitted / total), float(np.log((ends + PRIOR) / total))


def lattice_scores(docs: DataFrame, held_out, path: str | None = None, steps: int = 8, least_gain: float = 0.01) -> DataFrame:
    """docs: doc_id, text. held_out: boolean column; the other rows are learned from."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = write_blocks(rows, "lattice")
    payloads, parts = blocks.select("block", "payload"), key_ranges(blocks)
    packed = materialise(payloads.mapInArrow(_count(parts), PACKED), "lattice-counts")
    told = materialise(answered(packed.filter("kind = 0"), _total), "lattice-totals")
    tokens, kinds, once, twice = _summed(told.select(F.substring("data", 1, 8 * STATISTICS).alias("data")), STATISTICS)
    ends = float(docs.filter(~held_out).count())
    weights, end = fitted_weights(learning_words(packed, parts), path, tokens, ends, steps, least_gain)
    discount = min(once / (once + 2 * twice), 0.95) if once and twice else 0.5
    run = _score(path, weights, end, tokens + ends, kinds + (ends > 0), discount, ends)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double"
    return with_answers(payloads, told, "told").select("payload", "told").mapInArrow(run, schema)


def op3_lattice_lm(spark, sf_dir):
    return lattice_scores(documents(spark, sf_dir), fold(10) == 0)
