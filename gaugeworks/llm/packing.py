"""Lexical retrieval packing: documents fill windows together with their BM25 neighbours.

1. Documents are tokenised once; ids (packed) and the document frequencies of the ids are written to the
   shared folder. The BM25 terms are the ids, so the statistics over all documents have one number per
   id of the vocabulary.
2. Rows are dealt in ranges of (sketch, row). A sketch is three min-hashes of a document's ids, weighted by
   the square of their idf; the end id and ids of a single document don't count. Copies have one sketch,
   and similar documents often begin alike; a sketch that many documents share is still cut into even ranges.
   Where the session's shuffle partitions would hold more than `task_shards` shards' ids each, there are more ranges.
3. Each range is indexed shard by shard (at most `shard_tokens` ids and `shard_docs` documents). A seed
   document is laid into the open window; its best unused neighbours by BM25 over the seed's rarest
   terms follow until the window is full. The document that crosses the end is cut, and its rest opens
   the next window, whose seed it is. A last, partial window is cut into lengths that are powers of two,
   which need no padding.

Cases: a null text is empty, and an empty text is the end id alone; repeated rows are packed each on its
own; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, materialise, release, released, vocabulary_path

END, WINDOW = 0, 1024
K1, B = 1.2, 0.75
TOKENS = "doc_id long, uid long, n_tokens long, ids binary, df array<int>"
_TOKENS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("df", pa.list_(pa.int32()))])
DEALT = "doc_id long, uid long, sketch long, ids binary"
HASHES, RANK_BITS = 3, 21
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def merge_encoding(tokenizer):
    """The vocabulary as ranks for an encoder that merges by rank, or None where its merges aren't in the order of its ids."""
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    letters = {c: b for b, c in byte_letters().items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    vocabulary, made = model["vocab"], [a + b for a, b in merges]
    ids = [vocabulary.get(x, -1) for x in made]
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    single = {c for c in vocabulary if len(c) == 1}
    if ids != sorted(set(ids)) or single != set(letters) or set(vocabulary) - set(made) - single - special:
        return None
    ranks = {bytes(letters[c] for c in x): i for x, i in vocabulary.items() if x not in special}
    import public_tokenizers

    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Words of these letters are cut alike by every Unicode version's classes; longer ones are merged by the library's heap.
PLAIN = re.compile("[\n\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]{1,100}").fullmatch


def spaceless(words: pa.Array) -> list[str]:
    """An array's strings, none of which has a space, as a list: cut from one text, which takes a fraction of to_pylist's time."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class Encoder:
    """The library's ids, packed. Words that return come from a bounded memory.

    A space between two characters that aren't white space always starts a match of the pattern, so the
    parts between such spaces are encoded apart. Texts with other white space beside a space, or with the
    string of a special token, go to the library whole. New words of plain letters are merged by rank, which
    gives the same ids where the vocabulary's merges are in the order of its ids.
    """

    def __init__(self, path: str, remembered: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merging = merge_encoding(self.tokenizer)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width, self.code = ("<u2", "H") if self.size <= 65536 else ("<u4", "I")
        self.end = array(self.code, [END]).tobytes()
        self.opens = np.array([self.tokenizer.id_to_token(i).startswith("\u0120") for i in range(self.size)])
        self.remembered, self.known = remembered, {}
        self.odd_start = re.compile(r"\0[\s\0]").search

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str], merging: bool) -> list[bytes]:
        """Each word with a space before it. Many go through as one text: an id that begins with a space begins a word."""
        out = []
        for a in range(0, len(words), 4000):
            part = words[a : a + 4000]
            text = " " + " ".join(part)
            ids = np.array(self.merging.encode_ordinary(text) if merging else self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(part):
                out += self._library([" " + w for w in part])
                continue
            raw, size = ids.tobytes(), ids.itemsize
            ends = (np.append(cuts[1:], len(ids)) * size).tolist()
            out += [raw[x:y] for x, y in zip((cuts * size).tolist(), ends)]
        return out

    def _odd(self, word: str) -> bool:
        return not word or word[0].isspace() or word[-1].isspace() or any(s in word for s in self.special)

    def _learn(self, new: list[str]) -> None:
        """Ids of words that aren't remembered; nothing for those that can't be encoded apart."""
        known = self.known
        joined = "\0".join(["", *new, ""])
        if self.odd_start(joined) or self.odd_start(joined[::-1]) or any(s in joined for s in self.special):
            bad = {w for w in new if self._odd(w)}
            known.update(dict.fromkeys(bad, b""))
            new = [w for w in new if w not in bad]
        plain, rest = [], new
        if self.merging:
            fits = [*map(PLAIN, new)]
            plain = [w for w, fit in zip(new, fits) if fit]
            rest = [w for w, fit in zip(new, fits) if not fit]
        known.update(zip(plain, self._spaced(plain, True)))
        known.update(zip(rest, self._spaced(rest, False)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids and the end id of each text. Distinct words are looked up once, and ids are laid out by numpy."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        cuts = split.offsets.to_numpy()
        cuts = cuts - cuts[0]
        told = split.flatten().dictionary_encode()
        words, codes = spaceless(told.dictionary), told.indices.to_numpy().copy()
        firsts = [words[c] for c in codes[cuts[:-1]].tolist()]
        if len(self.known) > self.remembered:
            self.known.clear()
        ids = [*map(self.known.get, words)]
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                ids[i] = self.known[words[i]]
        odd = {i for i, w in enumerate(firsts) if w[-1:].isspace() or any(s in w for s in self.special)}  # no space stands before a text's first word
        for s in (s for s in self.special if " " in s):
            odd.update(i for i, t in enumerate(texts) if s in t)
        codes[cuts[:-1]] = len(words) + np.arange(len(texts))
        own = self._library(firsts)
        size = np.fromiter(map(len, ids + own), np.int32, len(ids) + len(own))
        bad = size == 0  # words that can't be encoded apart
        bad[len(words) :] = False
        if bad.any():
            odd.update(np.unique(np.searchsorted(cuts, np.flatnonzero(bad[codes]), side="right") - 1).tolist())
        ids += own
        pool = np.frombuffer(b"".join(ids), self.width)
        size //= np.int32(pool.itemsize)
        start = np.cumsum(size, dtype=np.int32) - size
        out = []
        for a in range(0, len(texts), 64):  # few enough that the index arrays stay in the processor's cache
            bounds = cuts[a : a + 65]
            own = codes[bounds[0] : bounds[-1]]
            n = size[own]
            ends = np.cumsum(n, dtype=np.int32)
            laid = pool[np.arange(ends[-1], dtype=np.int32) + np.repeat(start[own] - ends + n, n)].tobytes()
            stops = (ends[bounds[1:] - bounds[0] - 1] * pool.itemsize).tolist()
            out += [laid[x:y] + self.end for x, y in zip([0, *stops], stops)]
        for i in odd:
            out[i] = self._library([texts[i]])[0] + self.end
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def portions(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """A batch of (doc_id, text) in slices of at most `most` bytes of text, or a single row: the more rows, the fewer distinct words."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at)
        yield batch.slice(at, n)
        at += n


def _tokenise(path: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(path)
        df, counts, seen, counted = np.zeros(encoder.size, np.int32), np.zeros(encoder.size, np.uint8), np.zeros(encoder.size, np.uint8), 0
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in portions(batch):
                rows = []
                for doc_id, packed in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.frombuffer(packed, encoder.width)
                    seen[ids] = 1
                    counts += seen
                    seen[ids] = 0
                    counted += 1
                    if counted == 255:  # as many as a byte counts
                        df += counts
                        counts[:] = counted = 0
                    rows.append((doc_id, uid, len(ids), packed, None))
                    uid += 1
                yield _rows(rows)
        yield _rows([(None, -1, 0, None, df + counts)])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TOKENS)], schema=_TOKENS)


def sketch_ranks(df: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per min-hash the rank of each id and the id of each rank; an id is the least of a document's ids with a chance that grows with its squared idf."""
    counts = df >= 2
    counts[END] = False
    out = []
    for seed in range(1, HASHES + 1):
        keys = np.random.default_rng(seed).exponential(size=len(df)) / np.maximum(idf.astype(float) ** 2, 1e-30)
        ranks = np.full(len(df), len(df), np.int32)
        order = np.argsort(np.where(counts, keys, np.inf), kind="stable")[: counts.sum()]
        ranks[order] = np.arange(len(order))
        named = np.full(len(df) + 1, len(df), np.int64)
        named[: len(order)] = order
        out.append((ranks, named))
    return out


def sketches(ids: np.ndarray, starts: np.ndarray, ranks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sketch of each document of a flat array; none is empty, as each has its end id.

    It is made of ids, not ranks: long documents have low ranks, and would all be dealt to the first tasks.
    """
    out = np.zeros(len(starts), np.int64)
    for rank, named in ranks:
        out = out << RANK_BITS | named[np.minimum.reduceat(rank[ids], starts)]
    return out


def _sketched(ranks: list[tuple[np.ndarray, np.ndarray]], width: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = part.column(2).to_pylist()
                size = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(width).itemsize
                told = sketches(np.frombuffer(b"".join(raw), width), np.cumsum(size) - size, ranks)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(told), part.column(2)], names=["doc_id", "uid", "sketch", "ids"])

    return run


class Shard:
    """An inverted index over a bounded number of documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int):
        terms, docs, weights, self.query = [], [], [], []
        for d, own in enumerate(ids):
            kinds, tf = np.unique(own[:-1], return_counts=True)
            w = idf[kinds]
            terms.append(kinds)
            docs.append(np.full(len(kinds), d, np.int32))
            weights.append((w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))).astype(np.float32))
            self.query.append(kinds if len(kinds) <= query_terms else kinds[np.argpartition(-w, query_terms)[:query_terms]])
        terms = np.concatenate(terms)
        order = np.argsort(terms, kind="stable")
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(terms))
        self.docs, self.weights = np.concatenate(docs)[order], np.concatenate(weights)[order]
        self.scores = np.zeros(len(ids), np.float32)

    def neighbours(self, seed: int, used: np.ndarray, most: int) -> list[int]:
        """Unused documents by falling score; ties by position."""
        scores = self.scores
        scores[:] = 0
        at = np.searchsorted(self.terms, self.query[seed])
        for a, b in zip(self.first[at].tolist(), self.last[at].tolist()):
            scores[self.docs[a:b]] += self.weights[a:b]
        scores[used] = 0
        best = np.argpartition(-scores, most)[:most] if len(scores) > most else np.arange(len(scores))
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))].tolist()


class Windows:
    """Open window of one task; full ones become rows."""

    def __init__(self, task: int, window: int):
        self.next, self.window, self.space = task << 33, window, window
        self.parts: list[tuple] = []
        self.rows: list[tuple] = []

    def lay(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            n = min(self.space, len(ids) - start)
            self.parts.append((doc_id, ids, start, n))
            start += n
            self.space -= n
            if not self.space:
                self.close()

    def close(self) -> None:
        offset = 0
        for doc_id, ids, start, n in self.parts:
            self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), self.next, offset))
            offset += n
        self.next += 1
        self.parts, self.space = [], self.window

    def finish(self) -> None:
        """The rest, cut into powers of two."""
        rest, left = self.parts, self.window - self.space
        self.parts, self.space = [], self.window
        while left:
            size = 1 << (left.bit_length() - 1)
            self.window = self.space = size
            while self.space == size and rest or self.parts:
                doc_id, ids, start, n = rest.pop(0)
                take = min(n, self.space)
                self.parts.append((doc_id, ids, start, take))
                self.space -= take
                if take < n:
                    rest.insert(0, (doc_id, ids, start + take, n - take))
                if not self.space:
                    self.close()
                    break
            left -= size

    def batch(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows)], names=names)
        self.rows = []
        return out


def fill(index: Shard, shard: list[tuple], out: Windows, most: int) -> None:
    """Lay all documents of a shard: a seed, then its best unused neighbours; the one that crosses a window's end seeds the next."""
    used = np.zeros(len(shard), bool)
    for first in range(len(shard)):
        if used[first]:
            continue
        seed = first
        used[first] = True
        out.lay(*shard[first])
        while out.space < out.window:
            nearest = index.neighbours(seed, used, most)
            if not nearest:
                break
            for d in nearest:
                used[d] = True
                before = out.next
                out.lay(*shard[d])
                if out.next != before:  # it crossed the end: its rest is the next window's seed
                    seed = d
                    break


def _pack(idf: np.ndarray, mean: float, width: str, window: int, shard_tokens: int, shard_docs: int, query_terms: int, most: int):
    def filled(shard: list[tuple], out: Windows) -> None:
        fill(Shard([ids for _, ids in shard], idf, mean, query_terms), shard, out, most)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_of.cache_clear()  # this worker may have tokenised; its words aren't needed any more
        release()
        out, shard, held = Windows(TaskContext.get().partitionId(), window), [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_buffer(), dtype=width).copy()
                shard.append((doc_id, ids))
                held += len(ids)
                if held >= shard_tokens or len(shard) >= shard_docs:
                    filled(shard, out)
                    shard, held = [], 0
                    if out.rows:
                        yield out.batch()
        if shard:
            filled(shard, out)
        out.finish()
        if out.rows:
            yield out.batch()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = 1 << 20, shard_docs: int = 2000, query_terms: int = 16, neighbours: int = 12, task_shards: int = 16) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialise(rows.mapInArrow(_tokenise(path), TOKENS), "packing-tokens")
    texts = tokens.filter("uid >= 0")
    encoder = encoder_of(path)
    n, total = texts.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    df = np.zeros(encoder.size)
    for at, count in tokens.filter("uid < 0").select(F.posexplode("df")).filter("col > 0").groupBy("pos").agg(F.sum("col")).collect():  # a row per id of the vocabulary
        df[at] = count
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    sketched = texts.select("doc_id", "uid", "ids").mapInArrow(_sketched(sketch_ranks(df, idf), encoder.width), DEALT)
    ranges = -(-(total or 0) // (shard_tokens * task_shards))
    more = [ranges] if ranges > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = sketched.repartitionByRange(*more, "sketch", "uid").sortWithinPartitions("sketch", "uid").select("doc_id", "ids")
    run = _pack(idf, max(1.0, (total or 0) / max(n, 1)), encoder.width, window, shard_tokens, shard_docs, query_terms, neighbours)
    return dealt.mapInArrow(run, PIECES)


def op5_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
