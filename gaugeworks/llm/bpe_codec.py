"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

Encoding. A nondeterministic reader of a piece's bytes runs one thread per position where a token may
still be in progress: (place in the token trie, token before it, output so far). A token may follow
another only if merging their joined bytes gives back the two, so exactly one output survives at each
position. The subset construction is done lazily: a state is the set of threads with their outputs cut
by the common prefix, which is emitted at that moment. No thread is longer than the longest token, so
the lookahead is bounded. States and arcs are made when first needed. Once there are `max_states` of
them, all but the one that is being left are dropped, within a piece too.

Decoding. Token ids are read one by one; complete characters leave at once, the bytes of an unfinished
one stay in the state. Ill-formed input yields U+FFFD per maximal ill-formed part, as Unicode advises.

Cases: a null text is empty and has no ids; special tokens' strings are ordinary text; repeated rows
are encoded alike; an empty table gives an empty result; other columns are ignored. A very long text
costs memory of its own size and its ids', whether it has blanks or not; words that return are kept up
to a number of bytes. Ties don't arise: ranks differ. Text that Spark holds is valid UTF-8, so decoding
gives back its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, vocabulary_path


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Merges:
    """Ranked merges: how a token splits, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.together: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """The merges applied to text in rank order, leftmost first: the definition that all else follows."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether right may follow left; left is -1 at the start of a piece."""
        known = self.together.get((left, right))
        if known is None:
            if len(self.together) > 1_000_000:
                self.together.clear()
            joined = [left, right] if left >= 0 else [right]
            known = self.together[left, right] = self.merged(b"".join(map(self.token.__getitem__, joined))) == joined
        return known


class Transducer:
    """Reads bytes, emits token ids as soon as no continuation can change them."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 250_000):
        self.merges, self.max_states = Merges(ranks), max_states
        # The trie of the tokens: node -> byte -> node, and the token that ends at a node.
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            at = 0
            for b in token:
                step = self.child[at].get(b)
                if step is None:
                    step = self.child[at][b] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                at = step
            self.ends[at] = rank
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.reset()

    def reset(self) -> None:
        root = ((0, -1, ()),)
        self.number = {root: 0}
        self.threads = [root]
        self.flush: list[tuple[int, ...]] = [()]
        self.arcs.clear()  # the same dict, for a piece may be in progress

    def only(self, state: int) -> int:
        """Drop all states but the root and this one; its new number."""
        key = self.threads[state]
        self.reset()
        if key not in self.number:
            self.number[key] = len(self.threads)
            self.threads.append(key)
            self.flush.append(key[-1][2])
        return self.number[key]

    def arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one step: (next state, tokens that are now certain)."""
        if len(self.threads) > self.max_states or len(self.arcs) > 8 * self.max_states:
            state = self.only(state)
        alive, fresh = [], None
        for node, before, output in self.threads[state]:
            step = self.child[node].get(byte)
            if step is None:
                continue
            if self.child[step]:
                alive.append((step, before, output))
            token = self.ends[step]
            if token >= 0 and fresh is None and self.merges.adjacent(before, token):
                fresh = (0, token, (*output, token))
        alive.append(fresh)
        shared = alive[0][2]
        for _, _, output in alive[1:]:
            n = 0
            while n < len(shared) and n < len(output) and shared[n] == output[n]:
                n += 1
            shared = shared[:n]
        cut = len(shared)
        key = tuple((node, before, output[cut:]) for node, before, output in alive)
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.threads)
            self.threads.append(key)
            self.flush.append(key[-1][2])
        self.arcs[state << 8 | byte] = result = (target, shared)
        return result

    def encode(self, piece: bytes) -> list[int]:
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            step = arcs.get(state << 8 | byte) or self.arc(state, byte)
            state = step[0]
            if step[1]:
                out.extend(step[1])
        out.extend(self.flush[state])
        return out


class Utf8Stream:
    """An incremental UTF-8 reader over tokens; steps of (state, token) are remembered."""

    def __init__(self, tokens: dict[int, bytes], remembered: int = 500_000):
        self.tokens, self.remembered = tokens, remembered
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.pending = b""

    @staticmethod
    def expected(lead: int) -> tuple[int, int, int]:
        """Bytes that follow a lead byte, and the range of the first of them; 0 bytes for ASCII, -1 if it can't lead."""
        if lead < 0x80:
            return 0, 0, 0
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return -1, 0, 0

    @classmethod
    def read(cls, data: bytes) -> tuple[str, bytes]:
        """Characters that are certain, and the bytes of an unfinished one."""
        out, at, end = [], 0, len(data)
        while at < end:
            need, lo, hi = cls.expected(data[at])
            if need < 0:
                out.append("�")
                at += 1
                continue
            got = 0
            while got < need and at + 1 + got < end and (lo if not got else 0x80) <= data[at + 1 + got] <= (hi if not got else 0xBF):
                got += 1
            if got == need:
                out.append(data[at : at + need + 1].decode())
            elif at + 1 + got == end:
                return "".join(out), data[at:]
            else:
                out.append("�")
            at += got + 1
        return "".join(out), b""

    def feed(self, ids: Iterable[int]) -> str:
        steps, pending, out = self.steps, self.pending, []
        for i in ids:
            step = steps.get((pending, i))
            if step is None:
                if len(steps) > self.remembered:
                    steps.clear()
                step = steps[pending, i] = self.read(pending + self.tokens[i])
            out.append(step[0])
            pending = step[1]
        self.pending = pending
        return "".join(out)

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return "�" if rest else ""


class Codec:
    """Text to ids and back; words that return are kept in a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 64 << 20):
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.stream = Utf8Stream(self.transducer.merges.token)
        self.remembered, self.held = remembered, 0  # bytes
        self.known: dict[str, tuple[int, ...]] = {}

    def _pieces(self, text: str) -> tuple[int, ...]:
        encode = self.transducer.encode
        return tuple(chain.from_iterable([encode(p.encode()) for p in self.split(text)]))

    def encode(self, text: str) -> list[int]:
        """A space between two characters that aren't white space starts a piece, so what lies between such spaces is coded apart."""
        first, *rest = text.split(" ")
        known = self.known
        new = set(rest).difference(known)
        if new and self.held > self.remembered:
            known.clear()
            new, self.held = set(rest), 0
        for w in new:
            if not w or w[0].isspace() or w[-1].isspace():
                return [*self._pieces(text)]
            known[w] = self._pieces(" " + w)
            self.held += len(w) + 8 * len(known[w]) + 150
        if first[-1:].isspace():
            return [*self._pieces(text)]
        return [*self._pieces(first), *chain.from_iterable(map(known.__getitem__, rest))]

    def decode(self, ids: Iterable[int]) -> str:
        return self.stream.feed(ids) + self.stream.close()


@lru_cache(maxsize=2)
def codec_of(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(read_ranks(path), pattern)


def _coded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        digits: dict[int, str] = {i: str(i) for i in codec.transducer.merges.token}
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids of each whole text."""
    import public_tokenizers

    path, pattern = path or vocabulary_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches):
        codec = codec_of(path, pattern)
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each list of ids; unfinished or ill-formed parts become U+FFFD."""
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches):
        stream = Utf8Stream({rank: token for token, rank in read_ranks(path).items()})
        for batch in batches:
            texts = [stream.feed(i.as_py() or ()) + stream.close() for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op4_bpe_codec(spark, sf_dir):
    import public_tokenizers

    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    run = _coded(vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
