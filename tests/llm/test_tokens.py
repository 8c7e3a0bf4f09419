import base64
import hashlib
import sys
import zlib
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import cases
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import bpe_codec, packing

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe_codec.Codec(RANKS, P.PATTERN)
LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
ENCODER = packing.Encoder(P.path("byte_bpe_50k.json"))


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from([*"ab the's ingtion.,!?|\n\t 01²é日🙂\x1c\x85\xa0", "<|endoftext|>", "<|endoftext", " hello", "onesbleed", "Ätz"])).map("".join))
def test_codecs_equal_the_libraries(text):
    ids = CODEC.encode(text)
    assert ids == ENCODING.encode_ordinary(text) and CODEC.decode(ids) == text
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.width).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_stream(data):
    stream = bpe_codec.Utf8Stream({i: bytes([i]) for i in range(256)})
    assert "".join(stream.feed([b]) for b in data) + stream.close() == data.decode("utf-8", "replace")


def test_transducer_is_bounded():
    small = bpe_codec.Transducer(RANKS, max_states=50)
    for word in (b" hello", b" undetermined", b" aaaaaaaaaaaaaaaaaaaaaaaa", b"\xf0\x9f\x99\x82" * 3, b" hello"):
        assert small.encode(word) == ENCODING._encode_bytes(word) and len(small.threads) <= 51


def test_long_texts_without_blanks_stay_bounded():
    letters = np.random.default_rng(3).integers(97, 123, 300_000).astype(np.uint8).tobytes()
    codec = bpe_codec.Codec(RANKS, P.PATTERN, remembered=4000)
    codec.transducer.max_states = 1000
    for text in (letters.decode(), "ab" * 100_000):
        ids = codec.encode(text)
        assert ids == ENCODING.encode_ordinary(text) and codec.decode(ids) == text
        assert len(codec.transducer.threads) <= 1001 and len(codec.transducer.arcs) <= 8001
    for i in range(200):
        codec.encode(f"w{i} " + f"word{i}" * 20)
        assert codec.held < 4000 + 1000 and len(codec.known) < 40


def test_op4_on_cases(spark):
    df = cases.docs(spark)
    rows = df.select("doc_id", "text").collect()
    told = bpe_codec.encode_documents(df).collect()
    assert [r["ids"] for r in told] == [ENCODING.encode_ordinary(r["text"] or "") for r in rows]
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(df)).collect()
    assert [r["text"] for r in back] == [r["text"] or "" for r in rows]
    assert bpe_codec.encode_documents(cases.empty(spark)).count() == 0
    digest = spark.createDataFrame([(1, "<|endoftext|> x")], "doc_id long, text string").mapInArrow(bpe_codec._coded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").first()
    ids = ENCODING.encode_ordinary("<|endoftext|> x")
    assert digest["n_tokens"] == len(ids) and digest["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digest["decoded_sha256"] == hashlib.sha256(b"<|endoftext|> x").hexdigest()


class Untravelled(dict):
    """A memory that is looked up, never gone through."""

    def __iter__(self):
        raise AssertionError("all remembered words were gone through")


def test_new_words_cost_no_pass_over_the_memory():
    encoder = packing.Encoder(P.path("byte_bpe_50k.json"))
    encoder.known = Untravelled()
    for text in ("one house, two houses. three! word.", "\0 a\0 new, word?! Ätz, 日, é,.!", "", " ", "a" * 101 + ", x"):
        assert np.frombuffer(encoder.encode([text])[0], encoder.width).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]


def test_words_and_portions():
    import pyarrow as pa

    for words in ([""], ["a"], ["a", "", "b\0\n", "é日"]):
        assert packing.spaceless(pa.array(words)) == words
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abc", None, "", "x" * 50, "éé", "y"])], names=["doc_id", "text"])
    assert [p.column(0).to_pylist() for p in packing.portions(batch, 5)] == [[0, 1, 2], [3], [4, 5]]
    assert [p.num_rows for p in packing.portions(batch.slice(3), 1 << 20)] == [3] and not [*packing.portions(batch.slice(0, 0))]


def test_document_frequencies_beyond_a_byte(spark):
    texts = [f"the word {i % 7}" if i % 3 else None for i in range(700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = np.zeros(ENCODER.size, int)
    for t in texts:
        want[list({*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0})] += 1
    told = [r["df"] for r in df.mapInArrow(packing._tokenise(P.path("byte_bpe_50k.json")), packing.TOKENS).filter("uid < 0").collect()]
    assert np.sum(told, axis=0).tolist() == want.tolist() and want.max() == 700


@pytest.mark.parametrize("settings_", [{}, {"shard_tokens": 3000, "shard_docs": 5, "neighbours": 2, "query_terms": 4}])
def test_packing(spark, settings_):
    df = cases.docs(spark).repartition(2)
    want = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        want[r["doc_id"]].append([*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    pieces = packing.pack_documents(df, **settings_).collect()
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        parts[p["doc_id"]].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        size = sum(p["length"] for p in own)
        assert size <= 1024 and size & (size - 1) == 0  # nothing is padded at all
    assert set(parts) == set(want)
    for i, texts in want.items():
        assert sum(p["length"] for p in parts[i]) == sum(map(len, texts))
        crcs = {(len(t), s, n): zlib.crc32(np.array(t[s : s + n], "<u4").tobytes()) for t in texts for p in parts[i] for s, n in [(p["start"], p["length"])]}
        for p in parts[i]:
            assert p["ids_crc32"] in {zlib.crc32(np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for t in texts if len(t) == p["doc_tokens"]}
        assert crcs
    assert packing.pack_documents(cases.empty(spark)).count() == 0


def test_special_tokens_and_long_words():
    texts = ["stop <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftext|> <|endoftext|>", "x" * 5000 + " y", "é" * 300 + " abc", "word" * 60 + " word" * 60]
    assert [np.frombuffer(b, ENCODER.width).tolist() for b in ENCODER.encode(texts)] == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ENCODER.encode(["stop <|endoftext|> x"])[0] == np.array([11338, 220, 50256, 2124, 0], ENCODER.width).tobytes()


def test_every_piece_of_the_vocabulary():
    words = sorted({t.decode() for t in RANKS if t.isascii() and not t.isspace() and len(t.split()) == 1 and t.strip() == t})
    told = ENCODER.encode(["x " + w for w in words])
    assert [np.frombuffer(b, ENCODER.width).tolist() for b in told] == [[*e.ids, 0] for e in LIBRARY.encode_batch(["x " + w for w in words], add_special_tokens=False)]


def slow_packing(docs, window, most, query_terms):
    """The windows of one shard, by the definition: (document, length) of each piece, window by window."""
    n, df = len(docs), defaultdict(int)
    for d in docs:
        for t in set(d):
            df[t] += 1
    idf = {t: np.float32(np.log(1 + (n - c + 0.5) / (c + 0.5))) for t, c in df.items()}
    mean = sum(map(len, docs)) / n

    def score(seed, d):
        terms = sorted(set(docs[seed]) - {0}, key=lambda t: -idf[t])[:query_terms]
        return sum(idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)) for t in terms if (tf := docs[d][:-1].count(t)))

    used, out, room = set(), [[]], window

    def lay(d):
        nonlocal room
        left, crossed = len(docs[d]), False
        used.add(d)
        while left:
            k = min(room, left)
            out[-1].append((d, k))
            left, room = left - k, room - k
            if not room:
                out.append([])
                room, crossed = window, True
        return crossed

    for first in range(n):
        if first in used:
            continue
        seed = first
        lay(seed)
        while room < window:
            best = sorted(((-score(seed, d), d) for d in range(n) if d not in used), key=lambda x: (round(x[0], 4), x[1]))
            best = [d for s, d in best if s < 0][:most]
            if not best:
                break
            for d in best:
                if lay(d):
                    seed = d
                    break
    return [w for w in out if sum(k for _, k in w) == window]


def test_filling_against_brute_force():
    r = np.random.default_rng(8)
    docs = [[*r.choice(np.arange(1, 60), r.integers(3, 30)).tolist(), 0] for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    index = packing.Shard([np.array(d) for d in docs], idf, sum(map(len, docs)) / len(docs), 100)
    out = packing.Windows(0, 64)
    packing.fill(index, [(i, np.array(d)) for i, d in enumerate(docs)], out, 5)
    got = defaultdict(list)
    for doc, _, length, _, _, sequence, _ in out.rows:
        got[sequence].append((doc, length))
    assert list(got.values()) == slow_packing(docs, 64, 5, 100)


def test_bm25_neighbours():
    docs = [np.array(x + [0], np.uint16) for x in ([1, 2, 3], [1, 2, 9], [7, 8], [1, 2, 3, 3])]
    idf = np.ones(10, np.float32)
    shard = packing.Shard(docs, idf, 4.0, 16)
    used = np.array([True, False, False, False])
    assert shard.neighbours(0, used, 5) == [3, 1]
    used[3] = True
    assert shard.neighbours(0, used, 5) == [1] and shard.neighbours(2, used, 5) == [2]


def test_packing_puts_neighbours_together(spark):
    import random

    r = random.Random(1)
    topics = [[cases.words(r, 40, letters).split() for _ in range(1)][0] for letters in ("abcd", "efgh", "ijkl", "mnop")]
    rows = [(i, " ".join(r.choice(topics[i % 4]) for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    own = defaultdict(set)
    for p in packing.pack_documents(df).collect():
        own[p["sequence_id"]].add(p["doc_id"] % 4)
    assert sum(map(len, own.values())) / len(own) < 2.2  # four at random


def test_packing_sketches_tell_documents_apart():
    r = np.random.default_rng(5)
    docs = [np.append(r.choice(np.arange(1, 400), 40), packing.END) for _ in range(60)]
    docs += docs[:20]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    size = np.array([len(d) for d in docs])
    told = packing.sketches(np.concatenate(docs), np.cumsum(size) - size, packing.sketch_ranks(df, idf)).tolist()
    assert told[60:] == told[:20] and len(set(told)) > 50 and min(told) >= 0


def test_packing_copies_far_apart_meet(spark):
    import random

    r = random.Random(2)
    texts = [cases.words(r, 40, "abcdefghijklmnop") for _ in range(60)]
    df = spark.createDataFrame([(i, texts[i % 60]) for i in range(120)], "doc_id long, text string").coalesce(1)
    own = defaultdict(set)
    for p in packing.pack_documents(df, shard_docs=12).collect():
        own[p["doc_id"]].add(p["sequence_id"])
    assert sum(bool(own[i] & own[i + 60]) for i in range(60)) > 40  # none when rows are dealt in input order


def test_packing_ranges_grow_with_the_ids(spark):
    """Beyond the session's shuffle partitions a task has a bounded share, and every id still lies in one piece."""
    df = spark.createDataFrame([(i, f"word{i} " * (1 + i % 50)) for i in range(400)], "doc_id long, text string")
    pieces = packing.pack_documents(df, shard_tokens=64, task_shards=2)
    rows = pieces.collect()
    assert len({p["sequence_id"] >> 33 for p in rows}) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = defaultdict(list)
    for p in rows:
        got[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
    assert len(got) == 400
    for own in got.values():
        at = 0
        for start, length, size in sorted(own):
            assert start == at
            at += length
        assert at == size
