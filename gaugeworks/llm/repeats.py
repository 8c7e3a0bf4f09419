"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Two suffixes are equal as far as the threshold goes if their windows of `length` bytes are equal. The windows are
refined from the most significant digit down, and what stands alone after a digit is dropped:

1. The leading digit of a window is its minimal gram, a fifth of the window long (by hash, the leftmost of equal
   ones): a function of the window's bytes alone, so equal windows share it at the same offset. Consecutive windows
   with one minimum are a run and travel as one entry, with a hash of the bytes that the run spans. Owners of digit
   ranges learn which digits have several contents; owners of content ranges learn which contents repeat: all windows
   of such a run do, those of a content that is alone under its digit don't.
2. Contents that are alone, but share their digit with others, are cut where the gram's offset in the window crosses
   a multiple of a fifth of the window. The windows of such a part all hold the same four fifths around the gram: the
   second digit, one key for up to 40 windows. Owners answer which keys occur again; other parts are dropped. Of a
   content that repeats, one block sends the parts for all.
3. The windows of the parts that are left take the last digit, the whole window. Each block sends a window's key once;
   equal groups are exactly the repeated windows.
4. Blocks of documents mark the answered windows and cut them out.

Every exchange is of packed sorted arrays, an entry for each block and key: a passage that a third of the documents
share is as many entries as there are blocks, never rows of windows, and no owner holds more than the keys of a fixed
number of bytes and an entry per block of a hot one.

Contents and windows are compared by 128 bits; among 10^13 of them two different ones meet with a chance of 10^-13.
The leading digit's 63 bits only decide what is compared at all: digits that meet cost a comparison, not a result.

Cases: a null text is empty; texts shorter than the window keep all bytes; a very long text is one row of one block
and is worked on in pieces; repeated rows and ties repeat each other; a cut may split a character, kept bytes are
counted and hashed as bytes, and `text` drops the halves; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.blocks import PACKED, answered, columns_of, joined, key_ranges, packed_batch, packed_rows, unpacked, with_answers, write_blocks
from gaugeworks.llm.common import documents, materialise, released
from gaugeworks.llm.windows import C1, bytes_of, grouped, super_windows, window_keys

LENGTH = 200
DIGITS, CONTENTS, KEYS = 0, 1, 2  # kinds of packed arrays; KEYS and above: pieces of a block
DECIDED = -1


def _runs(payload: bytes, length: int, at_once: int):
    """data, starts of the texts, and per run: text, place, number of windows, digit spread over 64 bits, its gram's place, two words of content."""
    data, starts, ends = bytes_of(unpacked(payload).column("text"))
    text, place, n, digit, gram = super_windows(data, starts, ends, length, length // 5, at_once)
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    content = np.frombuffer(b"".join(digest(view[a:b]) for a, b in zip(place.tolist(), (place + n + length - 1).tolist())), "<u8").reshape(-1, 2)
    return data, starts, text, place, n, digit * C1, gram, content[:, 0].copy(), content[:, 1].copy()


def _parts(place: np.ndarray, n: np.ndarray, gram: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Parts of runs whose gram's offset has one quotient by `width`: run, first window, number of windows, start of what they share."""
    most, least = gram - place, gram - place - n + 1
    kinds = most // width - least // width + 1
    run = np.repeat(np.arange(len(n)), kinds)
    quotient = (most // width)[run] - (np.arange(len(run)) - np.repeat(np.cumsum(kinds) - kinds, kinds))
    high, low = np.minimum(quotient * width + width - 1, most[run]), np.maximum(quotient * width, least[run])
    return run, gram[run] - high, high - low + 1, gram[run] - quotient * width


def _announce(length: int, parts: int, at_once: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                *_, digit, _, high, low = _runs(payload.as_py(), length, at_once)
                if not len(digit):
                    continue
                order = np.lexsort((high, digit))
                digits, first = np.unique(digit[order], return_index=True)
                least, most = high[order][first], high[order][np.append(first[1:], len(order)) - 1]
                rows = packed_rows(DIGITS, block, digits, [least, most], parts)
                _, first, many = grouped(high, low)
                rows += packed_rows(CONTENTS, block, high[first], [low[first], (many > 1).astype(np.uint8)], parts)
                yield packed_batch(rows)

    return run


def _answer(kind: int, sizes: np.ndarray, data: list[bytes]) -> list[bytes]:
    """Digits: whether they have several contents. Contents and keys: 0 alone, 1 repeated, 2 repeated and this block is the first to have it."""
    if kind == DIGITS:
        keys, least, most = columns_of(sizes, data, [np.uint64] * 3)
        number, _, count = grouped(keys, keys)
        order = np.argsort(number, kind="stable")
        cuts = np.cumsum(count) - count
        state = (np.minimum.reduceat(least[order], cuts) != np.maximum.reduceat(most[order], cuts)).astype(np.uint8)[number]
    else:
        high, low, many = columns_of(sizes, data, [np.uint64, np.uint64, np.uint8])
        number, first, count = grouped(high, low)
        state = (count + np.bincount(number, weights=many) > 1).astype(np.uint8)[number]
        state[first] *= 2
    ends = np.cumsum(sizes)
    return [state[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _keys(data: np.ndarray, place: np.ndarray, n: np.ndarray, width: int, at_once: int):
    """Keys of the `width` bytes from n consecutive places on, piece by piece: entries from, to, two words of key, groups of equal keys."""
    ends = np.cumsum(n + width - 1)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2 * at_once, side="right")))
        size = n[a:b] + width - 1
        base = np.cumsum(size) - size
        own = data[np.arange(size.sum()) + np.repeat(place[a:b] - base, size)]
        windows = np.arange(n[a:b].sum()) + np.repeat(base - np.cumsum(n[a:b]) + n[a:b], n[a:b])
        high, low = window_keys(own, windows, width)
        yield a, b, high, low, grouped(high, low)
        a = b


def _ask(block: int, keys, parts: int) -> list[tuple]:
    """Packed keys of a block, each once, and whether it has them more than once."""
    rows = []
    for piece, (_, _, high, low, (_, first, many)) in enumerate(keys):
        rows += packed_rows(KEYS + piece, block, high[first], [low[first], (many > 1).astype(np.uint8)], parts)
    return rows


def _told(told: list[dict], keys):
    """For each piece: entries from, to, and whether each key occurs again."""
    for piece, (a, b, _, _, (number, _, _)) in enumerate(keys):
        yield a, b, joined(told, KEYS + piece, np.uint8)[number] > 0


def _decided(block: int, sure: np.ndarray, open_: np.ndarray) -> tuple:
    """A block's state: (text, start, windows) of what goes; (text, start, windows, start of what they share) of open parts."""
    return (DECIDED, -1, block, len(sure), sure.astype("<i4").tobytes() + open_.astype("<i4").tobytes())


def _state(told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    for t in told:
        if t["kind"] == DECIDED:
            raw = np.frombuffer(t["data"], "<i4").astype(np.int64)
            return raw[: 3 * t["n"]].reshape(-1, 3), raw[3 * t["n"] :].reshape(-1, 4)
    return np.zeros((0, 3), np.int64), np.zeros((0, 4), np.int64)


def _sort_out(length: int, parts: int, at_once: int):
    """Per block: what is certain and which parts are open, and the second digits of these."""
    width = length // 5

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data, starts, text, place, n, digit, gram, high, low = _runs(payload.as_py(), length, at_once)
                if not len(digit):
                    continue
                told = told.as_py()
                mixed = joined(told, DIGITS, np.uint8)[np.unique(digit, return_inverse=True)[1]] > 0
                number, first, _ = grouped(high, low)
                state = joined(told, CONTENTS, np.uint8)
                shows = np.zeros(len(n), bool)
                shows[first] = state[number[first]] == 2
                sure = state[number] > 0
                open_ = mixed & (~sure | shows)
                run, at, size, shared = _parts(place[open_], n[open_], gram[open_], width)
                text_of = text[open_][run]
                decided = np.stack([text, place - starts[text], n], axis=1)[sure], np.stack([text_of, at - starts[text_of], size, shared - starts[text_of]], axis=1)
                if len(decided[0]) or len(decided[1]):
                    yield packed_batch([_decided(block, *decided), *_ask(block, _keys(data, shared, np.ones_like(shared), length - width + 1, at_once), parts)])

    return run


def _narrow(length: int, parts: int, at_once: int):
    """Per block: the parts whose second digit occurs again stay open; the keys of their windows."""
    width = length // 5

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                told = told.as_py() or []
                sure, open_ = _state(told)
                if not len(sure) and not len(open_):
                    continue
                data, starts, _ = bytes_of(unpacked(payload.as_py()).column("text"))
                base = starts[open_[:, 0]]
                stay = np.zeros(len(open_), bool)
                for a, b, again in _told(told, _keys(data, base + open_[:, 3], np.ones(len(open_), np.int64), length - width + 1, at_once)):
                    stay[a:b] = again
                open_, base = open_[stay], base[stay]
                yield packed_batch([_decided(block, sure, open_), *_ask(block, _keys(data, base + open_[:, 1], open_[:, 2], length, at_once), parts)])

    return run


def _covered(data: np.ndarray, starts: np.ndarray, told: list[dict], length: int, at_once: int) -> np.ndarray:
    """Which bytes of a block go."""
    step = np.zeros(len(data) + 1, np.int32)

    def mark(place, n):
        np.add.at(step, place, 1)
        np.add.at(step, place + n + length - 1, -1)

    sure, open_ = _state(told)
    mark(starts[sure[:, 0]] + sure[:, 1], sure[:, 2])
    place, n = starts[open_[:, 0]] + open_[:, 1], open_[:, 2]
    for a, b, again in _told(told, _keys(data, place, n, length, at_once)):
        hit = np.flatnonzero(again)
        windows = np.arange(len(again)) + np.repeat(place[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b])
        mark(windows[hit], np.ones(len(hit), np.int64))
    return np.cumsum(step[:-1]) > 0


def _cut_out(names: list[str], length: int, at_once: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, told in zip(batch.column(0), batch.column(1)):
                table = unpacked(payload.as_py())
                data, starts, ends = bytes_of(table.column("text"))
                gone = _covered(data, starts, told.as_py() or [], length, at_once)
                n_removed, n_spans, sha, kept = [], [], [], []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    own = gone[a:b]
                    removed = int(np.count_nonzero(own))
                    rest = data[a:b].tobytes() if not removed else data[a:b][~own].tobytes()
                    n_removed.append(removed)
                    n_spans.append(int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0)
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode("utf-8", "ignore"))
                table = table.combine_chunks()
                columns = [pa.array(kept, pa.string()) if n == "text" else table.column(n) for n in names]
                told_columns = [pa.array((ends - starts), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
                yield from pa.table([*columns, *told_columns], names=[*names, "_gw_bytes", "_gw_removed", "_gw_spans", "_gw_sha256"]).combine_chunks().to_batches()

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, at_once: int = 1 << 20) -> DataFrame:
    """docs with their texts cut, and _gw_bytes, _gw_removed, _gw_spans, _gw_sha256 of what was cut and kept.

    length: bytes of a window, 40 at least. at_once: bytes that a task works on together.
    """
    if length < 40 or at_once + 2 * length >= 1 << 21:
        raise ValueError("windows have 40 bytes at least, and pieces less than 2^21")
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    blocks = write_blocks(rows, "repeats")
    payloads, parts = blocks.select("block", "payload"), key_ranges(blocks)
    told = answered(payloads.mapInArrow(_announce(length, parts, at_once), PACKED), _answer)
    for k, step in enumerate((_sort_out, _narrow)):
        asked = materialise(with_answers(payloads, told, "told").select("block", "payload", "told").mapInArrow(step(length, parts, at_once), PACKED), f"repeats-asked-{k}")
        told = asked.filter(F.col("kind") == DECIDED).unionByName(answered(asked.filter(F.col("kind") >= KEYS), _answer, kinds_apart=False))
    fields = [f"`{f.name.replace('`', '``')}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*fields, "_gw_bytes long, _gw_removed long, _gw_spans long, _gw_sha256 string"])
    return with_answers(payloads, told, "told").select("payload", "told").mapInArrow(_cut_out(docs.columns, length, at_once), schema)


def op9_repeats(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", F.col("_gw_bytes").alias("n_bytes"), F.col("_gw_removed").alias("n_removed"), F.col("_gw_spans").alias("n_spans"), F.col("_gw_sha256").alias("kept_sha256"))
