"""The sliding window of calls: its width, its order over batch borders, and that nothing starts after a failure."""

import asyncio
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sampling


class Counted:
    """A call that counts how many are in flight."""

    def __init__(self, pause=lambda i: 0.002, fails=()):
        self.now = self.most = self.started = 0
        self.lock, self.pause, self.fails = threading.Lock(), pause, set(fails)

    def __call__(self, i):
        with self.lock:
            self.now, self.started = self.now + 1, self.started + 1
            self.most = max(self.most, self.now)
        time.sleep(self.pause(i))
        with self.lock:
            self.now -= 1
        if i in self.fails:
            raise ValueError(f"call {i}")
        return i * 10

    def coroutine(self):
        async def call(i):
            self.now, self.started = self.now + 1, self.started + 1
            self.most = max(self.most, self.now)
            try:
                await asyncio.sleep(self.pause(i))
            finally:
                self.now -= 1
            if i in self.fails:
                raise ValueError(f"call {i}")
            return i * 10

        return call


KINDS = {"threads": lambda c: c, "coroutines": lambda c: c.coroutine()}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("order", ["input", "completion"])
@pytest.mark.parametrize("workers", [1, 7, 100])
def test_width_and_order(kind, order, workers):
    c = Counted(lambda i: (0.3 if workers == 100 else 0.02) + (0.02 if i % 10 == 0 else 0))
    told = list(sampling.windowed(range(120), KINDS[kind](c), workers, order))
    assert sorted(told) == [(i, 10 * i) for i in range(120)]
    assert c.most == workers
    if order == "input" or workers == 1:
        assert told == sorted(told)
    else:
        assert told != sorted(told)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("order", ["input", "completion"])
def test_nothing_starts_after_a_failure(kind, order):
    c = Counted(lambda i: 0.001 if i == 3 else 0.05, fails=[3])
    began = time.perf_counter()
    with pytest.raises(ValueError, match="call 3"):
        list(sampling.windowed(range(400), KINDS[kind](c), 5, order))
    started = c.started
    assert started <= 6
    time.sleep(0.1)
    assert c.started == started and c.now == 0
    assert kind == "threads" or time.perf_counter() - began < 0.25  # what was in flight was cancelled


def test_a_reader_that_stops_stops_the_calls():
    c = Counted()
    told = sampling.windowed(range(1000), c, 4)
    next(told)
    told.close()
    assert c.started < 20 and c.now == 0


def test_early_results_are_bounded():
    """A slow first call holds back the others: no more than `ahead` wait for it."""
    gate = threading.Event()
    seen = []

    def call(i):
        seen.append(i)
        if i == 0:
            gate.wait(5)
        return i

    def release():
        time.sleep(0.3)
        assert len(seen) <= 20
        gate.set()

    threading.Thread(target=release).start()
    assert [v for _, v in sampling.windowed(range(300), call, 4, "input", ahead=20)] == list(range(300))


def test_order_over_batches_and_types(spark):
    """Arrow batches of 50 rows: the window goes over their borders, order stays, and columns keep their types and nulls."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(300, numPartitions=1).select(F.col("id").cast("string").alias("p"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("n"), F.array("id").alias("a"))

        def answer(p):
            time.sleep(0.05 if int(p) % 50 == 49 else 0.0)
            return f"r{p}"

        told = sampling.external(df, "p", answer, workers=8, order="input").collect()
        assert [(r["p"], r["n"], r["a"], r["response"]) for r in told] == [(str(i), i if i % 7 else None, [i], f"r{i}") for i in range(300)]
        assert all(r["latency_ms"] >= 50 for r in told if int(r["p"]) % 50 == 49)
        late = [int(r["p"]) for r in sampling.external(df, "p", answer, workers=8, order="completion").collect()]
        assert sorted(late) == list(range(300)) and late.index(49) > late.index(50)  # the next batch doesn't wait for it
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_failing_call_fails_the_job_early(spark, tmp_path):
    folder = str(tmp_path)

    def answer(p):
        with open(os.path.join(folder, p), "w"):
            pass
        time.sleep(0.02)
        if p == "0":
            raise RuntimeError("refused")
        return p

    df = spark.range(400, numPartitions=1).select(F.col("id").cast("string").alias("p"))
    with pytest.raises(Exception, match="refused"):
        sampling.external(df, "p", answer, workers=4).collect()
    assert len(os.listdir(folder)) <= 12  # of 400


def test_mapped_rows_by_coroutines(spark):
    async def double(row):
        await asyncio.sleep(0.001)
        return None if row["id"] == 3 else {"v": row["id"] * 2, "w": None if row["id"] == 4 else "x"}

    told = sampling.map_rows(spark.range(6, numPartitions=1), double, "v long, w string", workers=3).collect()
    assert [(r["v"], r["w"]) for r in told] == [(0, "x"), (2, "x"), (4, "x"), (8, None), (10, "x")]
    assert sampling.map_rows(spark.range(100), lambda r: {"v": r["id"]}, "v long", max_items=7).count() == 7
