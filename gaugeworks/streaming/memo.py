"""The step memo as a stream: messages that ask for steps or tell their results, decided one by one from kept state.

Messages: run_id, step_key, ord (their order within a step), kind (`begin` or `finish`), input_hash, output, error. State
is kept for each (run_id, step_key) in the state store: the step's hash, status and output. Decisions:

    start      nothing is known of the step: it runs
    continue   it is running: run it again under its id
    retry      it has failed: it runs again
    reuse      it is completed: its output
    clash      it is known with another input: nothing changes
    finish     a result was taken
    unknown    a result of a step nobody asked for: nothing changes

Messages of a step within one micro-batch are put in order in memory; earlier batches count as earlier, whatever their
`ord`. The same state machine over a table, with one batch, is what plans.store does in its two calls.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MESSAGES = "run_id long, step_key string, ord long, kind string, input_hash string, output string, error string"
DECISIONS = "run_id long, step_key string, ord long, decision string, output string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(state: tuple | None, kind: str, input_hash: str | None, output: str | None, error: str | None) -> tuple[tuple | None, str, str | None]:
    """(new state, decision, output to reuse). state: (hash, status, output), None for an unknown step."""
    if kind == "finish":
        if state is None:
            return None, "unknown", None
        return (state[0], "failed" if error is not None else "completed", None if error is not None else output), "finish", None
    if state is None:
        return (input_hash, "running", None), "start", None
    if state[0] != input_hash:
        return state, "clash", None
    if state[1] == "completed":
        return state, "reuse", state[2]
    return (input_hash, "running", None), "retry" if state[1] == "failed" else "continue", None


class Memo(StatefulProcessor):
    def init(self, handle) -> None:
        self.step = handle.getValueState("step", "input_hash string, status string, output string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = now = tuple(self.step.get()) if self.step.exists() else None
        for m in sorted(rows, key=lambda m: m["ord"]):
            now, decision, output = decided(now, m["kind"], m["input_hash"], m["output"], m["error"])
            yield Row(run_id=key[0], step_key=key[1], ord=m["ord"], decision=decision, output=output)
        if now != before:
            self.step.update(now)

    def close(self) -> None:
        pass


def decisions(messages: DataFrame) -> DataFrame:
    """A stream of messages to a stream of decisions."""
    return messages.select(*[c.split()[0] for c in MESSAGES.split(", ")]).groupBy("run_id", "step_key").transformWithState(Memo(), DECISIONS, "Append", "None")


@contextmanager
def state_store(spark: SparkSession):
    """While a query starts: the state store that arbitrary state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def replay(messages: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Decide what is there now, going on from the checkpoint, and append it to the folder `out`: all decisions so far."""
    spark = messages.sparkSession
    with state_store(spark):
        writer = decisions(messages).writeStream.format("parquet").outputMode("append")
        query = writer.option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(DECISIONS).parquet(out)


def of_orders(orders: DataFrame) -> DataFrame:
    """Orders as messages to their customers' steps: two of three ask, one tells a result; some ask with another input."""
    k = F.col("o_orderkey")
    begins = k % 3 < 2
    return orders.select(
        (F.col("o_custkey") % 10).cast("long").alias("run_id"), F.col("o_custkey").cast("string").alias("step_key"), k.alias("ord"), F.when(begins, "begin").otherwise("finish").alias("kind"),
        F.when(begins, F.when(k % 11 == 0, "other").otherwise("same")).alias("input_hash"), F.when(~begins, F.concat(F.lit("out-"), k)).alias("output"), F.when(~begins & (k % 2 == 0), "broken").alias("error"),
    )
