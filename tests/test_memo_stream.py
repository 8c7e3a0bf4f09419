"""The memo as a stream: the same decisions as one pass over the log, as the store's own calls, and after restarts."""

import random

from gaugeworks.plans.store import Store
from gaugeworks.streaming import memo


def messages(seed=7, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        begins = r.random() < 0.6
        out.append((r.randint(1, 3), f"s{r.randint(0, 20)}", i, "begin" if begins else "finish", ("other" if r.random() < 0.1 else "same") if begins else None, None if begins else f"o{i}", None if begins or r.random() < 0.6 else "broken"))
    return out


def test_decisions_survive_restarts(spark, tmp_path):
    """Five starts from one checkpoint, each with new messages: every message decided once, as one pass would."""
    rows = messages()
    state, want = {}, []
    for run, key, ord_, kind, digest, output, error in rows:
        state[run, key], decision, reused = memo.decided(state.get((run, key)), kind, digest, output, error)
        want.append((run, key, ord_, decision, reused))
    assert {w[3] for w in want} == {"start", "continue", "retry", "reuse", "clash", "finish", "unknown"}
    source, told = str(tmp_path / "in"), None
    for i in range(0, len(rows), 80):
        part = rows[i : i + 80]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, memo.MESSAGES).repartition(2).write.mode("append").parquet(source)
        told = memo.replay(spark.readStream.schema(memo.MESSAGES).parquet(source), str(tmp_path / "c"), str(tmp_path / "out"))
    assert sorted(map(tuple, told.collect()), key=lambda r: r[2]) == want


def test_decisions_equal_the_stores(spark, tmp_path):
    """A log of four calls, by the store and by the stream: who runs, who is reused with which output."""
    store = Store(spark, str(tmp_path / "s"))
    run = store.create_run("w")
    keys, log, by_store = [f"k{i}" for i in range(9)], [], {}
    step, result = "step_key string, input_hash string", "step_key string, output string, error string"
    for call in range(3):
        asked = keys[: 3 * (call + 1)]
        todo, reused = store.begin_steps(run, spark.createDataFrame([(k, "h") for k in asked], step))
        by_store |= {(call, r["step_key"]): None for r in todo.collect()} | {(call, r["step_key"]): r["output"] for r in reused.collect()}
        log += [(run, k, call * 100 + i, "begin", "h", None, None) for i, k in enumerate(asked)]
        ended = [(k, None if i % 2 else f"{call}-{k}", "bad" if i % 2 else None) for i, k in enumerate(asked[call : call + 3])]
        store.finish_steps(run, spark.createDataFrame(ended, result))
        log += [(run, k, call * 100 + 50 + i, "finish", None, o, e) for i, (k, o, e) in enumerate(ended)]
    spark.createDataFrame(log, memo.MESSAGES).write.parquet(str(tmp_path / "in"))
    told = memo.replay(spark.readStream.schema(memo.MESSAGES).parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "out")).filter("decision <> 'finish'").collect()
    assert {(r["ord"] // 100, r["step_key"]): r["output"] for r in told} == by_store
    assert {r["decision"] for r in told} == {"start", "continue", "retry", "reuse"}
