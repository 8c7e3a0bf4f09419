"""The store's commits: nothing half-done shows, readers open their own run's files, snapshots change nothing, and repeated batches count once."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.plans.store import Store, StoreError
from gaugeworks.sources.commits import CommitConflict, CommitLog
from gaugeworks.sources.metrics import MetricStore

STEP = "step_key string, input_hash string"
RESULT = "step_key string, output string, error string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def wanted(spark, *keys, digest="h"):
    return spark.createDataFrame([(k, digest) for k in keys], STEP)


def state(store, run):
    return {r["step_key"]: (r["status"], r["output"], r["error"]) for r in store.steps(run).collect()}


def kinds(store, run):
    return sorted(r["event_type"] for r in store.events(run).collect())


def test_a_crash_before_the_commit_leaves_the_old_state(spark, store, monkeypatch):
    run = store.create_run("w")
    store.begin_steps(run, wanted(spark, "a", "b"))
    before = state(store, run), kinds(store, run)

    def dies(*_, **__):
        raise OSError("the machine is gone")

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", dies)
        for change in (lambda: store.finish_steps(run, spark.createDataFrame([("a", "1", None)], RESULT)), lambda: store.begin_steps(run, wanted(spark, "c")), lambda: store.fail_run(run, "x")):
            with pytest.raises(OSError):
                change()
    assert (state(store, run), kinds(store, run)) == before
    # What the dead writer left lies in the folder, and no view over all runs sees it either.
    assert store.records("steps").count() == 2 and store.records("events").count() == 3 and store.runs().first()["status"] == "running"
    store.finish_steps(run, spark.createDataFrame([("a", "1", None)], RESULT))
    assert state(store, run)["a"] == ("completed", "1", None)


def test_reuse_clash_and_failure(spark, store):
    run = store.create_run("w")
    store.begin_steps(run, wanted(spark, "done", "broken", "open"))
    store.finish_steps(run, spark.createDataFrame([("done", "7", None), ("broken", None, "boom"), ("broken", "late", None)], RESULT))
    todo, reused = store.begin_steps(run, wanted(spark, "done", "broken", "open", "new").withColumn("extra", F.concat(F.lit("x-"), "step_key")))
    ids = {r["step_key"]: r["id"] for r in store.steps(run).collect()}
    assert {(r["step_key"], r["extra"], r["step_id"]) for r in todo.collect()} == {(k, f"x-{k}", ids[k]) for k in ("broken", "open", "new")}
    assert [(r["step_key"], r["output"], r["extra"]) for r in reused.collect()] == [("done", "7", "x-done")]
    messages = sorted(r["message"] for r in store.events(run).filter("event_type = 'step.started'").collect())
    assert messages == ["Retried step broken", "Started step broken", "Started step done", "Started step new", "Started step open"]  # an open one isn't started again
    before = state(store, run)
    with pytest.raises(StoreError, match="another input"):
        store.begin_steps(run, wanted(spark, "fresh", "done", digest="other"))
    with pytest.raises(StoreError, match="no step"):
        store.finish_steps(run, spark.createDataFrame([("open", "1", None), ("nobody", "1", None)], RESULT))
    assert state(store, run) == before  # nothing of a refused change is there


def test_repeated_rows_are_executed_once_and_alike(spark, store):
    run = store.create_run("w")
    rows = spark.createDataFrame([("k", "h", "second"), ("k", "h", "first"), ("k", "h", "third")], STEP + ", extra string")
    todo, _ = store.begin_steps(run, rows.repartition(3))
    assert [(r["step_key"], r["extra"]) for r in todo.collect()] == [("k", "first")]


def test_of_two_writers_the_second_is_refused(spark, store, tmp_path):
    run = store.create_run("w")
    log = CommitLog(spark, str(tmp_path / "s" / "runs"))
    seen = log.entries(run)
    store.set_output(run, "{}")
    with pytest.raises(CommitConflict):
        log.commit(run, seen, run={})
    assert store.get_run(run)["output"] == "{}"
    other = Store(spark, str(tmp_path / "s"))
    stale = other.log.entries(run)
    store.begin_steps(run, wanted(spark, "a"))
    other.log.entries = lambda _: stale
    with pytest.raises(StoreError, match="meanwhile"):
        other.begin_steps(run, wanted(spark, "b"))
    assert set(state(store, run)) == {"a"}


def test_a_reader_opens_its_own_runs_files(spark, store):
    runs = [store.create_run("w") for _ in range(3)]
    for run in runs:
        store.begin_steps(run, wanted(spark, f"s{run}"))
        store.metrics.emit_one(run, "m", run)
        store.metrics.flush(run)
    for frame in (store.steps(runs[1]), store.events(runs[1]), store.metrics.points(runs[1])):
        assert frame.inputFiles() and all(f"run_id={runs[1]}/" in f for f in frame.inputFiles())


def test_compaction(spark, tmp_path):
    """Snapshots come by themselves; state, events, reuse and further changes are as without them."""
    plain, dense = Store(spark, str(tmp_path / "p"), compact_after=1000), Store(spark, str(tmp_path / "d"), compact_after=3)
    told = []
    for s in (plain, dense):
        run = s.create_run("w")
        for i in range(4):
            s.begin_steps(run, wanted(spark, f"a{i}", f"b{i}"))
            s.finish_steps(run, spark.createDataFrame([(f"a{i}", str(i), None), (f"b{i}", None, "no")], RESULT))
        _, reused = s.begin_steps(run, wanted(spark, "a0", "b0", "a3"))
        told.append((state(s, run), kinds(s, run), sorted(r["output"] for r in reused.collect()), s.steps().count()))
        entries = s.log.entries(run)
    assert told[0] == told[1] and sum("snapshot" in e for e in entries) >= 2
    assert len(dense.steps(run).inputFiles()) < len(dense.events(run).inputFiles())


def test_batches_of_points_count_once(spark, tmp_path, monkeypatch):
    m = MetricStore(spark, str(tmp_path / "m"))
    values = lambda: sorted(r["metric_value"] for r in m.points(1).collect())
    for batch in ("x/0", "x/0", "x/1", "x/0"):
        m.emit_one(1, "m", float(batch[-1]))
        m.flush(1, batch)
    assert values() == [0.0, 1.0] and m.pending is None
    m.emit_one(1, "m", 9.0)
    with monkeypatch.context() as p:
        p.setattr(CommitLog, "commit", lambda *_, **__: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            m.flush(1)
    assert values() == [0.0, 1.0]
    m.mode = "replace"
    m.flush(1)  # still pending, and now it replaces
    assert values() == [9.0]


def test_stream_of_points_with_a_death_between(spark, tmp_path):
    """A stream whose sink dies after its commit and before Spark's own: the batch comes again, and its points are there once."""
    source = tmp_path / "in"
    schema = "step_id long, metric_name string, metric_value double, unit string, created_at timestamp, ord long"
    m = MetricStore(spark, str(tmp_path / "m"))
    sink, deaths = m.stream_sink(3, "feed"), [1]

    def dying(rows, number):
        sink(rows, number)
        if number == 1 and deaths:
            deaths.pop()
            raise OSError("gone after the commit")

    def pour():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.writeStream.foreachBatch(dying).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        spark.createDataFrame([(i, "m", float(i), None, None, i)], schema).coalesce(1).write.mode("append").parquet(str(source))
    with pytest.raises(Exception, match="gone after"):
        pour()
    pour()
    assert sorted(r["metric_value"] for r in m.points(3).collect()) == [0.0, 1.0, 2.0]
