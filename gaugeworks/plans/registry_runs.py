"""Registered queries that work the stores, sinks, sources and samplers themselves, each with the SQL that states its result."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions import hashing, json_values, similarity, text
from gaugeworks.operators import compare, confusion, embedding, prepare, sampling, template
from gaugeworks.plans import evaluate, report
from gaugeworks.plans.registry import _CELLS, _PREDICTED, LABELS, _points, _run_steps, query, table
from gaugeworks.plans.store import Store, sample_objects
from gaugeworks.session import shared_folder
from gaugeworks.sources import config, datasets, paged
from gaugeworks.sources.config import Style
from gaugeworks.streaming import memo


def _store(spark) -> Store:
    return Store(spark, shared_folder(spark, "store"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("step_key"), hashing.input_hash(F.col("c_name")).alias("input_hash"), "c_nationkey")


def _asked_again(spark, sf_dir, between=lambda store, run_id: None):
    """A run's steps: customers with orders are begun first; a third of their nations' steps complete and a third fail. Then all customers are asked for."""
    runs = _store(spark)
    run_id = runs.create_run("memo")
    wanted = _customers(spark, sf_dir)
    first = wanted.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("step_key")), "step_key", "left_semi")
    todo, _ = runs.begin_steps(run_id, first)
    ended = todo.filter("c_nationkey % 3 < 2").select("step_key", F.concat(F.lit("out-"), "step_key").alias("output"), F.when(F.col("c_nationkey") % 3 == 1, "broken").alias("error"))
    runs.finish_steps(run_id, ended)
    between(runs, run_id)
    return run_id, runs, runs.begin_steps(run_id, wanted)


_FIRST = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


@query(f"SELECT c_custkey::VARCHAR AS step_key, CASE WHEN NOT {_FIRST} THEN 'again or new' WHEN c_nationkey % 3 = 0 THEN 'reuse' ELSE 'again or new' END AS decision, CASE WHEN {_FIRST} AND c_nationkey % 3 = 0 THEN 'out-' || c_custkey END AS output FROM customer")
def memo_decisions(spark, sf_dir):
    """What steps do when they are asked for again: run, or reuse the stored output."""
    _, _, (todo, reused) = _asked_again(spark, sf_dir)
    run = todo.select("step_key", F.lit("again or new").alias("decision"), F.lit(None).cast("string").alias("output"))
    return run.unionByName(reused.select("step_key", F.lit("reuse").alias("decision"), "output"))


@query(f"SELECT c_custkey::VARCHAR AS step_key FROM customer WHERE NOT {_FIRST} OR c_nationkey % 3 > 0")
def pending_steps(spark, sf_dir):
    """Steps that are running after all were asked for again."""
    run_id, runs, _ = _asked_again(spark, sf_dir)
    return runs.list_steps(run_id).filter("status = 'running'").select("step_key")


@query("""SELECT n_nationkey::VARCHAR AS step_key, CASE WHEN n_regionkey = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN n_regionkey = 1 THEN 'own' WHEN n_regionkey > 1 THEN 'run failed' END AS error, CASE WHEN n_regionkey = 0 THEN n_name END AS output FROM nation""")
def failed_run_steps(spark, sf_dir):
    """A failing run fails the steps that are still running, and those only."""
    runs = _store(spark)
    run_id = runs.create_run("failing")
    nations = table(spark, sf_dir, "nation")
    runs.begin_steps(run_id, nations.select(F.col("n_nationkey").cast("string").alias("step_key"), hashing.input_hash(F.col("n_name")).alias("input_hash")))
    ended = nations.filter("n_regionkey < 2").select(F.col("n_nationkey").cast("string").alias("step_key"), F.col("n_name").alias("output"), F.when(F.col("n_regionkey") == 1, "own").alias("error"))
    runs.finish_steps(run_id, ended)
    runs.fail_run(run_id, "stopped")
    return runs.steps(run_id).select("step_key", "status", "error", "output")


def _nation_runs(spark, sf_dir):
    """A run for each nation, by its region: 0 completes with an output, 1 fails, 2 fails with an output and is resumed, the others go on."""
    runs = _store(spark)
    runs.create_tables()
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():  # 25 runs
        run = runs.create_run(r["n_name"], '{"model":"m-' + r["n_name"] + '"}')
        if r["n_regionkey"] in (0, 2):
            runs.set_output(run, f'{{"x":{r["n_nationkey"]}}}')
        if r["n_regionkey"] == 0:
            runs.complete_run(run)
        if r["n_regionkey"] in (1, 2):
            runs.fail_run(run, "stopped")
        if r["n_regionkey"] == 2:
            runs.resume_run(run)
    return runs


@query("""SELECT n_name AS workflow_name, CASE n_regionkey WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status, CASE n_regionkey WHEN 1 THEN 'stopped' END AS error,
CASE WHEN n_regionkey IN (0, 2) THEN '{"x":' || n_nationkey || '}' END AS output, n_regionkey < 2 AS ended FROM nation""")
def run_states(spark, sf_dir):
    """Completed, failed, resumed and new runs; a resumed one keeps its output and loses error and end."""
    return _nation_runs(spark, sf_dir).runs().select("workflow_name", "status", "error", "output", F.col("finished_at").isNotNull().alias("ended"))


@query("""SELECT n_name AS name, e AS event_type, CASE e WHEN 'run.failed' THEN 'stopped' END AS message, row_number() OVER (PARTITION BY n_name ORDER BY i)::INT AS nth FROM (SELECT n_name, unnest(l) AS e, generate_subscripts(l, 1) AS i
FROM (SELECT n_name, CASE n_regionkey WHEN 0 THEN ['run.started', 'run.completed'] WHEN 1 THEN ['run.started', 'run.failed'] WHEN 2 THEN ['run.started', 'run.failed', 'run.resumed'] ELSE ['run.started'] END AS l FROM nation))""")
def run_events(spark, sf_dir):
    """The event log of each run, in order."""
    runs = _nation_runs(spark, sf_dir)
    names = runs.runs().select(F.col("id").alias("run_id"), F.col("workflow_name").alias("name"))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "id"))
    return runs.records("events").withColumn("nth", nth).join(names, "run_id").select("name", "event_type", "message", "nth")


@query(f"SELECT c_custkey::VARCHAR AS step_key, CASE WHEN {_FIRST} AND c_nationkey % 3 = 0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN {_FIRST} AND c_nationkey % 3 > 0 THEN 2 ELSE 1 END AS starts FROM customer")
def resumed_steps(spark, sf_dir):
    """A run fails, its state is compacted, and it is resumed and asks for all its steps: completed ones stay, those that failed by themselves or with the run are started again, each start an event."""
    run_id, runs, _ = _asked_again(spark, sf_dir, between=lambda s, r: (s.fail_run(r, "stopped"), s.compact(r), s.resume_run(r)))
    starts = runs.events(run_id).filter("event_type = 'step.started'").groupBy("step_id").agg(F.count(F.lit(1)).cast("int").alias("starts"))
    return runs.steps(run_id).join(starts, F.col("id") == F.col("step_id")).select("step_key", "status", "starts")


@query("""WITH m AS (SELECT o_custkey % 10 AS run_id, o_custkey::VARCHAR AS step_key, o_orderkey AS ord, o_orderkey % 3 < 2 AS begins, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE 'same' END AS h, o_orderkey % 2 = 0 AS failed FROM orders),
f AS (SELECT *, min(ord) FILTER (begins) OVER s AS first, arg_min(h, ord) FILTER (begins) OVER s AS own FROM m WINDOW s AS (PARTITION BY step_key)),
w AS (SELECT *, max(ord) FILTER (NOT begins AND ord > first) OVER b AS told, arg_max(failed, ord) FILTER (NOT begins AND ord > first) OVER b AS broke, max(ord) FILTER (begins AND h = own) OVER b AS asked FROM f WINDOW b AS (PARTITION BY step_key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN first IS NULL OR ord <= first THEN 'none' WHEN told IS NULL THEN 'running' WHEN NOT broke THEN 'completed' WHEN asked > told THEN 'running' ELSE 'failed' END AS status FROM w)
SELECT run_id, step_key, ord, CASE WHEN NOT begins THEN CASE status WHEN 'none' THEN 'unknown' ELSE 'finish' END WHEN status = 'none' THEN 'start' WHEN h <> own THEN 'clash' WHEN status = 'completed' THEN 'reuse' WHEN status = 'failed' THEN 'retry' ELSE 'continue' END AS decision,
CASE WHEN begins AND h = own AND status = 'completed' THEN 'out-' || told END AS output FROM t""")
def streamed_decisions(spark, sf_dir):
    """The memo's decisions over a stream of messages, the orders, with the state of each step kept between batches."""
    folder, orders = shared_folder(spark, "decisions"), table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parquet*")
    return memo.replay(memo.of_orders(stream), f"{folder}/checkpoint", f"{folder}/out")


@query("SELECT o_orderkey::VARCHAR AS step_key, o_orderpriority AS own, o_orderstatus AS status, o_clerk AS input_hash, printf('%.2f', o_totalprice) AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'late' END AS error FROM (SELECT *, 'h' || o_custkey AS o_clerk FROM orders)")
def sample_rows(spark, sf_dir):
    """Orders as samples: the output's fields under the step's own (a `status` of the output doesn't show), with its metrics."""
    orders = table(spark, sf_dir, "orders")
    steps = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("step_key"), F.concat(F.lit("h"), "o_custkey").alias("input_hash"), F.col("o_orderstatus").alias("status"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("own"), F.lit("hidden").alias("status"))).alias("output"), F.when(F.col("o_orderkey") % 3 == 0, "late").alias("error"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    points = orders.select(F.col("o_orderkey").alias("step_id"), F.lit("price").alias("metric_name"), F.col("o_totalprice").cast("double").alias("metric_value"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(1).alias("ord"))
    shown = sample_objects(steps, points).select("step_key", F.from_json("sample", "own string, status string, input_hash string, error string, metrics map<string,double>").alias("s"))
    return shown.select("step_key", "s.own", "s.status", "s.input_hash", F.format_string("%.2f", F.col("s.metrics")["price"]).alias("price"), "s.error")


@query(f"""WITH c AS (SELECT * FROM {_CELLS.replace(_PREDICTED, "(SELECT golden, predicted FROM " + _PREDICTED + ")")}), r AS (SELECT golden_idx AS i, sum(n) AS support, sum(n) FILTER (golden_idx = predicted_idx) AS tp FROM c GROUP BY golden_idx),
k AS (SELECT predicted_idx AS i, sum(n) AS predicted FROM c WHERE predicted_idx IS NOT NULL GROUP BY predicted_idx),
f AS (SELECT i, support, CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM r JOIN k USING (i))
SELECT 'f1_label_' || i AS metric_name, round(f1, 6) AS metric_value FROM f UNION ALL SELECT 'macro_f1', round(avg(f1), 6) FROM f UNION ALL SELECT 'weighted_f1', round(sum(f1 * support) / sum(support), 6) FROM f
UNION ALL SELECT 'confusion_matrix_' || golden_idx || '_' || coalesce(predicted_idx::VARCHAR, 'unparsed'), n::DOUBLE FROM c""")
def output_metrics(spark, sf_dir):
    """Derived metrics of stored outputs: F1 and confusion of documents' languages and guesses."""
    m = lambda k: F.col("doc_id") % k == 0
    guess = F.when(m(7), F.lit(None)).when(m(5), "en").when(m(3), "de").otherwise(F.col("lang"))
    steps = table(spark, sf_dir, "documents").select(F.lit("completed").alias("status"), F.to_json(F.struct(F.col("lang").alias("golden"), guess.alias("parsed_response"))).alias("output"))
    return confusion.output_metrics(steps, ("de", "en", "es", "fr"), ["f1", {"name": "confusion", "show": "all"}], True).withColumn("metric_value", F.round("metric_value", 6))


@query("SELECT 'itself' AS pair, false AS differs UNION ALL SELECT 'other input', true UNION ALL SELECT 'other steps', true")
def comparison_verdicts(spark, sf_dir):
    even, odd = (_run_steps(spark, sf_dir, x) for x in (True, False))
    points = _points(spark, sf_dir)
    same = compare.metric_rows(compare.metric_pairs(points, points))
    own = compare.step_rows(even, even)
    told = [("itself", compare.differs(own, same, True, True)), ("other input", compare.differs(own, same, False, True)), ("other steps", compare.differs(compare.step_rows(even, odd), same, True, True))]
    return spark.createDataFrame(told, "pair string, differs boolean")


@query("SELECT p_partkey, p_brand AS first, 'B' AS golden FROM part")
def column_answers(spark, sf_dir):
    """The correct choice is the one of a named column."""
    names = ("p_brand", "p_type", "p_name")
    told = prepare.labelled(prepare.checked_choices(prepare.choices_from_columns(names), LABELS), prepare.column_answer("p_type", names), LABELS)
    return table(spark, sf_dir, "part").select("p_partkey", told.alias("p")).select("p_partkey", F.col("p.choices")[0]["text"].alias("first"), F.col("p.golden").alias("golden"))


@query("""SELECT event_id, event_id::VARCHAR AS name, value FROM events WHERE event_id % 5 > 1""")
def validated_rows(spark, sf_dir):
    """Rows of a declared schema; those without a field or with one of another type are skipped."""
    k = F.col("event_id")
    whole = F.concat(F.lit('{"event_id":'), k, F.lit(',"name":"'), k, F.lit('","value":'), F.col("value").cast("string"), F.lit("}"))
    json = F.when(k % 5 == 0, F.concat(F.lit('{"event_id":'), k, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit('{"event_id":"x","name":"a","value":'), k, F.lit("}"))).otherwise(whole)
    return prepare.validated(table(spark, sf_dir, "events").select(json.alias("json")), "json", "event_id long, name string, value double", "skip")


@query("SELECT 'row ' || e || ': invalid row data: {\"x\":' || e || '}' AS message FROM (SELECT max(event_id) + 1 AS e FROM events)")
def invalid_row_message(spark, sf_dir):
    """The one row that doesn't fit is named when validation may not skip it."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.to_json(F.struct("event_id", "value")).alias("json"))
    last = events.agg((F.max("i") + 1).alias("i")).select("i", F.concat(F.lit('{"x":'), "i", F.lit("}")).alias("json"))
    try:
        prepare.validated(events.unionByName(last), "json", "event_id long, value double", index="i").write.format("noop").mode("overwrite").save()
        told = None
    except Exception as e:
        text_ = str(e)
        at = text_.find("row ", text_.find("USER_RAISED_EXCEPTION"))
        told = text_[at:].split("}")[0] + "}"
    return spark.createDataFrame([(told,)], "message string")


@query("""SELECT c_custkey, substr(sha256(c_name), 1, 16) AS similarity, substr(sha256(c_name || chr(10) || 'm' || chr(10) || 's'), 1, 16) AS biomedical, substr(sha256(c_name || chr(10) || c_mktsegment || chr(10) || 'm' || chr(10) || 'w'), 1, 16) AS choice, 'eval-' || c_custkey AS eval_key, 'dataset-batch-' || c_custkey AS batch_key FROM customer""")
def input_hashes(spark, sf_dir):
    p = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", hashing.similarity_input_hash(p).alias("similarity"), hashing.biomedical_input_hash(p, F.lit("m"), F.lit("s")).alias("biomedical"),
        hashing.choice_input_hash(p, F.col("c_mktsegment"), F.lit("m"), F.lit("w")).alias("choice"), hashing.eval_key(F.col("c_custkey")).alias("eval_key"), hashing.batch_key(F.col("c_custkey")).alias("batch_key"),
    )


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE text END AS said, CASE turn % 3 WHEN 0 THEN 'bad ' || turn WHEN 1 THEN 'plain' ELSE 'HTTP 503' END AS error FROM conversations""")
def provider_answers(spark, sf_dir):
    """Texts from three shapes of JSON answers, and messages from three shapes of errors."""
    k, t = F.col("turn") % 4, F.col("text")
    json = F.when(k == 0, F.to_json(F.struct(F.struct(t.alias("response")).alias("result")))).when(k == 1, F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")).alias("result"))))
    json = json.when(k == 2, F.to_json(F.struct(t.alias("result")))).otherwise(F.lit('{"result":{}}'))
    body = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"error":"bad '), "turn", F.lit('"}'))).when(F.col("turn") % 3 == 1, F.lit(" plain ")).otherwise(F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", json_values.provider_text(json).alias("said"), json_values.error_text(body, F.lit(503)).alias("error"))


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def required_fields(spark, sf_dir):
    v = json_values.parsed(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", json_values.required_scalar(v, "k", F.col("event_id"), "answer").alias("k"))


@query("SELECT c_custkey::BIGINT AS key, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal::DOUBLE END AS value FROM customer")
def cached_batches(spark, sf_dir):
    """Pages of JSON rows written once as typed columns and read back; the second reading sees the cache."""
    customers = table(spark, sf_dir, "customer")
    rows = customers.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal").cast("double")).alias("value"))).alias("json"))
    cache, at = datasets.BatchCache(spark, shared_folder(spark, "batches")), datasets.Coordinates("hub", "customers", "c", "test")
    half = -(-customers.count() // 2)
    for _ in range(2):
        pages = [cache.batch(at, rows, ["c_custkey"], offset, half, "json") for offset in (0, half)]
        rows = rows.filter("false")  # what comes now comes from the cache
    return functools.reduce(lambda a, b: a.unionByName(b), pages)


class Customers(datasets.PagedSource):
    """A custom source: the customers of a folder of tables, page by page in the order of the file."""

    source_id = "gaugeworks_customers"

    def _table(self):
        import pyarrow.parquet as pq

        return pq.ParquetFile(f"{self.options['tables']}/customer.parquet")

    def initialize(self):
        return self._table().metadata.num_rows

    def load_batch(self, offset, n):
        return self._table().read(columns=["c_custkey", "c_mktsegment"]).slice(offset, n).to_pylist()


@query("SELECT row_number() OVER (ORDER BY file_row_number) - 1 AS row_index, c_custkey, c_mktsegment FROM (SELECT *, c_custkey AS file_row_number FROM customer)")
def custom_source(spark, sf_dir):
    """A custom source over a given table, read page by page."""
    spark.dataSource.register(Customers)
    rows = spark.read.format(Customers.source_id).option("tables", sf_dir).load()
    return rows.select("row_index", F.get_json_object("json", "$.c_custkey").cast("long").alias("c_custkey"), F.get_json_object("json", "$.c_mktsegment").alias("c_mktsegment"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS page FROM orders")
def mirrored_pages(spark, sf_dir):
    """A mirrored dataset, all of its pages of 5,000 rows, each from the row groups that hold it, in one scan."""
    return paged.numbered_pages(spark, f"{sf_dir}/orders.parquet", 5000, ["o_orderkey", "o_custkey"])


@query("SELECT lang AS config, CASE lang WHEN 'en' THEN 'validation' ELSE 'test' END AS split, count(*) AS n, 'hf:mirror/documents:' || lang || ':' || CASE lang WHEN 'en' THEN 'validation' ELSE 'test' END AS source_id FROM documents WHERE doc_id % 3 = 1 GROUP BY lang")
def picked_splits(spark, sf_dir):
    """A mirror with a folder for each language and split: the split that is picked, its rows and its name."""
    k = F.col("doc_id") % 3
    second = F.when(F.col("lang") == "en", "validation").otherwise("test")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("config"), F.when(k == 0, "train").when(k == 1, second).otherwise("zz").alias("split"))
    root = shared_folder(spark, "mirror")
    rows.write.partitionBy("config", "split").parquet(f"{root}/mirror/documents")
    catalog = datasets.Catalog(spark, root)
    told = [catalog.resolved("hf://mirror/documents", c) for c in catalog.configs("mirror/documents")]
    return spark.createDataFrame([(a.config, a.split, catalog.total_rows(a), a.source_id) for a in told], "config string, split string, n long, source_id string")


_PROMPT = "'Part ' || p_name || ' is' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10)"
_HASH = "('0x' || substr(sha256({0}), 1, 15))::BIGINT"
_ANSWERS = f"""(SELECT p_partkey, prompt, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS golden, ['A', 'B'][{_HASH.format("'|' || prompt")} % 2 + 1] AS answer FROM (SELECT *, {_PROMPT} AS prompt FROM part))"""


def _nocode(spark, sf_dir):
    """A no-code evaluation of all parts with the seeded label sampler."""
    runs = _store(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", (F.col("p_partkey") % 2 + 1).alias("correct"))
    style = Style("multiple_choice", choice_columns=("p_brand", "p_type"), labels=("A", "B"), index_column="correct", index_base=1)
    prompt = "Part {{ row.p_name }} is\n{% for c in choices %}{{ c.label }}. {{ c.text }}\n{% endfor %}"
    return runs, evaluate.BUILTINS["custom_nocode"](runs, "parts", rows, style, prompt, ["p_partkey"], "random_label")


@query(f"SELECT 'row-' || (row_number() OVER (ORDER BY p_partkey) - 1) AS step_key, prompt AS input, answer AS response, answer AS parsed_response, golden, answer = golden AS is_correct FROM {_ANSWERS}")
def nocode_outputs(spark, sf_dir):
    """The stored outputs of a whole run."""
    runs, told = _nocode(spark, sf_dir)
    fields = "input string, response string, parsed_response string, golden string, is_correct boolean"
    return runs.steps(told.run_id).filter("status = 'completed'").select("step_key", F.from_json("output", fields).alias("o")).select("step_key", "o.*")


@query(f"SELECT metric_name, round(total, 4) AS total, n FROM (SELECT 'is_correct' AS metric_name, sum((answer = golden)::INT)::DOUBLE AS total, count(*) AS n FROM {_ANSWERS} UNION ALL SELECT 'response_parsed', count(*)::DOUBLE, count(*) FROM part UNION ALL SELECT 'accuracy', avg((answer = golden)::INT), 1 FROM {_ANSWERS})")
def nocode_metrics(spark, sf_dir):
    """Indicator metrics of the samples and the accuracy of the run, as they are stored."""
    runs, told = _nocode(spark, sf_dir)
    points = runs.metrics.points(told.run_id).filter("metric_name not like '%latency%'")
    return points.groupBy("metric_name").agg(F.round(F.sum("metric_value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT golden, answer FROM {_ANSWERS}), l AS (SELECT * FROM (VALUES (0, 'A'), (1, 'B')) t(i, label)),
f AS (SELECT i, count(*) FILTER (golden = label) AS support, 2 * count(*) FILTER (golden = label AND answer = label) / (count(*) FILTER (golden = label) + count(*) FILTER (answer = label)) AS f1 FROM a, l GROUP BY i)
SELECT 'accuracy' AS metric_name, round(avg((golden = answer)::INT), 6) AS metric_value FROM a UNION ALL SELECT 'f1_label_' || i, round(f1, 6) FROM f UNION ALL SELECT 'macro_f1', round(avg(f1), 6) FROM f UNION ALL SELECT 'weighted_f1', round(sum(f1 * support) / sum(support), 6) FROM f""")
def shown_metrics(spark, sf_dir):
    """What a run shows of its metrics: the stored run-level ones, and F1 derived from its outputs."""
    runs, told = _nocode(spark, sf_dir)
    shown = evaluate.shown(runs, told.run_id, ["A", "B"], ["f1"])["metrics"]
    return shown.filter("step_id is null and metric_name not like '%latency%'").select("metric_name", F.round("metric_value", 6).alias("metric_value"))


@query(r"SELECT conv_id, sum(ceil(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3))::BIGINT AS total_tokens, round(sum(ceil(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3)) * 0.002, 6) AS cost FROM conversations GROUP BY conv_id")
def token_costs(spark, sf_dir):
    """Tokens of a conversation and what they cost at two tenths of a cent each."""
    tokens = table(spark, sf_dir, "conversations").select("conv_id", text.token_estimate(F.col("text")).alias("tokens"))
    total = F.sum("tokens")
    return tokens.groupBy("conv_id").agg(total.alias("total_tokens"), F.round(total * F.lit(0.002), 6).alias("cost"))


@query("SELECT p_partkey, p_size * 2 AS doubled FROM part WHERE p_size > 9")
def mapped_rows(spark, sf_dir):
    """A callable over rows; results that are None go."""

    def double(row):
        return {"p_partkey": row["p_partkey"], "doubled": row["p_size"] * 2} if row["p_size"] > 9 else None

    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return sampling.map_rows(rows, double, "p_partkey long, doubled long", workers=4, order="completion")


@query("SELECT n_name, upper(n_comment) AS response FROM (SELECT n_name, 'about ' || n_name AS n_comment FROM nation)")
def called_sampler(spark, sf_dir):
    """A sampler that is a callable, several calls at a time."""
    rows = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("about "), "n_name").alias("prompt"))
    return sampling.external(rows, "prompt", lambda p: p.upper(), workers=3).select("n_name", "response")


def _random_text(prompt: str) -> str:
    return f"""array_to_string(list_transform(range(1, {_HASH.format("'|' || " + prompt)} % {sampling.LONGEST_RANDOM} + 2), lambda i: substr('{sampling.ALPHABET}', ({_HASH.format("'|' || " + prompt + " || '|' || i")} % {len(sampling.ALPHABET)} + 1)::INT, 1)), '')"""


@query(f"SELECT c_custkey, {_random_text('c_name')} AS response FROM customer")
def random_texts(spark, sf_dir):
    """The seeded text sampler."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return sampling.sampled(rows, "c_name", sampling.model_spec(None)).select("c_custkey", "response")


@query(f"SELECT c_custkey, {_random_text('c_mktsegment || c_custkey')} AS content, 1 AS tokens FROM customer")
def chat_replies(spark, sf_dir):
    """The random sampler answers a conversation's last message."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(turn("system", F.lit("be brief")), turn("user", F.concat("c_mktsegment", "c_custkey"))).alias("messages"))
    return sampling.chat(rows, "messages", sampling.ModelSpec("random")).select("c_custkey", "reply.content", "reply.tokens")


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'm-' || c_mktsegment END AS model FROM customer")
def run_models(spark, sf_dir):
    """The model named in a run's input, if it is a string there."""
    k = F.col("c_nationkey") % 3
    given = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("m-"), "c_mktsegment").alias("model")))).when(k == 1, F.lit('{"model":{"type":"random"}}')).otherwise(F.lit('{"limit":5}'))
    return table(spark, sf_dir, "customer").select("c_custkey", sampling.model_of_input(given).alias("model"))


@query("SELECT conv_id, turn, 'Read the context and answer the biomedical question with one word: yes, no or maybe.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Context: turn ' || turn || chr(10) || chr(10) || 'Answer (yes, no or maybe):' AS prompt FROM conversations")
def biomedical_prompts(spark, sf_dir):
    prompt = template.biomedical_prompt(F.col("text"), F.concat(F.lit("turn "), "turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query("SELECT c_custkey, round(1 - levenshtein(c_name, upper(c_name)) / length(c_name), 9) AS score FROM customer")
def measured_similarity(spark, sf_dir):
    """A measure by its name."""
    score = similarity.measure("levenshtein")(F.col("c_name"), F.upper("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(score, 9).alias("score"))


@query()
def text_similarities(spark, sf_dir):
    """Each turn's text against the one before it, by embeddings fitted to all turns. No SQL states a decomposition: see the tests."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    model = embedding.fit(turns, "text")
    return embedding.similarities(turns.join(before, ["conv_id", "turn"]), "text", "before", model).select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE c_mktsegment END AS model, CASE WHEN c_mktsegment = 'BUILDING' THEN 'model' ELSE '' END AS overridden FROM customer")
def assembled_inputs(spark, sf_dir):
    """The inputs that a configuration and given keys make, one for each segment, by which customers run."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    segments = [r[0] for r in customers.select("c_mktsegment").distinct().collect()]  # a few names
    text_ = "\n".join(f'[benchmarks."{s}"]\ntype = "custom_code"\ncommand = "run"\nmodel = "{s}"' for s in segments)
    made = {n: config.assembled(e, {"model": "x"} if n == "BUILDING" else None) for n, e in config.parse(text_).items()}
    rows = spark.createDataFrame([(n, given["model"], ",".join(keys)) for n, (given, keys) in made.items()], "c_mktsegment string, model string, overridden string")
    return customers.join(F.broadcast(rows), "c_mktsegment").select("c_custkey", "model", "overridden")


@query("SELECT event_id, event_type AS metric_name, rtrim(rtrim(printf('%.4f', value), '0'), '.') || CASE WHEN event_type = 'purchase' THEN ' ms' ELSE '' END AS value FROM events")
def metric_table(spark, sf_dir):
    """Metrics as a report writes them."""
    points = table(spark, sf_dir, "events").select(F.concat_ws("|", "event_id", "event_type").alias("metric_name"), F.col("value").alias("metric_value"), F.when(F.col("event_type") == "purchase", "ms").alias("unit"))
    return report.metric_table(points).select(F.substring_index("metric_name", "|", 1).cast("long").alias("event_id"), F.substring_index("metric_name", "|", -1).alias("metric_name"), "value")


@query("SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"at\":\"' || strftime(to_timestamp(c_custkey * 3600), '%Y-%m-%dT%H:%M:%S.%fZ') || '\",\"none\":null}' AS json FROM customer")
def json_rows(spark, sf_dir):
    """Rows as JSON objects, nulls kept, times in one form."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.timestamp_seconds(F.col("c_custkey") * 3600).alias("at"), F.lit(None).cast("string").alias("none"))
    return report.json_rows(rows)


@query("SELECT c_custkey AS id, c_mktsegment AS name, 'completed' AS status, 3 AS samples, strftime(to_timestamp(c_custkey * 3600), '%Y-%m-%dT%H:%M:%S.%fZ') AS created, printf('%.3fs', c_nationkey::DOUBLE) AS duration FROM customer")
def listed_runs(spark, sf_dir):
    start = F.col("c_custkey") * 3600
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("workflow_name"), F.lit("completed").alias("status"), F.lit(3).alias("samples"), F.timestamp_seconds(start).alias("started_at"), F.timestamp_seconds(start + F.col("c_nationkey")).alias("finished_at"))
    return report.listed(rows)


@query("SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM conversations")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.word_count(F.col("text")).cast("long").alias("words"))
