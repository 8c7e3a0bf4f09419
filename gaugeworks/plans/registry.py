"""Registered queries on the sample tables, each with the SQL that states its result.

The tables aren't evaluation data, so each query lets them stand in: customers are runs and orders their steps, events
are metric points, documents with labels are scored samples, parts are multiple-choice rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import hashing, json_values, similarity, text
from gaugeworks.operators import compare, confusion, latest, prepare, sampling, stats, template
from gaugeworks.plans import store
from gaugeworks.session import shared_folder
from gaugeworks.sources import metrics as metric_source
from gaugeworks.streaming import events as event_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LABELS = ("A", "B", "C", "D")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(spark, sf_dir):
    """lang, quality as a boolean, and a prediction from the text's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select("lang", (F.col("quality") == 1).alias("actual"), (F.col("n_chars") >= 1000).alias("predicted"))


_JUDGED = "(SELECT lang, quality = 1 AS actual, n_chars >= 1000 AS predicted FROM documents JOIN labels USING (doc_id))"


def _r(c, n=6):
    return F.round(c, n)


@query(f"SELECT lang, avg(hit) AS accuracy, sum(hit) AS correct_count, count(*)::DOUBLE AS total_count FROM (SELECT lang, (actual = predicted)::INT::DOUBLE AS hit FROM {_JUDGED}) GROUP BY lang")
def accuracy_metrics(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("correct", text.label_match(F.col("predicted"), F.col("actual")))
    return stats.accuracy(rows, "correct", "lang")


@query(f"""SELECT lang, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(specificity, 6) AS specificity,
round(CASE WHEN "precision" + recall = 0 THEN 0 ELSE 2 * "precision" * recall / ("precision" + recall) END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity
FROM (SELECT lang, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn, count(*) FILTER (NOT actual AND NOT predicted) AS tn FROM {_JUDGED} GROUP BY lang))""")
def binary_classification(spark, sf_dir):
    told = stats.binary_classification(_judged(spark, sf_dir), "actual", "predicted", "lang")
    return told.withColumns({c: _r(F.col(c)) for c in ("precision", "recall", "specificity", "f1")})


_SUMMARY = """SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS median,
min(value) AS min, max(value) AS max, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_cont(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM events GROUP BY event_type"""


@query(f"SELECT event_type, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean', 'std', 'variance', 'median', 'min', 'max', 'p95', 'p99'))} FROM ({_SUMMARY})")
def score_statistics(spark, sf_dir):
    told = stats.summary(table(spark, sf_dir, "events"), "value", "event_type")
    return told.withColumns({c: _r(F.col(c)) for c in ("mean", "std", "variance", "median", "min", "max", "p95", "p99")})


@query("SELECT event_type, round(var_samp(value), 6) AS variance_sample, round(stddev_samp(value), 6) AS std_sample, round(var_pop(value), 6) AS variance_population, round(stddev_pop(value), 6) AS std_population FROM events GROUP BY event_type")
def sample_moments(spark, sf_dir):
    x = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        _r(stats.variance(x, sample=True)).alias("variance_sample"), _r(stats.stddev(x, sample=True)).alias("std_sample"),
        _r(stats.variance(x)).alias("variance_population"), _r(stats.stddev(x)).alias("std_population"),
    )


@query(f"""SELECT event_type, metric_name, round(metric_value, 6) AS metric_value, 'ms' AS unit FROM (UNPIVOT (SELECT event_type, mean AS mean_latency_ms, median AS median_latency_ms, p95 AS p95_latency_ms, p99 AS p99_latency_ms, "min" AS min_latency_ms, "max" AS max_latency_ms FROM ({_SUMMARY}))
ON mean_latency_ms, median_latency_ms, p95_latency_ms, p99_latency_ms, min_latency_ms, max_latency_ms INTO NAME metric_name VALUE metric_value)""")
def long_metrics(spark, sf_dir):
    told = stats.summary(table(spark, sf_dir, "events"), "value", "event_type")
    return stats.long_metrics(told, stats.LATENCY_METRICS, "event_type", unit="ms").withColumn("metric_value", _r(F.col("metric_value")))


@query("SELECT event_type, round(avg(least(greatest(value, 0.0), 100.0)), 6) AS clipped_mean FROM events GROUP BY event_type")
def clipped_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(_r(stats.clipped_mean(F.col("value"), 0.0, 100.0)).alias("clipped_mean"))


def _t_table(confidence: float, sizes) -> str:
    """Values of Student's t as SQL literals."""
    return ", ".join(f"({n}, {stats.t_inverse(0.5 + confidence / 2, n - 1)!r}::DOUBLE)" for n in sizes)


@query(f"""WITH q(n, t) AS (VALUES {_t_table(0.95, range(2, 201))}),
g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS s FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, g.n, round(mean, 4) AS mean, round(mean - CASE WHEN g.n = 1 THEN 0 ELSE t * s / sqrt(g.n) END, 4) AS low, round(mean + CASE WHEN g.n = 1 THEN 0 ELSE t * s / sqrt(g.n) END, 4) AS high FROM g LEFT JOIN q ON g.n = q.n""")
def confidence_interval(spark, sf_dir):
    """Groups of every size. The SQL's table of t values has groups of up to 200 customers."""
    told = stats.confidence_interval(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey", "c_mktsegment")
    return told.withColumns({c: _r(F.col(c), 4) for c in ("mean", "low", "high")})


_PREDICTED = "(SELECT lang AS golden, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 3 = 0 THEN 'de' ELSE lang END AS predicted FROM documents)"
_CELLS = f"""(SELECT g.i AS golden_idx, p.j AS predicted_idx, count(d.golden) AS n FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr')) g(i, gl)
CROSS JOIN (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr'), (NULL, NULL)) p(j, pl) LEFT JOIN {_PREDICTED} d ON d.golden = g.gl AND d.predicted IS NOT DISTINCT FROM p.pl GROUP BY g.i, p.j)"""


def _cells(spark, sf_dir):
    m = lambda k: F.col("doc_id") % k == 0
    guess = F.when(m(7), F.lit(None)).when(m(5), "en").when(m(3), "de").otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("golden"), guess.alias("predicted"))
    return confusion.matrix(rows, "golden", "predicted", ("de", "en", "es", "fr"))


@query(f"SELECT 'confusion_matrix_' || golden_idx || '_' || coalesce(predicted_idx::VARCHAR, 'unparsed') AS metric_name, n::DOUBLE AS metric_value FROM {_CELLS}")
def confusion_matrix(spark, sf_dir):
    return confusion.confusion_metrics(_cells(spark, sf_dir))


@query(f"""WITH c AS (SELECT * FROM {_CELLS}), r AS (SELECT golden_idx AS i, sum(n) AS support, sum(n) FILTER (golden_idx = predicted_idx) AS tp FROM c GROUP BY golden_idx),
k AS (SELECT predicted_idx AS i, sum(n) AS predicted FROM c WHERE predicted_idx IS NOT NULL GROUP BY predicted_idx),
f AS (SELECT i, support, CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM r JOIN k USING (i))
SELECT 'f1_label_' || i AS metric_name, round(f1, 6) AS metric_value FROM f UNION ALL SELECT 'macro_f1', round(avg(f1), 6) FROM f UNION ALL SELECT 'weighted_f1', round(sum(f1 * support) / sum(support), 6) FROM f""")
def multiclass_f1(spark, sf_dir):
    return confusion.f1_metrics(_cells(spark, sf_dir)).withColumn("metric_value", _r(F.col("metric_value")))


@query("""SELECT c_custkey AS id, count(o_orderkey) AS samples, CASE WHEN c_nationkey > 0 THEN c_nationkey::DOUBLE END AS duration_s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey""")
def list_runs(spark, sf_dir):
    """Customers are runs, orders their steps; runs of nation 0 go on."""
    start = F.timestamp_seconds(F.col("c_custkey") * 60)
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), start.alias("started_at"), F.when(F.col("c_nationkey") > 0, F.timestamp_seconds(F.col("c_custkey") * 60 + F.col("c_nationkey"))).alias("finished_at"))
    return store.list_runs(runs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"))).select("id", "samples", "duration_s")


def _run_steps(spark, sf_dir, even: bool):
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderkey") % 2 == 0) == F.lit(even))
    out = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus"))
    return orders.select(F.col("o_custkey").cast("string").alias("step_key"), F.col("o_orderpriority").alias("input_hash"), F.col("o_orderstatus").alias("status"), out.alias("output"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("id"))


_EVEN, _ODD = (f"""(SELECT k, arg_max(h, t) AS h, arg_max(s, t) AS s, arg_max(o, t)[1] AS o FROM (SELECT o_custkey AS k, o_orderpriority AS h, o_orderstatus AS s, [CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END] AS o, (o_orderdate, o_orderkey) AS t FROM orders WHERE {w}) GROUP BY k)""" for w in ("o_orderkey % 2 = 0", "o_orderkey % 2 <> 0"))


@query(f"""SELECT coalesce(a.k, b.k)::VARCHAR AS step_key, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS presence, a.s AS status_a, b.s AS status_b,
a.k IS NULL OR b.k IS NULL OR a.h IS DISTINCT FROM b.h AS input_differs, a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s AS status_differs, a.k IS NULL OR b.k IS NULL OR a.o IS DISTINCT FROM b.o AS output_differs
FROM {_EVEN} a FULL JOIN {_ODD} b ON a.k = b.k""")
def compare_steps(spark, sf_dir):
    told = compare.step_rows(_run_steps(spark, sf_dir, True), _run_steps(spark, sf_dir, False))
    return told.drop("output_a", "output_b").orderBy("step_key")


_POINTS = "SELECT event_type AS metric_name, list(value ORDER BY ts, event_id) AS v FROM events WHERE user_id % 2 = {0} GROUP BY event_type"


def _compared_metrics(events):
    """Events are points; users with even and odd ids are the two runs."""
    rows = events.select("user_id", F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), F.col("ts").alias("created_at"), F.col("event_id").alias("ord"))
    told = compare.metric_rows(compare.metric_pairs(rows.filter("user_id % 2 = 0").drop("user_id"), rows.filter("user_id % 2 = 1").drop("user_id")))
    return told.select("metric_name", F.col("n_a").cast("int"), F.col("n_b").cast("int"), _r(F.col("delta_sum"), 4).alias("delta_sum"), F.col("unmatched").cast("int"), "direction", "same")


@query(f"""WITH a AS ({_POINTS.format(0)}), b AS ({_POINTS.format(1)}),
j AS (SELECT coalesce(a.metric_name, b.metric_name) AS metric_name, coalesce(a.v, []::DOUBLE[]) AS x, coalesce(b.v, []::DOUBLE[]) AS y FROM a FULL JOIN b ON a.metric_name = b.metric_name),
d AS (SELECT *, list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: y[i] - x[i]) AS d FROM j)
SELECT metric_name, len(x)::INT AS n_a, len(y)::INT AS n_b, round(list_sum(d), 4) AS delta_sum, len(list_filter(d, lambda v: v IS NULL))::INT AS unmatched,
CASE WHEN len(list_filter(d, lambda v: v > 0)) > 0 AND len(list_filter(d, lambda v: v < 0)) > 0 THEN 'mixed' WHEN len(list_filter(d, lambda v: v > 0)) > 0 THEN 'up' WHEN len(list_filter(d, lambda v: v < 0)) > 0 THEN 'down' ELSE 'same' END AS direction, x = y AS same FROM d""")
def compare_metrics(spark, sf_dir):
    return _compared_metrics(table(spark, sf_dir, "events"))


def _points(spark, sf_dir):
    """Events as metric points of runs by user; purchases are run-level."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_type") != "purchase", F.col("event_id")).alias("step_id"), F.col("event_type").alias("metric_name"),
        F.col("value").alias("metric_value"), F.lit(None).cast("string").alias("unit"), F.col("ts").alias("created_at"), F.col("event_id").alias("ord"),
    )


_SCAN = "SELECT CASE WHEN event_type <> 'purchase' THEN event_id END AS step_id, event_type AS metric_name, value AS metric_value, NULL::VARCHAR AS unit, ts AS created_at FROM events"


@query(_SCAN)
def metric_scan(spark, sf_dir):
    """The points of all runs."""
    return metric_source.scan(_points(spark, sf_dir))


@query(f"SELECT * FROM ({_SCAN}) WHERE step_id IS NULL")
def metric_scan_aggregate(spark, sf_dir):
    return metric_source.scan(_points(spark, sf_dir), aggregate_only=True)


@query("SELECT event_type AS metric_name, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'purchase' GROUP BY event_type")
def pending_union(spark, sf_dir):
    """Persisted points (even ids) and pending ones (odd ids) of one run, as a bag."""
    points = _points(spark, sf_dir).withColumn("run_id", F.lit(1).cast("long"))
    kept = metric_source.MetricStore(spark, shared_folder(spark, "points"))
    kept.emit(points.filter("ord % 2 = 0"), 1)
    kept.flush(1)
    kept.emit(points.filter("ord % 2 = 1"), 1)
    told = kept.sample_values(1)
    return told.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("metric_value"), 4).alias("total"))


@query("SELECT step_id, map_from_entries(list((metric_name, metric_value) ORDER BY metric_name))::VARCHAR AS metrics FROM (SELECT user_id AS step_id, event_type AS metric_name, round(arg_max(value, (ts, event_id)), 2)::VARCHAR AS metric_value FROM events GROUP BY ALL) GROUP BY step_id")
def step_metric_maps(spark, sf_dir):
    """The last value of each metric of a step, as a map."""
    rows = _points(spark, sf_dir).select(F.col("run_id").alias("step_id"), "metric_name", "metric_value", "created_at", "ord")
    told = latest.last_values(rows, ["step_id"], "metric_name", "metric_value", ["created_at", "ord"])
    entries = F.array_sort(F.map_entries("metrics"))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), _r(e["value"], 2).cast("string")))
    return told.select("step_id", F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("metrics"))


@query("SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 9) AS similarity FROM nation a CROSS JOIN nation b")
def levenshtein_similarity(spark, sf_dir):
    """All pairs of the 25 nations."""
    names = table(spark, sf_dir, "nation").select("n_name")
    pairs = names.select(F.col("n_name").alias("a")).crossJoin(names.select(F.col("n_name").alias("b")))
    return pairs.withColumn("similarity", _r(similarity.levenshtein_similarity(F.col("a"), F.col("b")), 9))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    c = similarity.cosine(F.col("embedding"), F.col("other"))
    return rows.join(following, "vec_id").select("vec_id", _r(c, 6).alias("cosine"), _r(similarity.rescaled(c), 6).alias("score"))


@query("SELECT lang, count(*) FILTER (trim(text) = trim(lower(text))) AS matches, count(*) AS n FROM documents GROUP BY lang")
def exact_match(spark, sf_dir):
    """Whether a text equals its lower-cased self, both trimmed."""
    rows = table(spark, sf_dir, "documents").select("lang", text.exact_match(F.col("text"), F.lower("text")).alias("hit"))
    return rows.groupBy("lang").agg(F.count_if("hit").alias("matches"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE chr(65 + (p_partkey % 4)::INT) END AS predicted FROM part")
def choice_label_parse(spark, sf_dir):
    """Responses in six phrasings; two of them name no label."""
    k = F.col("p_partkey")
    letter = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (k % 4 + 1).cast("int"))
    said = F.element_at(F.array(F.concat(F.lit("The answer is ("), F.lower(letter), F.lit(").")), F.concat(F.lit(" "), letter, F.lit("\n")), F.concat(F.lit("**"), letter, F.lit("** because it fits")), F.concat(F.lit("I think it must be "), letter, F.lit("!")), F.lit("none of them"), F.lit("")), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.choice_label(said, LABELS).alias("predicted"))


@query(r"""SELECT conv_id, turn, CASE WHEN low IN ('yes', 'no', 'maybe') THEN low ELSE list_filter(list_transform(list_filter(string_split_regex(regexp_replace(low, '^[^\p{L}]+', ''), '\s+'), lambda x: x <> '')[1:5], lambda x: regexp_replace(x, '^[^\p{L}]+|[^\p{L}]+$', '', 'g')), lambda x: x IN ('yes', 'no', 'maybe'))[1] END AS predicted
FROM (SELECT conv_id, turn, lower(trim(CASE turn % 4 WHEN 0 THEN '**No**, ' || text WHEN 1 THEN 'I say maybe. ' || text ELSE text END)) AS low FROM conversations)""")
def short_label_parse(spark, sf_dir):
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("**No**, "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("I say maybe. "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.short_label(said).alias("predicted"))


@query(r"SELECT conv_id, turn, nullif(regexp_extract(lower(text || CASE WHEN turn % 3 = 0 THEN ' Maybe.' ELSE '' END), '\b(yes|no|maybe)\b', 1), '') AS predicted FROM conversations")
def short_label_anywhere(spark, sf_dir):
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " Maybe.").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.short_label_anywhere(said).alias("predicted"))


_H = "('0x' || substr(sha256('custom-nocode-choice-shuffle-v1:' || p_partkey || ':{0}'), 1, 15))::BIGINT % {1}"


@query(f"""WITH s AS (SELECT p_partkey, {_H.format(3, 4)} AS j3, {_H.format(2, 3)} AS j2, {_H.format(1, 2)} AS j1, [0, 1, 2, 3] AS o FROM part),
a AS (SELECT *, list_transform(range(0, 4), lambda i: CASE WHEN i = 3 THEN o[j3 + 1] WHEN i = j3 THEN o[4] ELSE o[i + 1] END) AS o3 FROM s),
b AS (SELECT *, list_transform(range(0, 4), lambda i: CASE WHEN i = 2 THEN o3[j2 + 1] WHEN i = j2 THEN o3[3] ELSE o3[i + 1] END) AS o2 FROM a),
c AS (SELECT *, list_transform(range(0, 4), lambda i: CASE WHEN i = 1 THEN o2[j1 + 1] WHEN i = j1 THEN o2[2] ELSE o2[i + 1] END) AS o1 FROM b)
SELECT p_partkey, array_to_string(list_transform(o1, lambda k: ['right', 'wrong1', 'wrong2', 'wrong3'][k + 1]), ',') AS texts, chr(64 + list_position(o1, 0)::INT) AS golden FROM c""")
def choice_shuffle(spark, sf_dir):
    choices = F.array(*[F.lit(x) for x in ("right", "wrong1", "wrong2", "wrong3")])
    told = prepare.labelled(choices, F.lit(0), LABELS, F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", told.alias("p"))
    return rows.select("p_partkey", F.array_join(F.transform("p.choices", lambda c: c["text"]), ",").alias("texts"), F.col("p.golden").alias("golden"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN chr(65 + (p_size % 5)::INT) END AS golden FROM part")
def index_answers(spark, sf_dir):
    """Every part; one whose index is outside the four choices has no golden label."""
    at = prepare.index_answer((F.col("p_size") % 5 + 1).cast("string"), F.lit(4), 1)
    golden = F.when(F.col("p_size") % 5 < 4, F.element_at(F.array(*[F.lit(x) for x in LABELS]), at + 1))
    return table(spark, sf_dir, "part").select("p_partkey", golden.alias("golden"))


@query("SELECT p_partkey, 'Part ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Answer:' AS prompt FROM part")
def rendered_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("choices", F.array(F.struct(F.lit("A").alias("label"), F.col("p_brand").alias("text")), F.struct(F.lit("B").alias("label"), F.col("p_type").alias("text"))))
    told = template.render(rows, "{# a comment #}Part {{ row.p_name }}\n{% for c in choices %}{{ c.label }}. {{ c.text }}\n{% endfor %}Answer:", "choices")
    return told.select("p_partkey", "prompt")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_fields(spark, sf_dir):
    v = json_values.parsed(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(json_values.field(v, "k"), "$", "long").alias("k"))


@query("""WITH p AS (SELECT a.event_id, a.props AS x, b.props AS y FROM events a JOIN events b ON b.event_id = a.event_id + 1)
SELECT event_id, '$.k' AS path, x->>'$.k' AS run_a, y->>'$.k' AS run_b FROM p WHERE x->>'$.k' IS DISTINCT FROM y->>'$.k'""")
def json_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("x"))
    following = rows.select((F.col("event_id") - 1).alias("event_id"), F.col("x").alias("y"))
    return json_values.field_differences(rows.join(following, "event_id"), "x", "y", "event_id")


@query("SELECT 'k' AS key, 'BIGINT' AS type UNION ALL SELECT 'v', 'DOUBLE' UNION ALL SELECT 't', 'STRING'")
def inferred_types(spark, sf_dir):
    """Types of the keys of events written as JSON."""
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").alias("k"), (F.col("value") + 0.25).alias("v"), F.col("event_type").alias("t"))).alias("json"))
    return json_values.inferred_types(rows, "json")


@query("SELECT c_custkey, substr(sha256(c_name || chr(10) || c_mktsegment), 1, 16) AS input_hash, sha256('{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}') AS canonical_hash, 'row-' || c_custkey AS step_key FROM customer")
def content_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    json = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")))
    return rows.select("c_custkey", hashing.input_hash(F.col("c_name"), F.col("c_mktsegment")).alias("input_hash"), hashing.canonical_hash(json).alias("canonical_hash"), hashing.row_key(F.col("c_custkey")).alias("step_key"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def page(spark, sf_dir):
    """A page is the feature: rows 200 to 299 in order."""
    return latest.page(table(spark, sf_dir, "orders"), ["o_orderkey"], 200, 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark, sf_dir):
    return latest.indexed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_step_state(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return latest.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, sf_dir):
    return event_stream.counts(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts_streamed(spark, sf_dir):
    """The same plan over the table read as a stream."""
    folder = shared_folder(spark, "counts")
    rows = table(spark, sf_dir, "events")
    return event_stream.replay(spark, f"{sf_dir}/events.parquet*", rows.schema, lambda s: event_stream.counts(s, "user_id", "event_type"), f"{folder}/checkpoint", f"{folder}/out")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return event_stream.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type")


@query(r"SELECT doc_id, ceil(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT conv_id, turn, CASE WHEN contains(low, 'crash') THEN 'bug' WHEN contains(low, 'invite') OR contains(low, 'show me') THEN 'how_to' ELSE 'billing' END AS label FROM (SELECT conv_id, turn, lower(text || CASE turn % 3 WHEN 0 THEN ' It CRASHES' WHEN 1 THEN ' Show me' ELSE '' END) AS low FROM conversations)""")
def keyword_labels(spark, sf_dir):
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " It CRASHES").when(F.col("turn") % 3 == 1, " Show me").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.keyword_label(said, text.TICKET_RULES_SHORT, "billing").alias("label"))


@query("""SELECT conv_id, turn, 'q' || conv_id AS sample_id, text AS question, CASE turn % 3 WHEN 0 THEN 'given' WHEN 1 THEN 'a' || chr(10) || 'b' ELSE '' END AS context, ['yes', 'no', 'maybe'][turn % 3 + 1] AS gold_answer FROM conversations""")
def question_rows(spark, sf_dir):
    """Turns as biomedical rows: a plain context, a nested one or none; answers under three names."""
    rows, k = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    json = F.when(k == 0, F.to_json(F.struct(F.col("text").alias("question"), F.lit("given").alias("abstract"), F.lit(" YES").alias("final_decision"), F.concat(F.lit("q"), "conv_id").alias("id"))))
    json = json.when(k == 1, F.to_json(F.struct(F.col("text").alias("query"), F.struct(F.array(F.lit("b")).alias("zz"), F.lit("a").alias("contexts")).alias("context"), F.lit("no").alias("answer"), F.concat(F.lit("q"), "conv_id").alias("qid"))))
    json = json.otherwise(F.to_json(F.struct(F.col("text").alias("input"), F.lit("Maybe ").alias("target"), F.concat(F.lit("q"), "conv_id").alias("question_id"))))
    return prepare.question_rows(rows.select("conv_id", "turn", json.alias("json"))).select("conv_id", "turn", "sample_id", "question", "context", "gold_answer")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS first, chr(65 + (p_partkey % 2)::INT) AS golden FROM part""")
def json_choices(spark, sf_dir):
    """Choices from JSON text, an array or an object, and golden labels from a padded, lower-case label."""
    even = F.col("p_size") % 2 == 0
    json = F.when(even, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.to_json(F.struct(F.col("p_brand").alias("B"), F.col("p_type").alias("A"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", prepare.choices_from_json(json, ("A", "B")).alias("c"), F.when(F.col("p_partkey") % 2 == 0, " a ").otherwise("b").alias("label"))
    told = prepare.labelled(F.col("c"), prepare.label_answer(F.col("label"), ("A", "B"), F.size("c")), ("A", "B"))
    return rows.select("p_partkey", F.get("c", F.lit(0)).alias("first"), told["golden"].alias("golden"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 7)::DOUBLE END AS d, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 7 END::VARCHAR AS s FROM events")
def typed_fields(spark, sf_dir):
    """Fields as their inferred type; values that don't fit are null."""
    v = F.when(F.col("event_id") % 4 == 0, F.lit('{"x":null}')).otherwise(F.concat(F.lit('{"x":'), F.col("event_id") % 7, F.lit("}")))
    v = json_values.parsed(v)
    return table(spark, sf_dir, "events").select("event_id", json_values.typed(v, "x", "DOUBLE").alias("d"), json_values.typed(v, "x", "STRING").alias("s"))


@query("SELECT event_id, printf('%.3fs', value) AS duration, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created FROM events")
def time_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("long"))
    return rows.select("event_id", text.duration_text(F.col("ts"), end).alias("duration"), text.timestamp_text(F.col("ts")).alias("created"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN printf('%.0f', o_totalprice) ELSE rtrim(rtrim(printf('%.4f', o_totalprice), '0'), '.') END AS price FROM orders")
def number_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.number_text(F.col("o_totalprice")).alias("price"))


@query("SELECT c_custkey, ['yes', 'no', 'maybe'][('0x' || substr(sha256('|' || c_name), 1, 15))::BIGINT % 3 + 1] AS label FROM customer")
def sampled_labels(spark, sf_dir):
    """The seeded label sampler: the same answer for the same prompt."""
    return table(spark, sf_dir, "customer").select("c_custkey", sampling.random_label(F.col("c_name"), F.array(*[F.lit(x) for x in text.SHORT_LABELS])).alias("label"))


@query("""SELECT user_id AS run_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY user_id""")
def event_states(spark, sf_dir):
    """The state that a run's last event implies: purchases complete it, sign-ups fail it, others start it."""
    kind = F.when(F.col("event_type") == "purchase", "run.completed").when(F.col("event_type") == "signup", "run.failed").otherwise("run.started")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), kind.alias("event_type"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return store.event_states(rows)


@query("""SELECT k::VARCHAR AS step_key, '$.p' AS path, '"' || x || '"' AS run_a, '"' || y || '"' AS run_b FROM (SELECT a.k, a.h AS x, b.h AS y FROM """ + _EVEN + " a JOIN " + _ODD + """ b ON a.k = b.k) WHERE x <> y""")
def output_differences(spark, sf_dir):
    """Field by field, the outputs of steps that both runs have."""
    sides = [_run_steps(spark, sf_dir, even).withColumn("output", F.to_json(F.struct(F.col("input_hash").alias("p")))) for even in (True, False)]
    return compare.output_differences(compare.step_rows(*sides))
