"""Text embeddings: the method against numpy's own SVD, near copies above other pairs, and awkward texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from gaugeworks.operators import embedding


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def corpus(n=240, seed=3):
    r = random.Random(seed)
    topics = [[words(r, 1) for _ in range(60)] for _ in range(6)]
    return [" ".join(r.choice(topics[i % 6]) for _ in range(r.randint(20, 60))) for i in range(n)]


def test_directions_are_the_singular_ones(spark):
    texts = corpus()
    model = embedding.fit(spark.createDataFrame([(t,) for t in texts], "t string").repartition(4), "t", dims=5, buckets=512)
    x = embedding._rows(texts, model.weights)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, s[:5], rtol=1e-3)
    assert np.allclose(model.directions.T @ model.directions, np.eye(5), atol=1e-9)
    assert np.linalg.svd(v[:5] @ model.directions)[1].min() > 0.99  # the same space


def test_near_copies_rank_above_other_pairs(spark):
    """Documents against a copy with every tenth word changed, and against another document: precision 0.98 at least."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 200").select("doc_id", "text")
    changed = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 10 == 3, "zq").otherwise(w)), " ")
    others = docs.select((F.col("doc_id") - 7).alias("doc_id"), F.col("text").alias("other"))
    model = embedding.fit(docs, "text")
    rows = docs.withColumn("near", changed).join(others, "doc_id")
    told = embedding.similarities(embedding.similarities(rows, "text", "near", model, "s_near"), "text", "other", model, "s_other").select("s_near", "s_other").toPandas()
    assert len(told) > 50
    cut = np.sort(told["s_near"])[int(0.02 * len(told))]
    right, wrong = (told["s_near"] >= cut).sum(), (told["s_other"] >= cut).sum()
    assert right / (right + wrong) >= 0.9 and (told["s_near"] > told["s_other"]).mean() >= 0.98


def test_awkward_texts_and_repeats(spark):
    texts = ["", None, " ", "a", "Été à la plage", "ÉTÉ À  LA PLAGE", "日本語 🙂", "x" * 20_000, *corpus(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    model = embedding.fit(df, "t", dims=8, buckets=256)
    told = {r["i"]: r["e"] for r in embedding.embedded(df, "t", model, "e").collect()}
    assert told[4] == told[5] and all(len(e) == len(model.values) for e in told.values())
    again = embedding.fit(df.repartition(3), "t", dims=8, buckets=256)
    assert np.allclose(model.directions, again.directions, atol=1e-6)
    none = embedding.fit(df.filter("i < 0"), "t", dims=8, buckets=256)
    assert none.directions.shape == (256, 0) and embedding.embedded(df.filter("i < 0"), "t", none).count() == 0


def test_a_run_is_scored_by_embeddings(spark, tmp_path):
    """The default measure of the similarity evaluation; answers that repeat the golden text score 1."""
    from gaugeworks.operators import sampling
    from gaugeworks.plans import evaluate
    from gaugeworks.plans.store import Store

    sampling.register("openai", lambda _: lambda prompts: [p if p.startswith("t0") else "something else entirely" for p in prompts])
    texts = [f"t{i} " + t for i, t in enumerate(corpus(6))]
    rows = spark.createDataFrame([(t, t) for t in texts], "q string, a string")
    report = evaluate.run_similarity(Store(spark, str(tmp_path / "s")), rows, "q", "a", ["q"], model="openai:m")
    assert abs(report.metrics["max_similarity"] - 1) < 1e-9 and report.metrics["min_similarity"] < 0.9


def test_registered_similarities(spark):
    from gaugeworks.plans import registry_runs

    told = registry_runs.text_similarities(spark, "/root/testdata/sf0.001")
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"]).count()
    values = [r["similarity"] for r in told.collect()]
    assert len(values) == pairs and all(0 <= v <= 1 for v in values)
