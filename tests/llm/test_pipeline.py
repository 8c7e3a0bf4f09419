import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import cases
import pytest

import corpus_pipeline
from gaugeworks.llm import exact_dedup, repeats, shingle_join


def test_stages_on_cases(spark, tmp_path):
    docs = cases.docs(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"]) for r in kept.select("text").collect())
        if name == "exact_dedup":
            assert kept.count() == exact_dedup.exact_dedup(docs).filter("kept").count()
            assert exact_dedup.exact_dedup(kept).filter("group_size > 1").count() == 0
        if name == "near_dedup":
            assert kept.count() == shingle_join.shingle_join(docs).select("class_id").distinct().count()
            assert shingle_join.shingle_join(kept).filter("n_links > 0").count() == 0
        if name == "repeat_removal":
            assert kept.count() == docs.count() and repeats.remove_repeats(docs).filter("_gw_removed > 0").count() > 0
        docs = kept
    assert docs.count() > 0


def test_empty(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run(spark, sf):
    import __spark_entry__

    told = corpus_pipeline.run(spark, f"/root/testdata/{sf}")
    assert told.columns[0] == "doc_id" and told.count() > 100
    assert "pipeline" in __spark_entry__.queries() and sum(n.startswith("op") for n in __spark_entry__.queries()) == 10
