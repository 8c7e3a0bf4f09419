import hashlib
import json

import pytest

from gaugeworks.sources import config, datasets
from gaugeworks.sources.datasets import DatasetError


def test_resolve():
    assert datasets.resolve("hf://a/b").kind == "hub" and datasets.resolve("huggingface://a").dataset == "a"
    for bad, why in (("a/b", "no scheme"), ("s3://x", "unknown scheme"), ("hf://", "names no dataset")):
        with pytest.raises(DatasetError, match=why):
            datasets.resolve(bad)


def test_splits():
    assert datasets.pick_split(["train", "validation"]) == "validation" and datasets.pick_split(["x", "y"]) == "x" and datasets.pick_split(["train", "test"]) == "test"
    with pytest.raises(DatasetError, match="train"):
        datasets.pick_split(["train"], "dev")
    with pytest.raises(DatasetError):
        datasets.effective_limit(0, 5)
    with pytest.raises(DatasetError):
        datasets.effective_limit(None, None)
    assert datasets.effective_limit(10, 5) == 5


def test_catalog_and_cache(spark, tmp_path):
    root = tmp_path / "mirror"
    for split in ("train", "test"):
        spark.range(30).write.parquet(str(root / "org/d" / "config=main" / f"split={split}"))
    catalog = datasets.Catalog(spark, str(root))
    at = catalog.resolved("hf://org/d")
    assert (at.config, at.split, at.source_id) == ("main", "test", "hf:org/d:main:test") and catalog.total_rows(at) == 30
    with pytest.raises(DatasetError, match="dataset_unavailable"):
        catalog.resolved("hf://org/none")
    cache = datasets.BatchCache(spark, str(tmp_path / "cache"))
    batch = cache.batch(at, catalog.rows(at), ["id"], 10, 5)
    assert [r["id"] for r in batch.orderBy("id").collect()] == [10, 11, 12, 13, 14]
    assert cache.batch(at, spark.range(0), ["id"], 10, 5).count() == 5  # read, not computed
    assert cache.batch(at, spark.range(0), ["id"], 99, 5).count() == 0


def test_typed_rows(spark):
    rows = [{"id": 1, "name": "a", "o": {"x": 1}, "s": 1.5}, {"id": 2, "o": "text", "active": True, "s": 2}, {"id": None, "name": 4}]
    df = datasets.typed_rows(spark.createDataFrame([(json.dumps(r),) for r in rows], "j string"), "j")
    assert df.dtypes == [("active", "boolean"), ("id", "bigint"), ("name", "string"), ("o", "string"), ("s", "double")]
    assert [tuple(r) for r in df.collect()] == [(None, 1, "a", '{"x":1}', 1.5), (True, 2, None, "text", 2.0), (None, None, "4", None, None)]


def test_paged_source(spark):
    class Numbers(datasets.PagedSource):
        source_id = "numbers"

        def initialize(self):
            return 25

        def load_batch(self, offset, n):
            return [{"v": i * i} for i in range(offset, offset + n)]

    spark.dataSource.register(Numbers)
    df = spark.read.format("numbers").option("batch_size", 10).load()
    assert df.rdd.getNumPartitions() == 3 and sorted((r["row_index"], json.loads(r["json"])["v"]) for r in df.collect()) == [(i, i * i) for i in range(25)]
    assert spark.read.format("numbers").option("max_rows", 7).load().count() == 7


def test_bundle():
    files = {"definition.toml": b"x", "prompts/a.txt": b"y"}
    digests = {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    assert datasets.local_bundle(files, digests) == files
    for bad, why in (({"../x": b""}, "leaves"), ({"a.toml": b"x"}, "exactly one")):
        with pytest.raises(DatasetError, match=why):
            datasets.local_bundle(bad, {n: hashlib.sha256(d).hexdigest() for n, d in bad.items()})
    with pytest.raises(DatasetError, match="digest"):
        datasets.local_bundle(files, {})


TOML = """
[benchmarks.mc]
type = "custom_nocode"
model = "random"
limit = 10
metrics = ["f1", { name = "confusion", show = "all" }]
[benchmarks.mc.style]
type = "multiple_choice"
choices = { columns = ["a", "b"] }
choice_labels = ["A", "B"]
answer = { correct_choice_column = "a" }
shuffle = { seed_column = "id" }
[benchmarks.code]
type = "custom_code"
command = ["python", "x.py"]
"""


def test_config(tmp_path):
    told = config.parse(TOML)
    for e in told.values():
        e.validate()
    assert told["mc"].style.correct_column == "a" and told["mc"].style.seed_column == "id"
    assert config.load(str(tmp_path)) == {}
    (tmp_path / "gaugeworks.toml").write_text(TOML)
    assert set(config.load(str(tmp_path))) == {"mc", "code"}
    (tmp_path / ".gaugeworks.toml").write_text(TOML)
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path))
    for old, new in (('["A", "B"]', '["A", "A"]'), ('["a", "b"]', '["a"]'), ('correct_choice_column = "a"', 'correct_choice_column = "z"'), ('"f1", {', '"confusion", {'), ('["python", "x.py"]', "[]")):
        with pytest.raises(config.ConfigError):
            for e in config.parse(TOML.replace(old, new)).values():
                e.validate()


def test_overrides_and_workspace(tmp_path):
    told = config.parse(TOML)
    assert config.assembled(told["mc"], {"limit": 3}) == ({"model": "random", "limit": 3}, ("limit",))
    with pytest.raises(config.ConfigError):
        config.assembled(told["mc"], {"style": 1})
    assert config.assembled(told["code"], {"command": ["x"]})[1] == ("command",)
    assert config.assembled(config.Evaluation("b", "builtin", {"n": 1}), {"m": 2}) == ({"m": 2}, ())
    made = config.init_workspace(str(tmp_path))
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert config.find_workspace(str(tmp_path / "a" / "b")) == made and config.find_workspace("/") is None
