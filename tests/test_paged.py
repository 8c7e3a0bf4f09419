"""Pages by row groups: which ones a page opens, conditions that narrow it, counts from footers."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from gaugeworks.sources import paged


@pytest.fixture
def folder(tmp_path):
    """Three files of 70, 5 and 120 rows, in row groups of 25 at most; i counts through them."""
    at = 0
    for name, n in (("a", 70), ("b", 5), ("c", 120)):
        pq.write_table(pa.table({"i": pa.array(range(at, at + n)), "s": [None if i % 3 == 0 else f"x{i}" for i in range(at, at + n)]}), tmp_path / f"{name}.parquet", row_group_size=25)
        at += n
    (tmp_path / "_SUCCESS").touch()
    return str(tmp_path)


def groups(folder, offset=0, limit=None, filters=()):
    reader = paged.PageReader(folder, ["i"], offset, limit)
    left = list(reader.pushFilters(list(filters)))
    return [(p.path[-9], p.group, p.first + p.skip, p.take) for p in reader.partitions() if p.take], left


def test_a_page_opens_its_row_groups_only(folder):
    assert paged.total_rows(folder) == 195 and len(groups(folder)[0]) == 9
    assert groups(folder, 30, 10)[0] == [("a", 1, 30, 10)]
    assert groups(folder, 45, 40)[0] == [("a", 1, 45, 5), ("a", 2, 50, 20), ("b", 0, 70, 5), ("c", 0, 75, 10)]
    assert groups(folder, 190, 100)[0] == [("c", 4, 190, 5)] and groups(folder, 500, 10)[0] == []


def test_conditions_narrow_the_page(folder):
    row, other = ("row_index",), ("i",)
    told, left = groups(folder, 0, None, [GreaterThanOrEqual(row, 72), LessThan(row, 80), EqualTo(other, 3)])
    assert told == [("b", 0, 72, 3), ("c", 0, 75, 5)] and left == [EqualTo(other, 3)]
    assert groups(folder, 0, 10, [EqualTo(row, 12)])[0] == []


def test_pages_are_the_rows(spark, folder):
    whole = [(i, i, None if i % 3 == 0 else f"x{i}") for i in range(195)]
    assert sorted(map(tuple, paged.pages(spark, folder).collect())) == whole
    told = [r for at in range(0, 195, 40) for r in map(tuple, paged.pages(spark, f"file:{folder}", at, 40).collect())]
    assert sorted(told) == whole
    some = paged.pages(spark, folder, columns=["s"]).filter("row_index between 60 and 76")
    assert some.columns == ["row_index", "s"] and sorted(r["row_index"] for r in some.collect()) == list(range(60, 77))
    assert some.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        paged.pages(spark, folder, 0, 0)


def test_all_pages_are_one_scan(spark, folder):
    rows = paged.numbered_pages(spark, folder, 40, ["i"])
    assert sorted(map(tuple, rows.collect())) == [(i, i, i // 40) for i in range(195)]
    assert rows.rdd.getNumPartitions() == paged.numbered_pages(spark, folder, 1).rdd.getNumPartitions() == 9
    with pytest.raises(ValueError):
        paged.numbered_pages(spark, folder, 0)


def test_the_plan_of_mirrored_pages_is_that_of_a_single_page(spark, tmp_path):
    from gaugeworks.plans import registry_runs

    n = 12_001
    pq.write_table(pa.table({"o_orderkey": range(n), "o_custkey": [i % 7 for i in range(n)]}), tmp_path / "orders.parquet", row_group_size=4000)
    rows = registry_runs.mirrored_pages(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4 and "Union" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(i, i, i % 7, i // 5000) for i in range(n)]


def test_no_files(spark, tmp_path):
    assert paged.pages(spark, str(tmp_path)).count() == 0 and paged.total_rows(str(tmp_path)) == 0
