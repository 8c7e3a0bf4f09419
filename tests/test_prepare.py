import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import prepare, template
from gaugeworks.plans.evaluate import prepared
from gaugeworks.sources.config import Style

L = ("A", "B", "C", "D")


def row(spark, **v):
    return spark.createDataFrame([tuple(v.values()) + (4,)], ", ".join(f"`{k}` {'long' if isinstance(x, int) else 'array<string>' if isinstance(x, list) else 'string'}" for k, x in v.items()) + ", row_index long")


def test_object_choices(spark):
    df = row(spark, options=json.dumps({"A": "alpha", "B": "beta", "D": "delta", "C": "gamma"}), answer_idx=" c ")
    r = prepared(df, Style("multiple_choice", choice_column="options", labels=L, label_column="answer_idx")).first()
    assert r["golden"] == "C" and r["choices"][2]["text"] == "gamma" and r["labels"] == list(L)


def test_array_choices_truncate_labels(spark):
    r = prepared(row(spark, options=["x", "y", "z"], answer="b"), Style("multiple_choice", choice_column="options", labels=tuple("ABCDEFGHIJ"), label_column="answer")).first()
    assert r["golden"] == "B" and r["labels"] == ["A", "B", "C"]
    with pytest.raises(Exception, match="row 4"):
        prepared(row(spark, options=["x", "y", "z"], answer="d"), Style("multiple_choice", choice_column="options", labels=tuple("ABCDEFGHIJ"), label_column="answer")).collect()


@pytest.mark.parametrize("cop, base", [(1, 0), ("1", 0), (2, 1)])
def test_index_answers(spark, cop, base):
    r = prepared(row(spark, opa="a", opb="b", opc="c", opd="d", cop=cop), Style("multiple_choice", choice_columns=("opa", "opb", "opc", "opd"), labels=L, index_column="cop", index_base=base)).first()
    assert r["golden"] == "B" and [c["text"] for c in r["choices"]] == list("abcd")


def shuffled(values, seed):
    values = list(values)
    for u in range(len(values) - 1, 0, -1):
        j = int(hashlib.sha256(f"custom-nocode-choice-shuffle-v1:{seed}:{u}".encode()).hexdigest()[:15], 16) % (u + 1)
        values[u], values[j] = values[j], values[u]
    return values


def test_shuffle(spark):
    df = spark.range(200).withColumns({"Correct": F.lit("right"), "W 1": F.lit("w1"), "W 2": F.lit("w2"), "Record ID": F.concat(F.lit("r"), "id"), "row_index": F.col("id")})
    style = Style("multiple_choice", choice_columns=("Correct", "W 1", "W 2"), labels=L[:3], correct_column="Correct", seed_column="Record ID")
    for r in prepared(df, style).collect():
        texts = [c["text"] for c in r["choices"]]
        assert texts == shuffled(["right", "w1", "w2"], r["Record ID"]) and texts[L.index(r["golden"])] == "right"
    assert spark.range(1).select(prepare.shuffle_order(F.lit("x"), F.lit(1)).alias("o")).first()["o"] == [0]


def test_biomedical(spark):
    rows = [
        {"question": "Q1", "context": "C1", "final_decision": " YES ", "id": "7"},
        {"query": "Q2", "abstract": "C2", "answer": "no", "qid": "8"},
        {"prompt": "Q3", "contexts": {"title": "t", "label": "l", "context": "c", "zz": "last"}, "label": "maybe", "question_id": "9"},
        {"question": "Q4", "context": {"meshes": ["m"], "contexts": ["a", "b"], "labels": ["l"]}, "final_decision": "yes", "pubid": 1},
        {"input": "Q5", "contexts": ["one", "two"], "target": "No", "id": "x"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "json string")
    told = {r["question"]: r for r in prepare.question_rows(df).collect()}
    assert [told[f"Q{i}"]["gold_answer"] for i in range(1, 6)] == ["yes", "no", "maybe", "yes", "no"]
    assert [told[f"Q{i}"]["context"] for i in range(1, 6)] == ["C1", "C2", "l\nc\nt\nlast", "a\nb\nl\nm", "one\ntwo"]
    assert told["Q1"]["sample_id"] == "7" and len(told["Q4"]["sample_id"]) == 16
    bad = spark.createDataFrame([(json.dumps({"question": "", "query": "q", "answer": "yes"}),)], "json string")
    with pytest.raises(Exception, match="missing question"):
        prepare.question_rows(bad).collect()
    assert prepare.question_rows(bad, strict=False).count() == 0


def test_validated(spark):
    df = spark.createDataFrame([(1, '{"id":1,"name":"a"}'), (2, '{"id":"x"}'), (3, '{"id":3,"name":"c"}'), (4, '{"id":4,"name":"d"}')], "n int, j string")
    assert [r["id"] for r in prepare.validated(df.filter("n < 4"), "j", "id long, name string", "skip").collect()] == [1, 3]
    assert prepare.validated(df, "j", "id long, name string", "skip", max_rows=2, order="n").count() == 1  # the bad row counts
    with pytest.raises(Exception, match="invalid row data"):
        prepare.validated(df, "j", "id long, name string").collect()


def test_template(spark):
    df = spark.createDataFrame([("q", {"b": "in"}, ["x", "y"], None)], "`a b` string, s struct<b:string>, xs array<string>, n string")
    r = template.render(df, "{# c #}{{ row[\"a b\"] }} {{ row.s.b }} {{ row.xs | join('-') }}{{ row.n }}{{ row.none }}\n\n").first()
    assert r["prompt"] == "q in x-y\n\n"
    df = df.withColumn("choices", F.array(F.struct(F.lit("A").alias("label"), F.lit("t").alias("text"))))
    assert template.render(df, "{% for c in choices %}{{ loop.index }}{{ c.label }}. {{ c.text }};{% endfor %}", "choices").first()["prompt"] == "1A. t;"
    for bad in ("{{ x }}", "{% if row.n %}", "{% for c in choices %}", "{{ row.n | shout }}", "{{ row.n", "{{ row.n is odd }}", "{% for c in row.n %}{% endfor %}", "{{ row }}", "{{ (row.n }}", "{{ row.n + 1 }}", "{% endif %}", "{{ row.xs < 'a' }}", "{{ row.n | replace('a') }}", "{% macro m() %}"):
        with pytest.raises(template.TemplateError):
            template.render(df, bad, "choices")


@pytest.mark.parametrize("source, out", [
    ("{% if row.n > 2 %}big{% elif row.n == 2 %}two{% else %}small{% endif %}", ["small", "two", "big", "small"]),
    ("{% if row.t and not row.xs %}a{% endif %}|{{ 'y' if row.n is none else row.n }}", ["|1", "a|2", "|3", "|y"]),
    ("{% if row.n == 1 or row.n == 3 and row.t == 'zz' %}hit{% endif %}", ["hit", "", "", ""]),
    ("{% if (row.n == 1 or row.n == 3) and row.t == 'up' %}hit{% endif %}", ["hit", "", "", ""]),
    ("{% for x in row.xs %}{{ loop.index }}/{{ loop.length }}{{ x | upper }}{% if not loop.last %}, {% endif %}{% else %}none{% endfor %}", ["1/2A, 2/2B", "none", "1/1C", "none"]),
    ("{% for g in row.gs %}[{% for m in g.ms %}{{ g.k }}{{ m }}{% if m in row.xs %}!{% endif %}{% endfor %}]{% endfor %}", ["[pa!px][]", "", "[rc!]", ""]),
    ("{{ row.t | default('-') | upper ~ '.' }} {{ row.xs | length }} {{ row.xs | first }}{{ row.xs|last }} {{ row.xs | join(', ') }}", ["UP. 2 ab a, b", "DOWN. 0  ", "-. 1 cc c", "-.   "]),
    ("{% if 'o' in row.t %}o{% endif %}{% if 'x' not in row.xs %}x{% endif %}{{ row.t | replace('u', '\\'') }}", ["x'p", "oxdown", "x", "x"]),
    ("a  {%- if row.n >= 2 -%}  b  {%- endif %} c", ["a c", "ab c", "ab c", "a c"]),
    ("{% if row.n == '1' %}text{% endif %}{% if row.n != 1.0 %}other{% endif %}{{ row.t is string }}", ["true", "othertrue", "otherfalse", "otherfalse"]),
])
def test_template_statements(spark, source, out):
    group = "struct<k:string,ms:array<string>>"
    df = spark.createDataFrame([(1, "up", ["a", "b"], [("p", ["a", "x"]), ("q", [])], 1), (2, "down", [], None, 2), (3, None, ["c"], [("r", ["c"])], 3), (4, None, None, [], None)], f"i int, t string, xs array<string>, gs array<{group}>, n int")
    assert [r["prompt"] for r in template.render(df, source).orderBy("i").collect()] == out

