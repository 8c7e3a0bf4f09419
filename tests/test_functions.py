import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import hashing, json_values, similarity, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'long'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("o")).first()["o"]


@pytest.mark.parametrize("said, label", [("yes", "yes"), ("Yes.", "yes"), ("(maybe)", "maybe"), ("**maybe**", "maybe"), ("I think no.", "no"), ("a b c d e yes", None), ("", None), ("The answer is no.", "no"), (None, None), (" NO ", "no"), ("maybe, based on it", "maybe")])
def test_short_label(spark, said, label):
    assert one(spark, text.short_label(F.col("x")), x=said) == label


@pytest.mark.parametrize("said, label", [("B", "B"), ("The answer is (c).", "C"), ("unknown", None), ("", None), (" b\n", "B"), ("a b c then d", "D"), ("A one two three four five six seven eight", None), (None, None), ("K", None)])
def test_choice_label(spark, said, label):
    assert one(spark, text.choice_label(F.col("x"), ["A", "B", "C", "D", "K"]), x=said) == label


def test_matches(spark):
    assert one(spark, text.exact_match(F.col("a"), F.col("b")), a="　Paris \n", b="Paris") is True
    assert one(spark, text.exact_match(F.col("a"), F.col("b")), a="paris", b="Paris") is False
    assert one(spark, text.exact_match(F.col("a"), F.col("b")), a=None, b="Paris") is False
    assert one(spark, text.utrim(F.col("a")), a="​x﻿ ") == "​x﻿"
    assert one(spark, text.short_label_anywhere(F.col("a")), a="Well, NO it is") == "no"


@pytest.mark.parametrize("said", ["Well, NO it is", "\u00fcno, yes", "no\u00e9 yes", "e\u0301no", "no\u0301 yes", "\u4e2dmaybe\u4e2d", "\u0130no, yes", "a_no no1 2no Maybe", "\u212ano yes", "yes\nno", "knows", "", None])
def test_short_label_anywhere_is_its_sql(spark, said):
    expected = duckdb.execute(r"SELECT nullif(regexp_extract(lower(?::VARCHAR), '\b(yes|no|maybe)\b', 1), '')", [said]).fetchone()[0]
    assert one(spark, text.short_label_anywhere(F.col("a")), a=said) == expected


@pytest.mark.parametrize("x, signed, out", [(3.0, False, "3"), (0.5, True, "+0.5"), (0.00012, False, "0.00012"), (-0.25, True, "-0.25"), (1.23456, False, "1.2346"), (0.0, True, "0")])
def test_number_text(spark, x, signed, out):
    assert one(spark, text.number_text(F.col("x"), signed), x=x) == out


def test_numbers_text(spark):
    assert one(spark, text.numbers_text(F.col("x")), x=[1.0, 2.5]) == "1, 2.5"
    assert one(spark, text.numbers_text(F.array().cast("array<double>"))) == "-"


def test_token_estimate(spark):
    assert one(spark, text.token_estimate(F.col("x")), x=" a b\tc ") == 4
    assert one(spark, text.token_estimate(F.col("x")), x=None) == 0


def test_durations(spark):
    a, b = F.timestamp_micros(F.lit(0)), F.timestamp_micros(F.lit(1_234_000))
    assert one(spark, text.duration_text(a, b)) == "1.234s"
    assert one(spark, text.duration_text(a, F.lit(None).cast("timestamp"))) is None
    assert one(spark, text.numbers_text(F.array(F.lit(None).cast("double"), F.lit(0.5)), True)) == "-, +0.5"
    assert one(spark, text.timestamp_text(b)) == "1970-01-01T00:00:01.234000Z"
    assert one(spark, F.unix_micros(text.parsed_timestamp(F.lit("nonsense")))) == 0


def test_ladders(spark):
    assert one(spark, text.keyword_label(F.col("x"), text.TICKET_RULES_FULL, "how_to"), x="I was CHARGED twice") == "billing"
    assert one(spark, text.keyword_label(F.col("x"), text.TICKET_RULES_FULL, "how_to"), x="please export all invoices") == "how_to"
    assert one(spark, text.keyword_label(F.col("x"), text.TICKET_RULES_LEADING, "billing"), x="it freezes") == "bug"


def test_levenshtein(spark):
    f = lambda a, b: one(spark, similarity.levenshtein_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert f("", "") == 1 and f("abc", "abc") == 1 and f("abc", "") == 0 and f("kitten", "sitting") == pytest.approx(1 - 3 / 7) and f("é", "e") == 0


def test_cosine(spark):
    f = lambda a, b: one(spark, similarity.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert f([1.0, 0.0], [2.0, 0.0]) == 1 and f([1.0, 0.0], [0.0, 1.0]) == 0 and f([0.0], [1.0]) == 0 and f([1.0, 9.0], [-1.0]) == -1
    assert one(spark, similarity.text_cosine(F.col("a"), F.col("b")), a="same text", b="same text") == pytest.approx(1)
    assert similarity.measure() is similarity.text_cosine
    with pytest.raises(ValueError):
        similarity.measure("hamming")


def test_hashes(spark):
    h = one(spark, hashing.input_hash(F.col("a")), a="x")
    assert len(h) == 16 and h != one(spark, hashing.input_hash(F.col("a")), a="y") and h == one(spark, hashing.input_hash(F.col("a")), a="x")
    k = hashing.cache_key("d", "c", "s")
    assert len(k) == 64 and k != hashing.cache_key("d", "c", "s", "r")
    assert hashing.canonical({"b": 1, "a": [None, {"z": None}], "n": None}) == '{"a":[null,{}],"b":1}'
    assert hashing.canonical({"é": None}, drop_nulls=False, ascii_only=False) == '{"é":null}'
    assert one(spark, hashing.canonical_json(F.col("a")), a='{"b":1.0,"a":2}') == '{"a":2,"b":1.0}'
    assert one(spark, hashing.canonical_json(F.col("a")), a="{") is None


def test_text_fields(spark):
    v = json_values.parsed(F.col("j"))
    assert one(spark, json_values.text_field(v, "a"), j='{"a":"x"}') == "x"
    assert one(spark, json_values.text_field(v, "a"), j='{"a":1}') is None
    assert one(spark, json_values.required_scalar(v, "a b", F.lit(4), "golden"), j='{"a b":1.5}') == "1.5"
    with pytest.raises(Exception, match="row 4"):
        one(spark, json_values.required_scalar(v, "a", F.lit(4), "golden"), j='{"a":[1]}')


@pytest.mark.parametrize("values, kind", [([True, False], "BOOLEAN"), ([1, 2, None], "BIGINT"), ([1.5, 2.5], "DOUBLE"), ([1, 2.5], "DOUBLE"), ([1, True], "DOUBLE"), (["a", 1], "STRING"), ([None, None], "STRING"), ([[1], 2], "STRING"), ([{"a": 1}], "STRING"), ([2**70], "DOUBLE")])
def test_inference(spark, values, kind):
    rows = spark.createDataFrame([(json.dumps({"k": v}),) for v in values], "j string")
    assert {r["key"]: r["type"] for r in json_values.inferred_types(rows, "j").collect()} == {"k": kind}


def test_differences(spark):
    rows = spark.createDataFrame([(1, '{"a":1,"b":null,"c":{"y":1,"x":2}}', '{"a":1.5,"c":{"x":2,"y":1}}'), (2, "[1]", "[2]"), (3, "not json", "{}"), (4, '{"a":1}', '{"a":1}')], "id int, a string, b string")
    told = {(r["id"], r["path"]): (r["run_a"], r["run_b"]) for r in json_values.field_differences(rows, "a", "b", "id").collect()}
    assert told == {(1, "$.a"): ("1", "1.5"), (1, "$.b"): ("null", None), (2, "$"): ("[1]", "[2]")}


def test_coercion(spark):
    f = lambda t: one(spark, json_values.coerced_text(F.col("j")), j=t)
    assert f('" x "') == "x" and f('["a", ["b", ""], 4]') == "a\nb" and f('{"b":"2","a":"1"}') == "1\n2" and f("null") == "" and f("42") == "" and f(None) == ""


def test_provider_shapes(spark):
    f = lambda t: one(spark, json_values.provider_text(F.col("j")), j=t)
    assert f('{"result":{"response":"a"}}') == "a" and f('{"result":{"choices":[{"message":{"content":"b"}}]}}') == "b" and f('{"result":"c"}') == "c" and f('{"result":{}}') is None
    with pytest.raises(Exception, match="truncated"):
        f('{"result":{"choices":[{"message":{"content":"b"},"finish_reason":"length"}]}}')
    assert one(spark, json_values.error_text(F.col("j"), F.lit(503)), j="") == "HTTP 503"
    assert one(spark, json_values.error_text(F.col("j"), F.lit(503)), j='{"error":"no"}') == "no"
    random.seed(0)


def slow_text(value):
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        value = [value[k] for k in sorted(value)]
    return "\n".join(t for t in map(slow_text, value) if t) if isinstance(value, list) else ""


def test_nested_text_without_python(spark):
    """Random JSON down to depth 8 with quotes, backslashes, colons, control characters and blanks in keys and values; no Python in the plan."""
    import json
    import random

    r = random.Random(12)
    pieces = ["a", "b c", '"', "\\", '\\"', '":', ":", "\n", "\t ", "{", "[,]", "é", "\u65e5", "\x01", "\x02", "//", " "]
    word = lambda: "".join(r.choice(pieces) for _ in range(r.randint(0, 5)))

    def value(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice([word(), word(), word(), 1, 2.5, True, None])
        if kind < 0.6:
            return [value(depth - 1) for _ in range(r.randint(0, 4))]
        return {word(): value(depth - 1) for _ in range(r.randint(0, 4))}

    values = [value(8) for _ in range(400)] + [{"a": {"b": {"c": {"d": {"e": {"f": ["deep", {"g": " x "}]}}}}}}, "x\n" * 20_000]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0) for i, v in enumerate(values)] + ["{", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", json_values.coerced_text(F.col("t")).alias("o"))
    told = {r["i"]: r["o"] for r in df.collect()}
    assert [told[i] for i in range(len(values))] == [slow_text(v) for v in values]
    assert [told[len(values) + i] for i in range(3)] == ["", "", ""]
    from gaugeworks.plans import registry

    for plan in (df, registry.question_rows(spark, "/root/testdata/sf0.001")):
        assert not any(w in plan._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Arrow"))
