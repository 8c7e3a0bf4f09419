"""JSON text as VARIANT: typed extraction, inference of column types, differences, provider responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import utrim


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def path_of(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def kind_of(v: Column) -> Column:
    """STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY<..>, OBJECT<..>, VOID."""
    return F.schema_of_variant(v)


def field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, path_of(key), "variant")


def text_field(v: Column, key: str) -> Column:
    """A field that is a string; other types are null, not converted."""
    inner = field(v, key)
    return F.when(kind_of(inner) == "STRING", F.try_variant_get(inner, "$", "string"))


def scalar_text(v: Column) -> Column:
    """Strings as they are, numbers and booleans as text; anything else is null."""
    kind = kind_of(v)
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID")
    return F.when(~nested, F.try_variant_get(v, "$", "string"))


def required_scalar(v: Column, key: str, row: Column, what: str) -> Column:
    """scalar_text of a field; a missing or nested one raises with the row, the kind of value and the column."""
    value = scalar_text(field(v, key))
    return F.coalesce(value, F.raise_error(F.concat(F.lit("row "), row.cast("string"), F.lit(f": {what} column '{key}' is missing or not a scalar"))).cast("string"))


def coerced_text(json: Column) -> Column:
    """Trimmed strings of JSON text at any depth, joined by newlines, empty ones skipped, other scalars ignored; keys in order.

    A variant writes its JSON with sorted keys, so what is wanted are the string literals in it that aren't followed by a
    colon. Escaped backslashes and quotes first make way for two control characters, which JSON never holds as they are:
    then a literal ends at the next quote, and no expression needs to follow the nesting. Text that doesn't parse gives "".
    """
    slash, quote = F.lit("\x01"), F.lit("\x02")
    plain = F.replace(F.replace(F.to_json(F.try_parse_json(json)), F.lit("\\\\"), slash), F.lit('\\"'), quote)
    found = F.filter(F.regexp_extract_all(plain, F.lit('"[^"]*+":?'), F.lit(0)), lambda s: ~s.endswith(":"))
    whole = lambda s: F.replace(F.replace(s, quote, F.lit('\\"')), slash, F.lit("\\\\"))
    texts = F.transform(found, lambda s: utrim(F.try_variant_get(F.try_parse_json(whole(s)), "$", "string")))
    return F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), "\n"), F.lit(""))


def ordered_text(v: Column, first: Sequence[str]) -> Column:
    """An object's values as text, the named keys first and the rest sorted; an array's items; joined by newlines."""
    kind = kind_of(v)
    parts = [coerced_text(F.to_json(field(v, k))) for k in first]
    rest = coerced_text(F.to_json(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*first))))
    named = F.array_join(F.filter(F.array(*parts, rest), lambda t: t != ""), "\n")
    return F.when(kind.startswith("OBJECT"), named).when(kind.startswith("ARRAY"), coerced_text(F.to_json(v))).otherwise(F.lit(""))


def inferred_types(rows: DataFrame, json: str) -> DataFrame:
    """key, type of each top-level key over all rows.

    Any string or nested value makes STRING; booleans alone BOOLEAN; 64-bit integers alone BIGINT; any other mix of
    numbers and booleans DOUBLE; nothing but nulls STRING. Whole numbers beyond 64 bits count as DOUBLE.
    """
    v = F.explode(F.try_variant_get(parsed(F.col(json)), "$", "map<string,variant>"))
    kinds = rows.select(v.alias("key", "value")).select("key", kind_of(F.col("value")).alias("kind"))
    is_text = (F.col("kind") == "STRING") | F.col("kind").startswith("ARRAY") | F.col("kind").startswith("OBJECT")
    real = F.col("kind").isin("DOUBLE", "FLOAT") | F.col("kind").startswith("DECIMAL")
    told = kinds.groupBy("key").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("t", is_text), ("b", F.col("kind") == "BOOLEAN"), ("i", F.col("kind").isin("BIGINT", "INT", "SMALLINT", "TINYINT")), ("d", real))])
    kind = F.when(F.col("t"), "STRING").when(F.col("d") | (F.col("i") & F.col("b")), "DOUBLE").when(F.col("b"), "BOOLEAN").when(F.col("i"), "BIGINT").otherwise("STRING")
    return told.select("key", kind.alias("type"))


def typed(v: Column, key: str, kind: str) -> Column:
    """A field as the inferred type: values that don't fit are null, anything fits STRING (nested values as JSON)."""
    inner = field(v, key)
    own = kind_of(inner)
    if kind == "STRING":
        return F.when(own == "STRING", F.try_variant_get(inner, "$", "string")).when(own == "VOID", F.lit(None).cast("string")).otherwise(F.to_json(inner))
    fits = (own == "BOOLEAN") if kind == "BOOLEAN" else ~own.isin("BOOLEAN", "STRING")
    return F.when(fits, F.try_variant_get(inner, "$", kind.lower()))


def same(a: Column, b: Column) -> Column:
    """Equality of two variants: objects in any order of keys, 1 and 1.0 apart; two missing ones are equal."""
    return F.to_json(a).eqNullSafe(F.to_json(b)) & kind_of(a).eqNullSafe(kind_of(b))


def field_differences(rows: DataFrame, left: str, right: str, *keys: str) -> DataFrame:
    """path, run_a, run_b for each top-level key on which two JSON texts differ; `$` if one of them is no object.

    A key with null and a missing key differ. Rows in which either text isn't JSON have no differences.
    """
    both = rows.select(*keys, parsed(F.col(left)).alias("_a"), parsed(F.col(right)).alias("_b")).filter("_a is not null and _b is not null")
    objects = kind_of(F.col("_a")).startswith("OBJECT") & kind_of(F.col("_b")).startswith("OBJECT")
    a, b = F.try_variant_get("_a", "$", "map<string,variant>"), F.try_variant_get("_b", "$", "map<string,variant>")
    inside = both.filter(objects).select(*keys, a.alias("_a"), b.alias("_b")).select("*", F.explode(F.array_union(F.map_keys("_a"), F.map_keys("_b"))).alias("_k"))
    x, y = F.try_element_at("_a", F.col("_k")), F.try_element_at("_b", F.col("_k"))
    in_a, in_b = F.map_contains_key("_a", F.col("_k")), F.map_contains_key("_b", F.col("_k"))
    fields = inside.filter(~(same(x, y) & (in_a == in_b))).select(*keys, F.concat(F.lit("$."), "_k").alias("path"), F.to_json(x).alias("run_a"), F.to_json(y).alias("run_b"))
    whole = both.filter(~objects & ~same(F.col("_a"), F.col("_b"))).select(*keys, F.lit("$").alias("path"), F.to_json("_a").alias("run_a"), F.to_json("_b").alias("run_b"))
    return fields.unionByName(whole)


def provider_text(response: Column) -> Column:
    """The text of a provider's JSON answer, wherever it usually is; a truncated answer raises."""
    v = parsed(response)
    cut = F.try_variant_get(v, "$.result.choices[0].finish_reason", "string") == "length"
    places = ("$.result.response", "$.result.choices[0].message.content", "$.result")
    found = [F.when(kind_of(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string")) for p in places]
    return F.when(cut, F.raise_error(F.lit("the response was truncated")).cast("string")).otherwise(F.coalesce(*found))


def error_text(body: Column, status: Column) -> Column:
    """The error field of a JSON body, else the body, else `HTTP <code>`."""
    told = F.try_variant_get(parsed(body), "$.error", "string")
    return F.coalesce(told, F.nullif(utrim(body), F.lit("")), F.concat(F.lit("HTTP "), status.cast("string")))
