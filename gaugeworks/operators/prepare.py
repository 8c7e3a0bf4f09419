"""From dataset rows to prepared samples: golden answers, labelled choices, shuffles, question-answering rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.hashing import hash_number
from gaugeworks.functions.json_values import coerced_text, field, kind_of, ordered_text, parsed, text_field
from gaugeworks.functions.text import ascii_lower, utrim

CHOICE = "struct<label:string,text:string>"
#: Prefix of the shuffle's seed; where the biomedical rows keep their parts, in order of preference.
SHUFFLE_SEED = "custom-nocode-choice-shuffle-v1"
QUESTION_KEYS = ("question", "query", "prompt", "input")
ANSWER_KEYS = ("final_decision", "finalDecision", "answer", "label", "target")
ID_KEYS = ("id", "qid", "question_id")
CONTEXT_KEYS = ("context", "abstract", "passage", "long_answer", "evidence")
CONTEXT_ORDER = ("contexts", "labels", "meshes")
CONTEXTS_ORDER = ("label", "contexts", "context", "abstract", "title")


def _raise(row: Column | None, text: str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit("row "), row.cast("string"), F.lit(": " + text)) if row is not None else F.lit(text)).cast(kind)


def choices_from_columns(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("string") for c in columns])


def choices_from_json(text: Column, labels: Sequence[str], row: Column | None = None) -> Column:
    """Texts of an array in its order, or of an object in the labels' order, each of which it must have; JSON text in a JSON string is opened too."""
    v = parsed(text)
    v = F.when(kind_of(v) == "STRING", parsed(F.try_variant_get(v, "$", "string"))).otherwise(v)
    kind = kind_of(v)
    items = F.try_variant_get(v, "$", "array<string>")
    named = F.array(*[F.coalesce(F.try_variant_get(field(v, k), "$", "string"), _raise(row, f"choice '{k}' is missing", "string")) for k in labels])
    return F.when(kind.startswith("ARRAY"), items).when(kind.startswith("OBJECT"), named).otherwise(_raise(row, "choices are neither an array nor an object", "array<string>"))


def checked_choices(choices: Column, labels: Sequence[str], row: Column | None = None) -> Column:
    """At least one choice, and no more than labels."""
    n = F.size(choices)
    return F.when((n >= 1) & (n <= len(labels)), choices).otherwise(_raise(row, f"between 1 and {len(labels)} choices are needed", "array<string>"))


def index_answer(index: Column, n: Column, base: int = 0, row: Column | None = None) -> Column:
    """0-based place of the correct choice from a number or numeric text that counts from `base`."""
    at = index.cast("string").try_cast("bigint") - base
    return F.when((at >= 0) & (at < n), at.cast("int")).otherwise(_raise(row, "the answer index is out of range", "int"))


def label_answer(label: Column, labels: Sequence[str], n: Column, row: Column | None = None) -> Column:
    """0-based place of a label, trimmed and with A-Z folded, among the first n labels."""
    folded = F.slice(F.array(*[ascii_lower(F.lit(x)) for x in labels]), F.lit(1), n)
    at = F.array_position(folded, ascii_lower(utrim(label.cast("string"))))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(_raise(row, "the answer is not one of the labels", "int"))


def column_answer(column: str, columns: Sequence[str]) -> Column:
    return F.lit(list(columns).index(column))


def shuffle_order(seed: Column, n: Column) -> Column:
    """A Fisher-Yates order of 0..n-1: step u, from n-1 down to 1, swaps u with the hash of seed and u modulo u+1."""

    def swap(order: Column, u: Column) -> Column:
        at = F.pmod(hash_number(F.concat_ws(":", F.lit(SHUFFLE_SEED), seed.cast("string"), u.cast("string"))), u + 1).cast("int")
        return F.transform(order, lambda x, i: F.when(i == u, F.get(order, at)).when(i == at, F.get(order, u)).otherwise(x))

    start = F.sequence(F.lit(0), n - 1)
    return F.when(n <= 1, start).otherwise(F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), start, swap))


def labelled(choices: Column, correct: Column, labels: Sequence[str], seed: Column | None = None) -> Column:
    """struct(choices: array of label and text, golden): in order, or shuffled by a seed, with the golden label following its text."""
    n = F.size(choices)
    order = shuffle_order(seed, n) if seed is not None else F.sequence(F.lit(0), n - 1)
    names = F.slice(F.array(*[F.lit(x) for x in labels]), F.lit(1), n)
    texts = F.transform(order, lambda i: F.get(choices, i))
    return F.struct(
        F.zip_with(names, texts, lambda k, t: F.struct(k.alias("label"), t.alias("text"))).alias("choices"),
        F.element_at(names, F.array_position(order, correct).cast("int")).alias("golden"),
    )


def short_answer(v: Column) -> Column:
    """yes, no or maybe from the first of the answer columns that says so, else null."""
    out = []
    for k in ANSWER_KEYS:
        text = F.lower(utrim(text_field(v, k)))
        out.append(F.when(text.isin("yes", "no", "maybe"), text))
    return F.coalesce(*out)


def question_context(v: Column) -> Column:
    """The first string that isn't empty, else the flattened context or contexts, named parts first."""
    direct = [F.nullif(text_field(v, k), F.lit("")) for k in CONTEXT_KEYS]
    nested = [F.nullif(ordered_text(field(v, k), order), F.lit("")) for k, order in (("context", CONTEXT_ORDER), ("contexts", CONTEXTS_ORDER))]
    return F.coalesce(*direct, *nested, F.lit(""))


def question_rows(rows: DataFrame, json: str = "json", strict: bool = True) -> DataFrame:
    """sample_id, question, context, gold_answer of biomedical rows.

    A question column that is present but empty ends the search. A row without a question or an answer raises if strict,
    else it is dropped.
    """
    v = parsed(F.col(json))
    question = F.coalesce(*[text_field(v, k) for k in QUESTION_KEYS], F.lit(""))
    told = rows.withColumns({"question": question, "context": question_context(v), "gold_answer": short_answer(v), "_id": F.coalesce(*[text_field(v, k) for k in ID_KEYS])})
    sound = (F.col("question") != "") & F.col("gold_answer").isNotNull()
    if strict:
        told = told.withColumn("question", F.when(sound, F.col("question")).otherwise(F.raise_error(F.lit("missing question or gold answer")).cast("string")))
    else:
        told = told.filter(sound)
    own = F.substring(F.sha2(F.concat_ws("|", "question", "context", "gold_answer"), 256), 1, 16)
    return told.withColumn("sample_id", F.coalesce("_id", own)).drop("_id")


def flattened_text(json: Column) -> Column:
    return coerced_text(json)


def validated(rows: DataFrame, json: str, schema: str, on_error: str = "fail", max_rows: int | None = None, order: str | None = None, index: str | None = None) -> DataFrame:
    """Rows of a declared schema. `skip` drops those that don't fit, after max_rows has counted them; `fail` raises, with
    the row's number where `index` names its column."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    if max_rows is not None:
        rows = (rows.orderBy(order) if order else rows).limit(max_rows)
    names = [c.split()[0] for c in schema.split(",")]
    row = F.from_json(json, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    told = rows.select("*", row.alias("_row"))
    whole = F.col("_row").isNotNull() & F.col("_row._bad").isNull()
    for n in names:
        whole = whole & F.col(f"_row.{n}").isNotNull()
    if on_error == "skip":
        return told.filter(whole).select(*[F.col(f"_row.{n}").alias(n) for n in names])
    checked = F.when(whole, F.col("_row")).otherwise(F.raise_error(F.concat(F.concat(F.lit("row "), F.col(index).cast("string"), F.lit(": ")) if index else F.lit(""), F.lit("invalid row data: "), F.coalesce(F.col(json), F.lit("null")))))
    return told.withColumn("_row", checked).select(*[F.col(f"_row.{n}").alias(n) for n in names])
