"""Quality rules: one threshold table compiled into one Spark projection, without user functions.

Words are runs of anything but space and U+0009..U+000D; lines are split at U+000A. A word counts as
repeated if a window of three words that holds it occurs at least twice in its text; windows are
compared by 64-bit hashes within one document (for 20,000 words two differing windows agree with a
chance of 1e-11). Every measure is one expression over the row, so there is no shuffle.

Stop words are known of English, French, German and Spanish (`stop_words` is a parameter); the ratio is the share of a
text's words that are one of them, in lower case, capitalised or in upper case. Prose of these languages has about a
quarter of them. Prose of any other language has hardly any and isn't kept, unless its own are given or the rule is left out.

Cases: null and empty texts have no words and fail; a very long text is one row like any other, its measures in memory
of some times its size; bounds themselves pass, so a ratio that ties with one is kept; repeated rows are judged alike; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents

BLANKS = r"[\x20\x09-\x0D]+"
#: Fixed by the contract of the base measures.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the be to of and that have with a in is for on as was by it at from or an this he you not are "
    "le la les de des et en un une du que qui dans pour pas sur est au ce il "
    "der die das und ein eine in den von zu mit sich des auf ist im dem nicht als "
    "el la los las de y que en un una por con no para es se lo su al del"
).split()

#: measure, least, most (None: no bound). Each is a ratio of the projection's columns.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 25.0),
    ("symbols_per_word", None, 0.1),
    ("exclaims_per_word", None, 0.6),
    ("stop_word_ratio", 0.06, None),
    ("dup_line_ratio", None, 0.5),
)


def _once(column: Column) -> Column:
    """The same value, fenced: filters on what follows aren't rewritten into it, so it is computed once per row."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _spelled(stop_words) -> list[str]:
    """Each word in lower case, capitalised and in upper case."""
    return list(dict.fromkeys([*stop_words, *(w.capitalize() for w in stop_words), *(w.upper() for w in stop_words)]))


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measured(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """doc_id and the columns that the thresholds speak of."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", _once(F.array_remove(F.split("text", BLANKS), "")).alias("words"))
    n = F.size("words")
    windows = F.transform(F.arrays_zip("words", F.slice("words", 2, n), F.slice("words", 3, n)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(_without(text, SYMBOLS))).alias("n_symbols"),
        (F.length("text") - F.length(_without(text, "!"))).alias("n_exclaims"),
        _once(lines).alias("lines"),
        # arrays_zip pads to the longest array: the last two entries are no windows
        _once(F.when(n >= 3, F.slice(windows, F.lit(1), n - 2)).otherwise(F.array().cast("array<bigint>"))).alias("windows"),
        F.size(F.filter("words", lambda w: w.isin(*_spelled(stop_words)))).alias("n_stop_words"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(
        "*",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _once(F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))).alias("sorted"),
    ).drop("lines", "windows")
    twice = F.filter("sorted", lambda x, i: (x.h == F.get("sorted", i + 1).h) | (x.h == F.get("sorted", i - 1).h))
    rows = rows.select("*", _once(twice).alias("twice")).drop("sorted")
    covered = F.size(F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.when(F.col("twice").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _ratio(F.col("n_exclaims"), F.col("n_words")).alias("exclaims_per_word"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
    )


def compiled(thresholds=THRESHOLDS) -> Column:
    """The table as one boolean expression."""
    verdict = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            verdict = verdict & (F.col(name) >= least)
        if most is not None:
            verdict = verdict & (F.col(name) <= most)
    return verdict


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The base measures, base_failed, kept, and the ratios that the table judged."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(thresholds))


def op7_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in _spelled(STOP_WORDS))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'at': i, 'g': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]}})) AS x FROM w WHERE len(words) >= 3),
d AS (SELECT r, x."at" AS "at", count(*) OVER (PARTITION BY r, x.g) AS c FROM p),
v AS (SELECT r, count(DISTINCT d."at" + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(replace(text, '!', ''))) AS n_exclaims, len(lines) AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: x IN ({stop}))) AS stops FROM w LEFT JOIN v USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 25 * n_words AND n_symbols / n_words <= 0.1
  AND n_exclaims / n_words <= 0.6 AND stops / n_words >= 0.06 AND n_dup_lines <= 0.5 * n_lines AS kept FROM f
"""


SQL = _sql()
