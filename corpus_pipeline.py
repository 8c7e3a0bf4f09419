"""The corpus pipeline: five stages, each over all rows that the one before it kept.

1. language_id      rows whose language model rejects them, or that have no letter, go
2. exact_dedup      of equal texts (A-Z folded) the row with the largest doc_id stays
3. near_dedup       of each class of the n-gram Jaccard join one document stays
4. repeat_removal   byte windows of 200 that occur elsewhere are cut out; every document stays
5. packing          documents become pieces of sequences

Every stage but the last returns the columns of its input. A stage's rows are whole rows of its input; only
repeat_removal changes a value (text, and n_chars with it). Null texts, nulls in other columns, repeated
rows and empty tables are dealt with by the operators; of repeated rows stages 2 and 3 keep one.

Stages 2 to 4 write what they decide (row keys, or the cut rows) and delete their other working files before
they return; what is left of a stage goes with run(), or else when the driver's Python ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import exact_dedup as equal
from gaugeworks.llm import lang_id, packing, repeats, shingle_join
from gaugeworks.llm.common import Work, documents, fold, keep_rows, materialise, settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.identifier(docs.filter(fold(3) != 1))
    return lang_id.identified(docs, model).filter("not _gw_rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, settled(lambda: equal.exact_dedup(docs).filter("kept").select("_k"), "kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, settled(lambda: shingle_join.shingle_join(docs).filter("keeper").select("_k"), "keepers"))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = settled(lambda: repeats.remove_repeats(docs).select(*[F.col(f"`{c}`") for c in docs.columns]), "cut")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("packing", packed),
]

#: Language models and packing can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), Work()
    for name, stage in STAGES[:-1]:
        with Work() as working:
            made = stage(spark, docs, sf_dir)
        with Work() as result:
            docs = materialise(made, f"pipeline-{name}")
        working.drop(spark)
        before.drop(spark)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
