"""Hashes that identify inputs, and canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def input_hash(*parts: Column) -> Column:
    """16 hex characters over the parts in order; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def similarity_input_hash(prompt: Column) -> Column:
    """Of the input only: the model is deliberately not part of it."""
    return input_hash(prompt)


def biomedical_input_hash(prompt: Column, model: Column, sampler: Column) -> Column:
    return input_hash(prompt, model, sampler)


def choice_input_hash(prompt: Column, golden: Column, model: Column, workflow: Column) -> Column:
    return input_hash(prompt, golden, model, workflow)


def hash_number(text: Column) -> Column:
    """The first 15 hex digits of SHA-256 as a number that fits 63 bits."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def cache_key(dataset: str, config: str, split: str, revision: str | None = None) -> str:
    """Name of a dataset's folder in the batch cache: 64 hex characters."""
    return hashlib.sha256(":".join(["v2", dataset, config, split, *([revision] if revision else [])]).encode()).hexdigest()


def _without_nulls(value):
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return [_without_nulls(v) for v in value] if isinstance(value, list) else value


def canonical(value, drop_nulls: bool = True, ascii_only: bool = True) -> str:
    """Sorted keys, no blanks; keys with null are dropped (nulls in lists stay) unless told otherwise."""
    return json.dumps(_without_nulls(value) if drop_nulls else value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def canonical_json(text: Column, drop_nulls: bool = True, ascii_only: bool = True) -> Column:
    """Canonical form of JSON text, null if it doesn't parse. Arrow batches: to_json alters numbers such as 1.0."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else canonical(json.loads(t), drop_nulls, ascii_only)
            except ValueError:
                return None

        return texts.map(one)

    return run(text)


def canonical_hash(text: Column, drop_nulls: bool = True, ascii_only: bool = True) -> Column:
    return F.sha2(canonical_json(text, drop_nulls, ascii_only), 256)


def row_key(i: Column) -> Column:
    return F.concat(F.lit("row-"), i.cast("string"))


def eval_key(sample_id: Column) -> Column:
    return F.concat(F.lit("eval-"), sample_id.cast("string"))


#: Step keys of the SDK's dataset reads.
DATASET_INIT = "dataset-init"


def batch_key(offset: Column) -> Column:
    return F.concat(F.lit("dataset-batch-"), offset.cast("string"))
