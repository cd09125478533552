"""Bounded samples of labelled rows, and the split that no model learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored

#: Labelled rows that a model is fitted on, at most.
MAX_LABELLED = 20_000


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, y, fold) of at most ``limit`` labelled documents that ``learn`` allows, picked by a hash of the id.

    fold: 0 to 3. An id with several labels has the largest. The broadcast side has ``limit`` rows at most.
    """
    ids = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return stored(got.select(F.coalesce("text", F.lit("")).alias("text"), "y", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).cast("int").alias("fold")))
