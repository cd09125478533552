"""Shared pieces: table access, durable intermediate tables, exact word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerline.operators.durable import shared_dir, stored

__all__ = ["BATCH_ROWS", "WORD", "in_small_batches", "integer_id", "n_words", "shared_dir", "stored", "table"]

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as long. Any other type is refused: a cast would turn ids into nulls without a word."""
    if not isinstance(df.schema[name].dataType, IntegralType):
        raise TypeError(f"{name} must be of an integer type, not {df.schema[name].dataType.simpleString()}")
    return F.col(name).cast("long")


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of an Arrow batch of texts, at most. The default of 10,000 has no bound in bytes that matters here.
BATCH_ROWS = 500


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; lowers the session's Arrow batch size if it is larger, so that Python workers hold few texts at once."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return df
