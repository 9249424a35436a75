"""Helpers shared by the training-data operators.

Every operator here selects the columns it was given by name before it does anything else, so further columns of the
input, whatever they are called, neither reach Python nor clash with the columns that an operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.plans.session import forget, shared_folder, spool

__all__ = ["forget", "hash_sample", "id_bucket", "read_table", "shared_folder", "spool"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the stable split into folds. A null id is in no fold (null)."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df``, at most twice as many, spread evenly over a hash of ``keys``.

    All rows if there are no more than that. Which rows are taken depends on the keys alone, not on the partitions.
    """
    step = max(1, df.count() // rows)
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0).limit(2 * rows)
