"""Sources: signals, features, directories and their companions, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.text import strip_tags


def _read(spark: SparkSession, path: str, columns) -> DataFrame:
    """Parquet by its own types, CSV by the given schema, selected by name; a missing column fails at once."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, schema=columns, enforceSchema=False)
    missing = [f.name for f in columns if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in columns))


def read_signals(spark: SparkSession, path: str, mall: str | None = None, version: int = 3, features: DataFrame | None = None, signal_type: float | None = None) -> DataFrame:
    """Signals of a mall. Versions 1 (raw), 2 (raw, second export) and 4 (cleaned) are read as they are; version 3 keeps
    the devices of ``features``, of one ``shopper_label`` if ``signal_type`` is given."""
    if version not in (1, 2, 3, 4):
        raise ValueError(f"no version {version}")
    s = _read(spark, path, schema.SIGNALS)
    if mall:
        s = s.where(F.col("location") == mall)
    if version == 3 and features is not None:
        f = features if signal_type is None else features.where(F.col("shopper_label") == signal_type)
        s = s.join(f.select("mac_address"), "mac_address", "left_semi")
    return s


def read_features(spark: SparkSession, path: str, version: int = 1, signal_type: float | None = None) -> DataFrame:
    """The feature table, as Parquet; ``signal_type`` filters version 1 by its label."""
    if version not in (1, 2, 3, 4):
        raise ValueError(f"no version {version}")
    f = spark.read.parquet(path)
    return f.where(F.col("shopper_label") == signal_type) if version == 1 and signal_type is not None else f


def read_directory(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Version 1 has names and categories, version 2 areas and places, whose ``centroid`` CSV keeps as text."""
    if version == 1:
        return _read(spark, path, schema.SHOPS_V1)
    if version != 2:
        raise ValueError(f"no version {version}")
    if path.rstrip("/").endswith(".parquet"):
        return _read(spark, path, schema.SHOPS_V2)
    df = spark.read.csv(path, header=True)
    return df.select(*(parse_point("centroid").alias(f.name) if f.name == "centroid" else F.col(f.name).cast(f.dataType) for f in schema.SHOPS_V2))


def parse_point(c: str) -> F.Column:
    """``[x, y]`` or ``[x y]`` as a point."""
    parts = F.split(F.trim(F.regexp_replace(c, r"[\[\]()]", "")), r"[,\s]+")
    return F.struct(F.element_at(parts, 1).cast("double").alias("x"), F.element_at(parts, 2).cast("double").alias("y"))


def read_oui(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schema.OUI)


def read_communities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(mac_address, community)`` and ``(community, devices)``; the device column may be written with a space."""
    df = spark.read.csv(path, header=True) if not path.rstrip("/").endswith(".parquet") else spark.read.parquet(path)
    if "mac address" in df.columns:
        df = df.withColumnRenamed("mac address", "mac_address")
    df = df.select("mac_address", F.col("community").cast("int"))
    return df, df.groupBy("community").agg(F.sort_array(F.collect_list("mac_address")).alias("devices"))


def read_html_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of HTML files."""
    f = spark.read.text(path, wholetext=True)
    return f.select(F.col("_metadata.file_path").alias("path"), strip_tags(F.col("value")).alias("text"))


def lookup_text(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """``(store_name, text, found)``: a local table of texts in place of an online encyclopaedia."""
    j = terms.select("store_name").join(texts.select("store_name", "text"), "store_name", "left")
    return j.withColumn("found", F.col("text").isNotNull())


def read_markov(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The chain ``(src, dst, p)`` and its start ``(store_id, p)``, as :func:`..sinks.write_markov` writes them."""
    return spark.read.parquet(f"{path}/transitions"), spark.read.parquet(f"{path}/initial")
