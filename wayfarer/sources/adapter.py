"""The engine's relations over the given tables: device signals from ``events``, an OUI table from ``nation``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as signals: users are devices, event types and a number in ``props`` give stores and places."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.selectExpr(
        "event_id",
        r"regexp_replace(format_string('%06x%06x', user_id % 25, user_id), '(..)(..)(..)(..)(..)(..)', '$1:$2:$3:$4:$5:$6') mac_address",
        "ts date_time",
        "element_at(array('Mall of Mauritius', 'Phoenix Mall', 'Home & Leisure'), cast(user_id % 3 + 1 as int)) location",
        """case event_type when 'signup' then concat('A', 101 + k % 5) when 'view' then concat('B', 101 + k % 7)
           when 'click' then concat('B', 108 + k % 7) when 'purchase' then concat('B', 115 + k % 7) end store_id""",
        "value x",
        "cast(k as double) y",
        "element_at(array('wifiuser', 'lawifiuser', 'Discovered-AP', 'fatti Bot ', 'unknown'), k % 5 + 1) wifi_type",
        "cast(null as string) email",
    )


def coarse_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with times cut to six hours, so that a device has several at once."""
    s = signals(spark, sf_dir)
    hour = F.date_trunc("day", "date_time") + F.floor(F.hour("date_time") / 6) * F.expr("interval '6' hour")
    return s.withColumn("date_time", hour.cast("timestamp_ntz"))


def oui(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.upper(F.format_string("%06x", "n_nationkey")).alias("Assignment"), F.col("n_name").alias("Organization Name")
    )
