"""Signals as a stream: distinct devices over sliding windows, visits as sessions, and the last known store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def approximate_window_counts(signals: DataFrame, window: str = "60 minutes", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(window, store_id, devices)``; devices are counted approximately, so state per window is bounded."""
    s = signals.withColumn("ts", F.col("date_time").cast("timestamp")).withWatermark("ts", late).where("store_id is not null")
    return s.groupBy(F.window("ts", window, slide), "store_id").agg(F.approx_count_distinct("mac_address").alias("devices"))


def visits(signals: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """``(visit, mac_address, store_id, signals)``: runs of a device's signals in a store without a longer gap."""
    s = signals.withColumn("ts", F.col("date_time").cast("timestamp")).withWatermark("ts", late).where("store_id is not null")
    return s.groupBy(F.session_window("ts", gap).alias("visit"), "mac_address", "store_id").agg(F.count("*").alias("signals"))


def moves(signals: DataFrame) -> DataFrame:
    """``(mac_address, src, dst, date_time)``: continuous counting, a row whenever a device is seen in another store.

    The state of a device is its last store and time; signals that come late count from where the device is known to be.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for b in batches:
            for r in b.sort_values("date_time").itertuples(index=False):
                if last is not None and r.store_id != last:
                    rows.append((key[0], last, r.store_id, r.date_time))
                last = r.store_id
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["mac_address", "src", "dst", "date_time"])

    s = signals.where("store_id is not null").select("mac_address", "store_id", "date_time")
    return s.groupBy("mac_address").applyInPandasWithState(
        step, "mac_address string, src string, dst string, date_time timestamp_ntz", "store string", "append", GroupStateTimeout.NoTimeout
    )
