"""Simulated shoppers: a network of stores walked by independent agents, and a grid walked by agents in each other's way."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.session import spool
from .ordering import numbered

SIGNAL_SCHEMA = "mac_address string, date_time timestamp_ntz, store_id string, x double, y double"


#: Agents whose signals a worker holds at once, and agents that a task walks.
AGENTS, AGENTS_IN_TASK = 64, 256


def stay_model(signals: DataFrame) -> DataFrame:
    """``(at, arrival, stay)``: arrival second of the day and length of stay of every device, numbered from 0, to draw from."""
    from .features import length_of_stay

    start = signals.groupBy("mac_address").agg(F.min("date_time").alias("t"))
    rows = start.join(length_of_stay(signals), "mac_address").where("t is not null")
    rows = rows.select("mac_address", S.second_of_day("t").alias("arrival"), F.col("length_of_stay").cast("double").alias("stay"))
    return spool(numbered(rows, [F.xxhash64("mac_address"), "mac_address"], "at").select("at", "arrival", "stay"))


def some_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, a few at a time: an agent has many signals, and a batch of agents would be held with all of theirs."""
    for batch in batches:
        for i in range(0, len(batch), AGENTS):
            yield batch.iloc[i : i + AGENTS]


def some_agents(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The ids of :func:`some_rows`."""
    for rows in some_rows(batches):
        yield rows["id"].to_numpy()


def _drawn(stays: DataFrame, n: int, shoppers: int, seed: int) -> DataFrame:
    """``(id, arrival, stay)``: for each agent those of two of the ``n`` devices, drawn by the agent's own generator."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = [_draw(np.random.default_rng([seed, int(agent)]), n) for agent in batch["id"]]
            yield pd.DataFrame({"id": batch["id"], "a": [d[0] for d in drawn], "s": [d[2] for d in drawn]})

    agents = stays.sparkSession.range(shoppers).mapInPandas(draw, "id long, a long, s long")
    agents = agents.join(stays.select(F.col("at").alias("a"), "arrival").hint("merge"), "a").join(stays.select(F.col("at").alias("s"), "stay").hint("merge"), "s")
    return agents.select("id", "arrival", "stay").repartition(max(1, -(-shoppers // AGENTS_IN_TASK)), "id")


def _draw(rng: np.random.Generator, n: int) -> tuple[int, float, int, float]:
    """An agent's first draws: a device and how far from its arrival, a device and how far from its stay."""
    return int(rng.integers(n)), rng.standard_normal(), int(rng.integers(n)), rng.standard_normal()


def simulate_network(
    transitions: DataFrame, initial: DataFrame, stores: DataFrame, stays: DataFrame, shoppers: int, minutes: int = 930, leave: float = 0.05, noise: float = 0.0, seed: int = 0
) -> DataFrame:
    """Signals of agents that arrive, stay in shops, and move on by the chain's rows until their time is over.

    Arrivals and stays are drawn from kernel densities over all devices of ``stays`` ``(at, arrival, stay)``, see
    :func:`stay_model`: an agent meets the devices that it draws in a join. Without devices there are no signals. Agents don't see each other, so each is walked by
    itself with a generator of its own, seeded by its number: the same on any number of tasks. The chain and the stores
    are dimension tables of some hundred rows.
    """
    where = {r["store_id"]: (r["x"], r["y"]) for r in stores.collect()}
    chain: dict[str, tuple[list[str], np.ndarray]] = {}
    for r in sorted(transitions.where("src <> dst").collect(), key=lambda r: (r["src"], r["dst"])):
        if r["src"] in where and r["dst"] in where:
            names, p = chain.setdefault(r["src"], ([], []))
            names.append(r["dst"])
            p.append(r["p"])
    chain = {k: (n, np.array(p) / sum(p)) for k, (n, p) in chain.items()}
    first = sorted((r["store_id"], r["p"]) for r in initial.collect() if r["store_id"] in where and r["p"])
    begin, weight = [s for s, _ in first], np.array([p for _, p in first])
    weight = weight / weight.sum()
    spark = transitions.sparkSession
    n, *spread = stays.agg(F.count("*"), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)) for c in ("arrival", "stay"))).first()
    if not n:
        return spark.createDataFrame([], SIGNAL_SCHEMA)
    ha, hs = (x * n**-0.2 for x in spread)
    opening = 8.5 * 3600

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in some_rows(batches):
            rows = []
            for agent, arrival, stay in zip(some["id"], some["arrival"], some["stay"], strict=True):
                rng = np.random.default_rng([seed, int(agent)])
                _, later, _, longer = _draw(rng, n)
                t, most = arrival + ha * later, stay + hs * longer
                step = max(0, int(math.ceil((t - opening) / 60)))
                here, left = begin[rng.choice(len(begin), p=weight)], max(60.0, most)
                while step < minutes and left > 0:
                    x, y = where[here]
                    rows.append((f"{agent:012x}", step, here, x + noise * rng.standard_normal(), y + noise * rng.standard_normal()))
                    if rng.random() < leave and here in chain:
                        names, p = chain[here]
                        here = names[rng.choice(len(names), p=p)]
                    step, left = step + 1, left - 60
            out = pd.DataFrame(rows, columns=["mac_address", "step", "store_id", "x", "y"])
            out["date_time"] = pd.Timestamp("2016-12-22 08:30") + pd.to_timedelta(out["step"] * 60, unit="s")
            yield out[["mac_address", "date_time", "store_id", "x", "y"]]

    return _drawn(stays, n, shoppers, seed).mapInPandas(walk, SIGNAL_SCHEMA)


def simulated_devices(signals: DataFrame) -> DataFrame:
    """``(mac_address, number_of_shops, length_of_stay, start_time)`` of simulated signals."""
    n = F.count_distinct("store_id").alias("number_of_shops")
    return signals.groupBy("mac_address").agg(n, (F.count("*") * 60.0).alias("length_of_stay"), F.min("date_time").alias("start_time"))


def simulate_angles(stores: DataFrame, shoppers: int, steps: int = 60, bias: float = 0.95, seed: int = 0) -> DataFrame:
    """Signals of agents that go to a random store, mostly onwards in their own direction about the mall's centre."""
    s = stores.select("store_id", "x", "y", S.centre_angle("x", "y").alias("angle")).orderBy("store_id").collect()
    names, xy, angle = [r["store_id"] for r in s], [(r["x"], r["y"]) for r in s], np.array([r["angle"] for r in s])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in some_agents(batches):
            rows = []
            for agent in ids:
                rng = np.random.default_rng([seed, int(agent)])
                way, here = rng.choice([-1, 1]), int(rng.integers(len(names)))
                for step in range(steps):
                    on = np.mod(way * (angle - angle[here]), 2 * np.pi)
                    good = np.flatnonzero((on > 0) & (on < 2 * np.pi / 3))
                    free = good if len(good) and rng.random() < bias else np.arange(len(names))
                    here = int(rng.choice(free))
                    rows.append((f"{agent:012x}", step, names[here], *xy[here]))
            out = pd.DataFrame(rows, columns=["mac_address", "step", "store_id", "x", "y"])
            out["date_time"] = pd.Timestamp("2016-12-22 09:00") + pd.to_timedelta(out["step"] * 60, unit="s")
            yield out[["mac_address", "date_time", "store_id", "x", "y"]]

    return stores.sparkSession.range(shoppers).mapInPandas(walk, SIGNAL_SCHEMA)


def walls(corners: DataFrame) -> DataFrame:
    """``(name, x, y)``: the grid points on the sides of polygons ``(name, corner_no, x, y)``."""
    c = corners.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("corner_no", "x", "y"))).alias("c"))
    side = c.select("name", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("i"), "c")
    a, b = F.element_at("c", F.col("i")), F.element_at("c", F.col("i") % F.size("c") + 1)
    s = side.select("name", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")), F.lit(1))
    p = s.withColumn("n", n.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda v: F.rint(F.col(f"{v}1") + (F.col(f"{v}2") - F.col(f"{v}1")) * F.col("k") / F.col("n")).cast("int")
    return p.select("name", at("x").alias("x"), at("y").alias("y")).distinct()


def simulate_grid(spark: SparkSession, blocked: DataFrame, runs: int = 1, shoppers: int = 50, iterations: int = 50, width: int = 400, height: int = 250, seed: int = 0) -> DataFrame:
    """``(run, mac_address, date_time, store_id, x, y)``: king's moves on a grid with walls and each other in the way.

    Agents of a run depend on each other, so a run is one task; runs go side by side.
    """
    taken = [(r["x"], r["y"]) for r in blocked.select("x", "y").distinct().collect()]

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        full = np.zeros((width, height), bool)
        for x, y in taken:
            if 0 <= x < width and 0 <= y < height:
                full[x, y] = True
        at: list[list[int]] = []
        rows = []
        for i in range(iterations):
            if len(at) < shoppers and rng.random() < 1 / (i // 10 + 1):
                x, y = int(rng.integers(55, 301)), int(rng.integers(0, 101))
                if not full[x, y]:
                    full[x, y] = True
                    at.append([x, y])
            for k, (x, y) in enumerate(at):
                for dx, dy in rng.integers(-1, 2, (200, 2)):
                    nx, ny = x + int(dx), y + int(dy)
                    if 0 <= nx < width and 0 <= ny < height and not full[nx, ny]:
                        full[x, y], full[nx, ny] = False, True
                        x, y = nx, ny
                at[k] = [x, y]
                rows.append((int(key[0]), f"{k:012x}", pd.Timestamp("2016-12-22 09:00") + pd.Timedelta(minutes=i), None, float(x), float(y)))
        return pd.DataFrame(rows, columns=["run", "mac_address", "date_time", "store_id", "x", "y"])

    return spark.range(runs).select(F.col("id").alias("run")).groupBy("run").applyInPandas(one, f"run long, {SIGNAL_SCHEMA}")


def compare(real: DataFrame, simulated: DataFrame, minutes: int = 15) -> DataFrame:
    """``(source, bin, devices)`` of both signal tables."""
    from .flows import per_bin

    side = lambda s, name: per_bin(s, minutes).select(F.lit(name).alias("source"), "bin", "devices")
    return side(real, "real").union(side(simulated, "simulated"))
