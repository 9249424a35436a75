"""Kernel densities by expansions against sums over all training values, and what is built on them."""

import math
import random

import numpy as np
import pytest

from wayfarer.operators import bayes, statistics

SCHEMA = "mac_address string, frequency int, v double, w double, dbscan_label string, is_out_of_hours int"


def exact(x: float, values: np.ndarray) -> float:
    h = values.std(ddof=1) * len(values) ** -0.2
    return float(np.exp(-(((x - values) / h) ** 2) / 2).sum() / len(values) / h / math.sqrt(2 * math.pi))


def table(spark, n: int, seed: int = 1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.randrange(4)
        v = rng.lognormvariate(c, 1) if i % 7 else 3.0
        rows.append((f"d{i}", 11, v, rng.gauss(-5e6 * c, 1e5), (*bayes.CLASSES, bayes.UNKNOWN)[c], rng.randint(0, 1)))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_same_as_all_values_on_6000_devices(spark):
    rows, df = table(spark, 6_000)
    far = [("far", 3, 1e4, 3e6, bayes.UNKNOWN, 0), ("null", 3, None, float("nan"), bayes.UNKNOWN, 0), ("infinite", 30, math.inf, -math.inf, "Shopper", 0)]
    df = df.union(spark.createDataFrame(far, SCHEMA)).repartition(5)
    out = {r["mac_address"]: r for r in bayes.likelihoods(df, bayes.training(df, ["v", "w"]), ["v", "w"]).collect()}
    assert len(out) == 6_003
    for j, f in ((2, "v"), (3, "w")):
        for k, name in enumerate(bayes.CLASSES):
            values = np.array([r[j] for r in rows if r[4] == name])
            for r in [*rows[::29], far[0]]:
                assert out[r[0]][f"l_{f}_{k}"] == pytest.approx(exact(r[j], values), rel=1e-9, abs=1e-300)
            assert out["null"][f"l_{f}_{k}"] is None and out["infinite"][f"l_{f}_{k}"] is None


def test_far_values_keep_their_ratio(spark):
    """A place 30 bandwidths from everything still has the tiny densities that the sums give, so posteriors are defined."""
    rng = random.Random(2)
    rows = [(f"d{i}", 11, rng.gauss(0, 1), 0.0, bayes.CLASSES[i % 2], 0) for i in range(400)]
    a, b = (np.array([r[2] for r in rows if r[4] == c]) for c in bayes.CLASSES[:2])
    x = float(max(a.max(), b.max()) + 30 * a.std(ddof=1) * len(a) ** -0.2)
    df = spark.createDataFrame([*rows, ("q", 11, x, 0.0, bayes.UNKNOWN, 0)], SCHEMA)
    got = bayes.likelihoods(df, bayes.training(df, ["v"]), ["v"]).where("mac_address = 'q'").first()
    assert 0 < exact(x, a) < 1e-150
    assert got["l_v_0"] == pytest.approx(exact(x, a), rel=1e-6) and got["l_v_1"] == pytest.approx(exact(x, b), rel=1e-6)
    assert got["l_v_2"] is None


def test_classes_without_spread_have_no_density(spark):
    rows = [("a", 11, 1.0, 0.0, "Shopper", 0), ("b", 11, 1.0, 0.0, "Shopper", 0), ("c", 11, 2.0, 0.0, "Stationary", 0), ("d", 5, 9.0, 0.0, "Stationary", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = bayes.likelihoods(df, bayes.training(df, ["v"]), ["v"]).collect()
    assert len(out) == 4 and all(r[f"l_v_{k}"] is None for r in out for k in range(3))
    assert bayes.training(df.limit(0), ["v"]).count() == 0


def test_recursion_goes_to_its_end(spark):
    """Each round finds what the round before made likely; the rounds are more than four."""
    rng = random.Random(7)
    rows = [(f"s{i}", 20, 0.1 * i + rng.gauss(0, 0.05), 0.0, "x", 1) for i in range(60)] + [(f"m{i}", 20, 6.0 + 0.1 * i + rng.gauss(0, 0.5), 0.0, "x", int(i < 12)) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["mac_address"]: r["round"] for r in bayes.recursive(df, ["v"], (0.5, 0.5), 0.55).collect()}
    rest, turn, want = {r[0]: r for r in rows}, 0, {}
    while True:
        one, two = (np.array([r[2] for r in rest.values() if r[5] == k]) for k in (1, 0))
        p = {m: 0.5 * exact(r[2], one) / (0.5 * exact(r[2], one) + 0.5 * exact(r[2], two)) for m, r in rest.items()}
        hit = {m for m, q in p.items() if q > 0.55}
        want |= dict.fromkeys(hit, turn)
        rest = {m: r for m, r in rest.items() if m not in hit}
        turn += 1
        if not hit or sum(r[5] for r in rest.values()) <= 1:
            break
    assert found == want and len(set(want.values())) >= 2
    with pytest.raises(RuntimeError):
        bayes.recursive(df, ["v"], (0.5, 0.5), 0.55, most=1)


def test_running_sums_of_densities_are_compared(spark):
    rows, df = table(spark, 300, 4)
    got = {r["feature"]: r["d"] for r in bayes.cumulative_ks(df, ["v", "w"]).collect()}
    for j, f in ((2, "v"), (3, "w")):
        grid = np.arange(100) * max(r[j] for r in rows) / 99
        a, b = (np.cumsum([exact(x, np.array([r[j] for r in rows if r[4] == c])) for x in grid]) for c in bayes.CLASSES[:2])
        every = np.concatenate((a, b))
        want = max(abs((a <= v * (1 + 1e-12)).mean() - (b <= v * (1 + 1e-12)).mean()) for v in every)
        assert got[f] == pytest.approx(want, abs=0.011)


def test_curve_and_bars(spark):
    rows, df = table(spark, 500, 5)
    out = bayes.density_check(df, "v", "Shopper").collect()
    bars = [r for r in out if r["part"] == "histogram"]
    curve = sorted((r for r in out if r["part"] == "kernel"), key=lambda r: r["place"])
    values = np.array([r[2] for r in rows if r[4] == "Shopper"])
    high, edges = np.histogram(values, 25, density=True)
    want = {i: (edges[i], h) for i, h in enumerate(high) if h > 0}
    assert {r["place"]: (r["x"], r["density"]) for r in bars} == {i: pytest.approx(w) for i, w in want.items()}
    assert len(curve) == 1_000 and curve[-1]["x"] == pytest.approx(1.2 * values.max())
    assert [r["density"] for r in curve[::50]] == pytest.approx([exact(r["x"], values) for r in curve[::50]], rel=1e-9)
    assert statistics.histogram(df.limit(0), "v", 5).count() == 0


def test_a_bootstrap_reads_its_devices_once(spark):
    from wayfarer.operators import bayes

    rows = [(f"d{i}", 11, float(i % 7), float(i % 5), "Shopper", i % 2) for i in range(40)]
    out = bayes.bootstrap(spark.createDataFrame(rows, SCHEMA), ["v"], 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and 0 < out.count() < 40


def test_values_are_summed_up_before_they_are_spread(spark, monkeypatch):
    """Parts of cells are spread, not values, so what training spreads doesn't grow with the devices."""
    kept, real = [], bayes.spool

    def spool(df):
        out = real(df)
        kept.append((df._jdf.queryExecution().optimizedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(bayes, "spool", spool)
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(3_000)]
    rows = [(f"d{i}", 11, v, 0.0, "Shopper", 0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["mac_address"]: r["l_v_1"] for r in bayes.likelihoods(df, bayes.training(df, ["v"]), ["v"]).collect()}
    assert all(out[r[0]] == pytest.approx(exact(r[2], np.array(values)), rel=1e-10) for r in rows[::50])
    assert kept and not any("sequence(" in plan for plan, _ in kept) and max(n for _, n in kept) < len(rows)


def test_spread_sums_equal_the_sums_over_values(monkeypatch):
    """Coefficients from the sums of parts, many chunks of them, are those from the values; negative cells too."""
    import pandas as pd

    monkeypatch.setattr(bayes, "CHUNK", 7)
    rng, fine = np.random.default_rng(4), bayes.FINE * bayes.PARTS
    u = np.concatenate((rng.normal(0, 30, 300), rng.normal(-4000, 3, 50)))
    part = np.floor(u).astype(np.int64)
    e = (u - part - 0.5) / fine
    m = pd.DataFrame({f"m{i}": e**i * np.exp(-e * e / 2) / math.factorial(i) for i in range(bayes.MOMENTS)})
    m = m.groupby(part).sum().rename_axis("part").reset_index()
    for i, (name, value) in enumerate((("feature", "v"), ("k", 0), ("h", 0.5), ("n", 350))):
        m.insert(i, name, value)
    got = pd.concat(bayes._spread(iter([m, m.iloc[:0]]))).groupby("cell").sum(numeric_only=True)
    for cell in (-1140, -1000, -900, -140, -20, 0, 3, 60, 150):
        at, s = (cell + 0.5) / bayes.FINE, 0.1
        near = u[np.abs(np.floor(u / bayes.PARTS) - cell) <= int(bayes.REACH * bayes.FINE)] / fine
        want = np.exp(-((s + at - near) ** 2) / 2).sum()
        found = sum(got.loc[cell, f"t{j}"] * s**j for j in range(bayes.TERMS)) * math.exp(-s * s / 2)
        assert len(near) and found == pytest.approx(want, rel=1e-9)
