"""Distributed ranks, planar counts and two-sample tests against their plainest forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import dominance, flows, ordering, statistics


def test_running_sums_over_stretches(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if i % 3 else "a", i, rng.randint(0, 5)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, v long, n long").repartition(5)
    got = {(r["g"], r["v"]): r["s"] for r in ordering.running(df, [F.col("v").desc()], {"s": "n"}, ["g"]).collect()}
    for g in "ab":
        total = 0
        for _, v, n in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]):
            total += n
            assert got[g, v] == total
    assert [r["k"] for r in ordering.numbered(df, ["v"], "k").orderBy("v").collect()] == list(range(2_000))
    assert ordering.numbered(df.limit(0), ["v"], "k").count() == 0


def brute_below(points):
    return {p: tuple(sum(w[i] for q, w in points.items() if q[0] == p[0] and q[1] <= p[1] and q[2] <= p[2]) for i in (0, 1)) for p in points}


@pytest.mark.parametrize("least", [3, 4_096])
def test_points_below_and_left(spark, monkeypatch, least):
    monkeypatch.setattr(dominance, "LEAST", least)
    rng = random.Random(least)
    # A third of the points stand on one line, and many coordinates repeat.
    draw = lambda: (rng.choice("aab"), 1.0 if rng.random() < 0.35 else float(rng.randint(-6, 6)), rng.choice([2.0, float(rng.randint(0, 40))]))
    points = {draw(): (rng.randint(0, 3), rng.randint(0, 3)) for _ in range(400)}
    df = spark.createDataFrame([(*p, *w) for p, w in points.items()], "g string, x double, y double, a long, b long")
    got = {(r["g"], r["x"], r["y"]): (r["below_a"], r["below_b"]) for r in dominance.below_left(df, "x", "y", ["a", "b"], ["g"]).collect()}
    assert got == brute_below(points)


def brute_ks(one, two):
    def side(own, other):
        best = 0.0
        for x, y in own:
            share = lambda pts, less: np.array([sum(p[0] > x and p[1] > y for p in pts), sum(p[0] <= x and p[1] > y for p in pts), sum(p[0] > x and p[1] <= y for p in pts), sum(p[0] <= x and p[1] <= y for p in pts) - less]) / len(pts)  # noqa: E731, B023
            mine, theirs = share(own, 1), share(other, 0)
            best = max(best, (mine + 1 / len(own) - theirs).max(), (theirs - mine).max())
        return best

    return (side(one, two) + side(two, one)) / 2


def test_planar_test_by_group(spark, monkeypatch):
    monkeypatch.setattr(dominance, "LEAST", 7)
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), float(rng.randint(0, 9)), rng.gauss(0, 1) if rng.random() < 0.5 else 0.0, rng.randint(0, 1)) for _ in range(160)]
    rows += [("b", float("nan"), 1.0, 0), ("b", None, 1.0, 1), ("only", 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, g int")
    got = {r["k"]: r["d"] for r in statistics.ks_2d(df, "x", "y", "g", ["k"]).collect()}
    pts = lambda k, g: [(x, y) for a, x, y, s in rows if a == k and s == g and x is not None and x == x]
    assert got == pytest.approx({"a": brute_ks(pts("a", 0), pts("a", 1)), "b": brute_ks(pts("b", 0), pts("b", 1)), "only": None})
    assert statistics.ks_2d(df.limit(0), "x", "y", "g").first()["d"] is None
    whole = statistics.ks_2d(df.where("k <> 'only'"), "x", "y", "g").first()
    assert whole["d"] == pytest.approx(brute_ks(pts("a", 0) + pts("b", 0), pts("a", 1) + pts("b", 1))) and 0 <= whole["p"] <= 1


def test_line_test_bears_one_sided_and_empty_groups(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (None, 1), (float("nan"), 1)], "v double, g int")
    assert statistics.ks_1d(df, "v", "g").first()["d"] is None and statistics.ks_1d(df.limit(0), "v", "g").first()["d"] is None
    both = spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "v double, g int")
    assert statistics.ks_1d(both, "v", "g").first()["d"] == 1.0


def brute_energy(x, y):
    mean = lambda a, b: sum(math.log(d) for p in a for q in b if (d := math.dist(p, q)) > 0) / (len(a) * len(b))
    return mean(x, y) - mean(x, x) / 2 - mean(y, y) / 2


def test_energies_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.gauss(3 * g, 1), rng.gauss(0, 2), g) for g in (0, 1) for _ in range(40)] + [(0.5, 0.5, 0)] * 3 + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "u double, v double, g int")
    whole = [r["e"] for r in statistics.energies(df, ["u", "v"], "g", 12).orderBy("round").collect()]
    monkeypatch.setattr(statistics, "BLOCK", 9)
    parts = [r["e"] for r in statistics.energies(df.repartition(7), ["u", "v"], "g", 12).orderBy("round").collect()]
    assert len(whole) == 13 and parts == pytest.approx(whole)
    x = np.array([r[:2] for r in rows if r[0] is not None])
    z = (x - x.mean(0)) / x.std(0)
    g = np.array([r[2] for r in rows if r[0] is not None])
    assert whole[0] == pytest.approx(brute_energy(z[g == 0], z[g == 1])) and whole[0] > max(whole[1:])
    test = statistics.energy_test(df, ["u", "v"], "g", 12).first()
    assert test["statistic"] == pytest.approx(whole[0]) and test["p"] == 0.0 and 0 <= test["p_fit"] < 0.1
    # Relabellings have the mean that random labels have.
    assert abs(np.mean(whole[1:])) < 0.2 * whole[0]


@pytest.mark.parametrize("shape", [-0.2, 0.0, 0.25])
def test_extreme_values_are_fitted(shape):
    u = (np.arange(4_000) + 0.5) / 4_000
    x = 3 + 2 * (-np.log(-np.log(u)) if shape == 0 else ((-np.log(u)) ** -shape - 1) / shape)
    got = statistics.extreme_value_fit(x)
    assert got == pytest.approx((shape, 3, 2), abs=0.03)
    assert statistics.extreme_value_above(float(np.quantile(x, 0.9)), *got) == pytest.approx(0.1, abs=0.01)
    best = statistics._extreme_loss(np.array([got[0], got[1], math.log(got[2])]), x)
    for move in np.vstack([np.eye(3), -np.eye(3)]) * 0.01:
        assert best <= statistics._extreme_loss(np.array([got[0], got[1], math.log(got[2])]) + move, x)
    assert statistics.extreme_value_fit(np.ones(5)) is None


def test_ranks_of_tied_degrees(spark):
    df = spark.createDataFrame([(f"B{i}", i // 3) for i in range(12)], "store_id string, frequency long")
    rows = sorted(flows.degree_rank(df).collect(), key=lambda r: r["rank"])
    assert [(r["frequency"], r["store_id"]) for r in rows] == sorted(((i // 3, f"B{i}") for i in range(12)), key=lambda t: (-t[0], t[1]))
    assert {r["frequency"]: r["rank"] for r in flows.rank_probability(df).collect()} == {3: 1.0, 2: 2.0, 1: 3.0, 0: 4.0}


def test_words_with_odd_characters_go(spark):
    from wayfarer.operators import text

    df = spark.createDataFrame([("a b_c  dé e+f\tg©h ok- x¦ ¾ fine",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_words(F.col("t"))).collect()] == ["a ok- fine", "", None]


def test_sets_of_manufacturers_and_a_class(spark):
    from wayfarer.operators import analysis

    rows = [("a", "X", "S"), ("b", "X", "T"), ("c", "Y", "S"), ("d", "Z", "S"), ("e", None, "S"), ("f", "Z", "T")]
    df = spark.createDataFrame(rows, "mac_address string, manufacturer string, dbscan_label string")
    assert {tuple(r) for r in analysis.manufacturers_and_class(df, ["X", "Y"], "S").collect()} == {(5, 1), (1, 1), (6, 1), (4, 2)}


def test_significance_curve(spark):
    from wayfarer.operators import analysis

    rows = analysis.significance_curve(spark, 0.5, 2.0, 3.0).collect()
    part = lambda p: sorted((r["x"], r["y"]) for r in rows if r["part"] == p)
    assert [len(part(p)) for p in ("curve", "tail", "level")] == [200, 50, 1] and part("tail")[0] == part("level")[0]
    assert [x for x, _ in part("curve")] == pytest.approx(list(np.linspace(-5, 5, 200))) and part("tail")[-1][0] == pytest.approx(5.0)
    assert all(y == pytest.approx(math.exp(-((x - 0.5) ** 2) / 8)) for r in rows for x, y in [(r["x"], r["y"])])
    df = spark.createDataFrame([(0.2,), (0.96,), (0.97,), (1.0,)], "p double")
    assert sum(r["n"] for r in analysis.confident_posteriors(df, "p").collect()) == 3


@pytest.mark.parametrize("crowd", [2, 64])
def test_kth_neighbours_of_uneven_stores(spark, monkeypatch, crowd):
    from wayfarer.operators import cleaning

    monkeypatch.setattr(cleaning, "CROWD", crowd)
    rng = random.Random(crowd)
    rows = [("a", i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [("a", 300 + i, rng.gauss(50, 0.001), rng.gauss(0, 0.001)) for i in range(200)]
    rows += [("a", 500 + i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(20)] + [("b", 600 + i, 1.0, 2.0) for i in range(7)] + [("c", 700 + i, float(i), 0.0) for i in range(4)]
    rows += [("d", 800 + i, float(i % 3), 0.0) for i in range(9)] + [(None, 900, 0.0, 0.0), ("a", 901, None, 0.0)]
    df = spark.createDataFrame(rows, "store_id string, point_id long, x double, y double").repartition(3)
    got = {r["point_id"]: r["distance"] for r in cleaning.kth_neighbour(df, 5).collect()}
    want = {}
    for s in "abd":
        mine = [(i, x, y) for k, i, x, y in rows if k == s and x is not None]
        for i, x, y in mine:
            want[i] = sorted(math.hypot(x - p, y - q) for _, p, q in mine)[4]
    assert got == pytest.approx(want)
    assert cleaning.kth_neighbour(df.limit(0)).count() == 0


def test_clusters_of_long_vectors(spark):
    from wayfarer.operators import clusters

    rng = np.random.default_rng(6)
    centres = rng.normal(0, 4, (4, 12))
    x = np.vstack([centres[rng.integers(0, 4, 150)] + rng.normal(0, 0.5, (150, 12)), rng.normal(0, 8, (20, 12)), np.zeros((3, 12))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(3)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 2.4
    assert {(r["a"], r["b"]) for r in clusters.vector_pairs(df, 2.4).collect()} == set(zip(*map(list, np.nonzero(near)), strict=True))
    core = near.sum(1) >= 5
    root = {i: i for i in range(len(x)) if core[i]}
    while True:
        new = {i: min(root[j] for j in np.flatnonzero(near[i] & core)) for i in root}
        if new == root:
            break
        root = new
    number = {r: k for k, r in enumerate(sorted(set(root.values())))}
    want = {i: number[root[i]] if core[i] else min((number[root[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))}
    assert {r["id"]: r["label"] for r in clusters.vector_dbscan(df, 2.4, 5).collect()} == want and len(set(want.values())) > 3
    assert clusters.vector_dbscan(df.limit(0), 2.4, 5).count() == 0


def test_circles_share_the_common_devices(spark):
    from wayfarer.operators import analysis

    rows = [(f"x{i}", "X", "S" if i < 4 else "T") for i in range(10)] + [(f"y{i}", "Y", "T") for i in range(3)] + [(f"z{i}", "Z", "S") for i in range(5)] + [(f"o{i}", None, "S") for i in range(20)]
    df = spark.createDataFrame(rows, "mac_address string, manufacturer string, dbscan_label string")
    got = {r["manufacturer"]: r for r in analysis.circles(df, ["X", "Y", "Z", "none"], "S").collect()}
    big = math.sqrt(29 / math.pi)
    assert set(got) == {"X", "Y", "Z"} and (got["X"]["inside"], got["X"]["outside"]) == (4, 6)
    assert got["Y"]["distance"] == pytest.approx(big + math.sqrt(3 / math.pi)) and got["Z"]["distance"] == pytest.approx(big - math.sqrt(5 / math.pi))
    # The common area of X by counting a fine grid of points.
    side = np.linspace(-6, 6, 1_500)
    u, v = np.meshgrid(side, side)
    d = got["X"]["distance"]
    both = (u * u + v * v <= big * big) & ((u - d) ** 2 + v * v <= got["X"]["radius"] ** 2)
    assert both.sum() * (side[1] - side[0]) ** 2 == pytest.approx(4, abs=0.05) and (got["X"]["x"], got["X"]["y"]) == pytest.approx((d, 0))


def test_devices_near_by_hausdorff_distance(spark):
    from wayfarer.operators import trajectories

    rng = random.Random(8)
    rows = []
    for n in range(40):
        spread, cx, cy = rng.choice([3.0, 30.0]), rng.uniform(0, 100), rng.uniform(0, 100)
        rows += [(f"d{n:02}", rng.gauss(cx, spread), rng.gauss(cy, spread)) for _ in range(rng.randint(1, 12))]
    rows += rows[:9] + [("lone", 5000.0, -700.0), ("copy", *rows[0][1:]), ("bare", None, 1.0), (None, 1.0, 1.0)]
    path = {}
    for m, x, y in rows:
        if m and x is not None:
            path.setdefault(m, set()).add((x, y))
    way = lambda a, b: max(min(math.dist(p, q) for q in path[b]) for p in path[a])
    h = {(a, b): max(way(a, b), way(b, a)) for a in path for b in path if a != b}
    df = spark.createDataFrame(rows, "mac_address string, x double, y double").repartition(3).withColumn("a", F.lit(1)).withColumn("distance", F.lit("x"))
    got = {(r["a"], r["b"]): r["distance"] for r in trajectories.within(df, 40.0).collect()}
    assert got == pytest.approx({(a, b): d for (a, b), d in h.items() if a < b and d <= 40.0}) and len(got) > 20
    got = {(r["a"], r["rank"]): (r["b"], r["distance"]) for r in trajectories.nearest(df, 2).collect()}
    for a in path:
        for rank, (d, b) in enumerate(sorted((d, b) for (x, b), d in h.items() if x == a)[:2], 1):
            assert got.pop((a, rank)) == (b, pytest.approx(d))
    assert not got
    assert trajectories.within(df.limit(0), 5.0).count() == trajectories.nearest(df.limit(0)).count() == 0


def test_blocks_cells_and_all_pairs_give_the_same_devices(spark, monkeypatch):
    """One block or many, few distances held at once, and devices too long for a row: the same pairs, without a round of cells unless asked for."""
    from wayfarer.operators import trajectories

    rng = random.Random(5)
    rows = [(f"d{n % 50:02}", rng.gauss(n % 7 * 9, 6), rng.gauss(n % 5 * 9, 6 + n % 3)) for n in range(900)]
    df = spark.createDataFrame(rows, "mac_address string, x double, y double")
    ask = lambda: [sorted((r["a"], r["b"], round(r["distance"], 9)) for r in f.collect()) for f in (trajectories.within(df, 14.0), trajectories.nearest(df, 3))]
    with monkeypatch.context() as m:
        m.setattr(trajectories, "_within", None)
        want = ask()
        m.setattr(trajectories, "FEW_PLACES", 200)
        m.setattr(trajectories, "HELD", 64)
        assert ask() == want
    assert len(want[0]) > 20 and len(want[1]) == 150
    monkeypatch.setattr(trajectories, "PLACES_IN_ROW", 18)
    assert ask() == want


@pytest.mark.parametrize("few", [0, 20_000_000])
def test_density_clusters_without_pairs_of_points(spark, monkeypatch, few):
    """Dense, thin and copied points, some apart by just the reach: the same clusters as by all pairs, which are not made."""
    from wayfarer.operators import clusters

    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 0.12, (250, 2)), rng.uniform(-4, 4, (150, 2)), rng.normal((2, 2), 0.3, (120, 2)), np.repeat([[6.0, 6.0], [6.45, 6.0], [-6, 3], [1e9, 0]], [5, 3, 6, 1], 0)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9_998, math.inf, 1.0), (9_999, None, 1.0)], "id long, u double, v double").repartition(3)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.45 * 0.45
    core = near.sum(1) >= 6
    root = {i: i for i in range(len(x)) if core[i]}
    while (new := {i: min(root[j] for j in np.flatnonzero(near[i] & core)) for i in root}) != root:
        root = new
    number = {r: k for k, r in enumerate(sorted(set(root.values())))}
    want = {i: number[root[i]] if core[i] else min((number[root[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))} | {9_998: -1, 9_999: -1}
    assert len(number) > 2 and any(v >= 0 and not core[i] for i, v in want.items() if i < len(x))
    monkeypatch.setattr(clusters, "eps_pairs", None)
    monkeypatch.setattr(clusters, "FEW_PAIRS", few, raising=False)
    assert {r["id"]: r["label"] for r in clusters.dbscan(df, ["u", "v"], 0.45, 6).collect()} == want
    assert clusters.dbscan(df.limit(0), ["u", "v"], 0.45, 6).count() == 0


def test_devices_against_a_normal_sample_in_rows(spark, monkeypatch):
    """A device is one row, or a group of the test in the plane if it is large: the same figures, ties and no numbers included."""
    from wayfarer.operators import statistics

    rng = random.Random(11)
    rows = [(f"d{i % 5}", rng.choice([rng.gauss(0, 1), 0.5, float(i % 3)]), rng.gauss(1, 2) if i % 4 else 1.0) for i in range(300)]
    rows += [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 1.0, 2.0), ("bad", math.nan, 1.0), ("bad", 2.0, 1.0), ("none", None, 1.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "mac_address string, x double, y double").where("mac_address is not null").repartition(3)
    ask = lambda: {r["mac_address"]: (r["d"], r["p"]) for r in statistics.ks_normal(df, 200).collect()}
    with monkeypatch.context() as m:
        m.setattr(statistics, "PLACES_IN_ROW", 0, raising=False)
        want = ask()
    monkeypatch.setattr(statistics, "ks_2d", None)
    got = ask()
    assert set(got) == set(want) == {"d0", "d1", "d2", "d3", "d4", "one", "two", "bad"} and want["d0"][0] > 0 and got["bad"][0] is None
    for k, pair in want.items():
        assert [v is None for v in got[k]] == [v is None for v in pair] and [v for v in got[k] if v is not None] == pytest.approx([v for v in pair if v is not None], rel=1e-12)


def test_kth_neighbours_of_even_stores_without_pairs(spark, monkeypatch):
    """Places that all find their neighbours in the first round make no rows of pairs."""
    from wayfarer.operators import cleaning

    rows = [(s, 200 * n + 20 * i + 2 * j + t, i + t / 10, float(j)) for n, s in enumerate("ab") for i in range(10) for j in range(10) for t in (0, 1)] + [("a", 999, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "store_id string, point_id long, x double, y double")
    monkeypatch.setattr(cleaning, "_kth_by_pairs", None, raising=False)
    monkeypatch.setattr(cleaning, "Window", None)
    got = {r["point_id"]: r["distance"] for r in cleaning.kth_neighbour(df, 2).collect()}
    assert got == pytest.approx({i: sorted(math.hypot(x - p, y - q) for t, _, p, q in rows if t == s)[1] for s, i, x, y in rows}) and len(got) == 401
