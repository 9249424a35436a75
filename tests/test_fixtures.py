"""Small relations with values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wayfarer.functions import scalar as S
from wayfarer.operators import bayes, cleaning, clusters, features, flows, graphs, joins, markov, statistics, text, trajectories

DAY = dt.datetime(2016, 12, 22, 9)
SCHEMA = "event_id long, mac_address string, date_time timestamp_ntz, location string, store_id string, x double, y double, wifi_type string"


def track(spark, points, mac="a", start=DAY):
    """Signals of ``(seconds, x, y, store)``."""
    rows = [(i, mac, start + dt.timedelta(seconds=t), "Phoenix Mall", s, float(x), float(y), "unknown") for i, (t, x, y, s) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def f1(spark):
    return track(spark, [(0, 0, 0, "B1"), (10, 3, 4, "B1"), (30, 3, 8, "B2"), (150, 6, 8, None), (450, 6, 8, "B1")])


def test_features_of_one_track(f1):
    r = features.device_features(f1).first()
    want = {
        "frequency": 5, "length_of_stay": 450, "number_of_shops": 2, "radius_of_gyration": 3.908964, "total_path_length": 12.0, "av_path_length": 3.0,
        "av_speed": 0.18125, "av_turning_angle": 1.107149, "total_turning_angle": 2.214297, "av_turning_angle_velocity": 0.927295, "av_straightness": 1.151123,
        "count_density_variance": 2.12132, "av_speed_from_total": 0.026667, "turning_angle_density": 0.184525, "is_out_of_hours": 0,
    }
    assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-6)
    assert (r["centroid"].x, r["centroid"].y) == pytest.approx((3.6, 5.6))
    assert features.forward_probability(f1).first()["forwards"] == 0.5
    assert sorted(x["event_id"] for x in features.remove_consecutive(f1).collect()) == [1, 2, 3, 4]
    assert sorted(x["event_id"] for x in features.first_of_runs(f1).collect()) == [0, 2, 4]


def test_order_of_rows_makes_no_difference(f1):
    a = features.device_features(f1).first()
    assert features.device_features(f1.orderBy(F.desc("event_id"))).first() == a


def test_short_tracks_and_bounds(spark):
    r = features.device_features(track(spark, [(0, 1, 1, "B1")])).first()
    assert r["length_of_stay"] == 0 and all(r[k] is None for k in ("av_speed", "av_path_length", "total_turning_angle", "av_straightness", "count_density_variance"))
    r = features.length_of_stay(track(spark, [(0, 0, 0, None), (90_000, 1, 1, None)])).first()
    assert (r["length_of_stay"], r["total_stay"]) == (3600, 90_000)
    for hour in (3, 5):
        assert features.out_of_hours(track(spark, [(0, 0, 0, None)], start=dt.datetime(2016, 12, 22, hour))).first()[1] == 1
    p = spark.createDataFrame([(x,) for x in (0.95, 0.96, 0.05, 0.04)], "p double").select(S.label_of("p")).collect()
    assert [r[0] for r in p] == [0.5, 1, 0.5, 0]


@pytest.mark.parametrize(
    "points,fixed,left",
    [
        ([(0, 0, 0), (10, 1, 0), (10, 30, 0), (20, 2, 0), (30, 3, 0)], (1, 0), 4),
        ([(0, 0, 0), (10, 1, 0), (10, 5, 0), (20, 6, 0)], (3, 0), 3),
        ([(0, 0, 0), (0, 20, 0), (10, 19, 0)], (20, 0), 2),
    ],
)
def test_duplicate_resolution(spark, points, fixed, left):
    rows = cleaning.resolve_duplicates(track(spark, [(t, x, y, "B1") for t, x, y in points])).collect()
    twice = next(t for i, (t, *_) in enumerate(points) if t == points[i + 1][0])
    assert len(rows) == left and [(r["x"], r["y"]) for r in rows if r["date_time"] == DAY + dt.timedelta(seconds=twice)] == [fixed]


def test_frames_of_sliding_windows(spark):
    s = track(spark, [(60 * m, 0, 0, f"B{i % 2}") for i, m in enumerate((0, 30, 45, 60, 150))])
    got = [(r["event_id"], r["frame"]) for r in flows._framed(s, 60, 30, True).collect()]
    assert sorted(got) == [(1, 0), (2, 0), (2, 1), (3, 1)]
    two = track(spark, [(60 * m, 0, 0, "B1") for m in (0, 30, 150)]).union(track(spark, [(1800, 0, 0, "B1")], "b"))
    v = {r["frame"]: r["frequency"] for r in flows.sliding_visitors(two).collect()}
    assert v[0] == 3 and {r["frame"]: r["frequency"] for r in flows.sliding_visitors(two, compat=False).collect()}[0] == 2
    early = track(spark, [(0, 0, 0, "B1")], start=dt.datetime(2016, 12, 22, 7))
    assert flows._framed(early, 60, 30, False).count() == 0


def test_similarity(spark):
    s = track(spark, [(0, 0, 0, "B1"), (1, 0, 0, "B2")]).union(track(spark, [(i, 0, 0, f"B{i}") for i in (2, 3, 4)], "b"))
    p = graphs.visits(s.union(track(spark, [(5, 0, 0, "B2"), (6, 0, 0, "B1"), (7, 0, 0, "B1")], "c")))
    assert {(r["mac_address"], r["class"]) for r in graphs.store_classes(p).collect()} == {("a", "a"), ("b", "b"), ("c", "a")}
    col, row = ({(r["a"], r["b"]): r["value"] for r in graphs.similarity(p, n).collect()} for n in ("col", "row"))
    own = {("a", "a"): 1.0, ("b", "b"): 1.0}
    assert col == pytest.approx(own | {("a", "b"): 1 / 3, ("b", "a"): 1 / 2}) and row == pytest.approx(own | {("a", "b"): 1 / 2, ("b", "a"): 1 / 3})


def _many_visits(spark):
    """Devices of 70 stores in most of which most devices were, so that a set takes more than one word of bits."""
    rows = [(f"m{d}", f"B{s:02d}", 1 + (d * s) % 3) for d in range(40) for s in range(70) if (d * 31 + s * 17) % 11 > 2]
    return spark.createDataFrame([*rows, ("far", "B99", 2), ("again", "B99", 5)], "mac_address string, store_id string, n long")


def test_pairs_that_meet_all_at_once_are_those_that_meet_by_store(spark, monkeypatch):
    p = _many_visits(spark)
    asks = [graphs.common_stores, lambda p: graphs.similarity(p, "row"), lambda p: graphs.similarity(p, "col"), graphs.list_overlap]
    got = [sorted(map(str, f(p).collect())) for f in asks]
    monkeypatch.setattr(graphs, "ROWS_FOR_PAIR", 0)
    assert got == [sorted(map(str, f(p).collect())) for f in asks]
    some = p.select(F.col("mac_address").alias("name")).where("mac_address like '%1'")
    names = {r["name"] for r in some.collect()}
    want = sorted(str(r) for r in graphs.similarity(p).collect() if r["a"] in names and r["b"] in names)
    assert want == sorted(map(str, graphs.similarity(p, "col", some).collect()))


def test_pairs_are_not_shuffled_again(spark):
    """Where most stores are common, no aggregation follows the join that makes the pairs."""
    p = _many_visits(spark)
    for pairs in (graphs.common_stores(p), graphs.similarity(p), graphs.list_overlap(p)):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "Aggregate" not in plan


def test_markov_chain(f1):
    a = {(r["src"], r["dst"]): r["p"] for r in markov.transitions(f1).collect()}
    assert a == {("B1", "B1"): 0.5, ("B1", "B2"): 0.5, ("B2", "B1"): 1.0}
    assert {(r["src"], r["dst"]): r["p"] for r in markov.transitions(f1, returns=False).collect()} == {("B1", "B2"): 1.0, ("B2", "B1"): 1.0}
    assert {r["store_id"]: r["p"] for r in markov.initial(f1).collect()} == {"B1": 1.0, "B2": 0.0}
    steady = {r["store_id"]: r["p"] for r in markov.steady_state(markov.initial(f1).select("store_id", "p"), markov.transitions(f1), 40).collect()}
    assert steady == pytest.approx({"B1": 2 / 3, "B2": 1 / 3}, abs=1e-6)


def test_hidden_and_mixed_chains(spark):
    s = None
    for k in range(12):
        stores = ["B1", "B2", "B3"] * 7 if k % 2 else ["B1", "B3", "B2"] * 7
        one = track(spark, [(i, 0, 0, b) for i, b in enumerate(stores)], f"d{k}")
        s = one if s is None else s.union(one)
    own = {r["mac_address"]: r["label"] for r in markov.hidden_states(s, 2, 8).collect()}
    assert set(own) == {f"d{k}" for k in range(12)}
    gamma = {}
    for r in markov.mixture(s, 2, 5).collect():
        gamma.setdefault(r["mac_address"], {})[r["k"]] = r["gamma"]
    assert all(sum(g.values()) == pytest.approx(1) for g in gamma.values())
    side = {m: max(g, key=g.get) for m, g in gamma.items()}
    assert len({side[f"d{k}"] for k in range(0, 12, 2)}) == 1 and side["d0"] != side["d1"]


def test_hausdorff(spark):
    paths = trajectories.trajectories(track(spark, [(0, 0, 0, None), (1, 3, 4, None), (2, 3, 8, None)]).union(track(spark, [(0, 0, 0, None), (1, 6, 8, None)], "b")))
    assert {(r["a"], r["b"]): r["distance"] for r in trajectories.hausdorff(paths, undirected=False).collect()} == {("a", "b"): 5.0, ("b", "a"): 3.0}
    assert trajectories.hausdorff(paths).first()["distance"] == 5.0


def test_kernel_density(spark):
    d = spark.createDataFrame([(str(i), 11, float(x), "Shopper") for i, x in enumerate((1, 2, 4))], "mac_address string, frequency long, v double, dbscan_label string")
    out = bayes.likelihoods(d.union(spark.createDataFrame([("q", 11, 5.0, "Not Classified")], d.schema)), bayes.training(d, ["v"]), ["v"]).collect()
    got = {r["v"]: r["l_v_1"] for r in out}
    assert got[2.0] == pytest.approx(0.214895, abs=1e-6) and got[5.0] == pytest.approx(0.083737, abs=1e-6) and all(r["l_v_0"] is None for r in out)


def test_bins_and_tests(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 3, 5, 8, 13)], "v double")
    b = sorted(statistics.log_bin(v, "v").collect())
    assert [(r["lo"], r["hi"]) for r in b] == [(1, 2), (2, 4), (4, 8), (8, 16)]
    assert [r["density"] for r in b] == pytest.approx([0.285714, 0.142857, 0.035714, 0.035714], abs=1e-6) and b[0]["centre"] == pytest.approx(1.414214)
    assert sum(r["density"] * (r["hi"] - r["lo"]) for r in b) == pytest.approx(1)
    with pytest.raises(ValueError):
        statistics.log_bin(v, "v", a=1.0)
    g = spark.createDataFrame([(float(x), 0) for x in (1, 2, 3, 4)] + [(float(x), 1) for x in (3, 4, 5)], "v double, g int")
    assert statistics.ks_1d(g, "v", "g").first()["d"] == 0.5


def test_shop_area(spark):
    s = track(spark, [(0, 0, 0, "B1"), (1, 0, 3, "B1"), (2, 1, 5, "B1")])
    assert flows.shop_area(s).first()["area"] == 3 and flows.shop_area(s, rounded=True).first()["area"] == 4


def test_angles_and_macs(spark):
    q = math.pi / 2
    a = spark.createDataFrame([(0.0, q), (0.0, 3 * q), (0.0, 2 * q), (1.0, 1.0)], "a double, b double").select(S.angle_direction("a", "b")).collect()
    assert [r[0] for r in a] == [-1, 1, 0, None]
    m = spark.createDataFrame([("24:05:0f:00:00:01",)], "mac string").select(S.reverse_mac("mac"), S.mac_bits("mac"), S.oui_prefix("mac")).first()
    assert m[0] == "24:a0:f0:00:00:80" and m[1] == "0010010000000101000011110" + "0" * 22 + "1" and m[2] == "24050F"


def test_keywords(spark):
    d = spark.createDataFrame([(1, "Compatibility of systems of linear constraints")], "id int, text string")
    got = {r["phrase"]: r["score"] for r in text.keywords(d, "id", "text", ("of",)).collect()}
    assert got == {"linear constraints": 4.0, "compatibility": 1.0, "systems": 1.0}


def test_density_clusters(spark):
    points = [(i, float(i % 10) / 20, 0.0) for i in range(10)] + [(10 + i, 5 + float(i) / 20, 5.0) for i in range(6)] + [(99, 50.0, 50.0)]
    p = spark.createDataFrame(points, "id long, u double, v double")
    got = {r["id"]: r["label"] for r in clusters.dbscan(p, ["u", "v"], 0.11, 3).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[i] for i in range(10, 16)} == {1} and got[99] == -1


def test_communities(spark):
    ring = lambda names: [(a, b, 1.0) for a in names for b in names if a != b]
    e = spark.createDataFrame([*ring("abcd"), *ring("wxyz"), ("a", "w", 1.0), ("w", "a", 1.0)], "src string, dst string, weight double")
    for found in (graphs.louvain(e), graphs.girvan_newman(e)):
        of = {r["node"]: r["community"] for r in found.collect()}
        assert len({of[n] for n in "abcd"}) == 1 and len({of[n] for n in "wxyz"}) == 1 and of["a"] != of["w"]
    c = spark.createDataFrame([(n, int(n in "wxyz")) for n in "abcdwxyz"], "node string, community int")
    assert 0.3 < graphs.modularity(e, c, directed=False).first()["q"] < 0.5


def _modularity(e, of):
    m = sum(w for *_, w in e)
    degree = {}
    for a, _, w in e:
        degree[of[a]] = degree.get(of[a], 0) + w
    return sum(w for a, b, w in e if of[a] == of[b]) / m - sum(d * d for d in degree.values()) / m / m


def _greedy(e):
    """Node by node moves to the best neighbouring community until none gains."""
    nodes = sorted({a for a, *_ in e})
    of, moved = {n: n for n in nodes}, True
    while moved:
        moved = False
        for n in nodes:
            best = max(sorted({of[b] for a, b, _ in e if a == n} | {of[n]}), key=lambda c: _modularity(e, of | {n: c}))
            if _modularity(e, of | {n: best}) > _modularity(e, of) + 1e-12:
                of[n], moved = best, True
    return of


def test_communities_of_a_random_graph(spark):
    import random

    rng = random.Random(5)
    half = [(f"n{i:02}", f"n{j:02}", float(rng.randint(1, 4))) for i in range(24) for j in range(i) if rng.random() < (0.6 if i % 4 == j % 4 else 0.06)]
    e = [*half, *((b, a, w) for a, b, w in half)]
    found = graphs.louvain(spark.createDataFrame(e, "src string, dst string, weight double"))
    assert _modularity(e, {r["node"]: r["community"] for r in found.collect()}) >= _modularity(e, _greedy(e)) - 1e-9


def test_betweenness_by_hand(spark):
    """A square with a tail: a-b-c-d-a, d-e."""
    half = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e")]
    got = {(r["src"], r["dst"]): r["betweenness"] for r in graphs.betweenness(spark.createDataFrame(half, "src string, dst string")).collect()}
    assert got == pytest.approx({("a", "b"): 2.5, ("b", "c"): 2.5, ("c", "d"): 3.5, ("a", "d"): 3.5, ("d", "e"): 4.0})


def test_points_in_polygons(spark):
    box = lambda n, x, y, w: [(n, x, y, x + w, y), (n, x + w, y, x + w, y + w), (n, x + w, y + w, x, y + w), (n, x, y + w, x, y)]
    e = spark.createDataFrame([*box("p", 0.0, 0.0, 60.0), *box("q", 40.0, 40.0, 60.0)], "name string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, 50.0, 50.0), (3, 90.0, 90.0), (4, 200.0, 1.0)], "point_id int, x double, y double")
    assert {r["point_id"]: r["label"] for r in joins.points_in_polygons(p, e).collect()} == {1: "p", 2: "more than 1 shop", 3: "q", 4: None}


def test_store_cleaning(spark):
    s = track(spark, [(i, 0.1 * i, 0, "B1") for i in range(5)] + [(9, 50, 50, "B1"), (10, 0, 0, None), (11, 0, 0, "B2")])
    assert sorted(r["event_id"] for r in cleaning.clean_stores(s).collect()) == [0, 1, 2, 3, 4, 6]
    assert sorted(r["event_id"] for r in cleaning.clean_stores(s, shops_only=True).collect()) == [0, 1, 2, 3, 4]


def test_simulated_agents_are_held_a_few_at_a_time():
    import pandas as pd

    from wayfarer.operators import simulation

    parts = list(simulation.some_agents(iter([pd.DataFrame({"id": range(300)}), pd.DataFrame({"id": range(300, 310)})])))
    assert max(map(len, parts)) <= simulation.AGENTS < 100 and [i for p in parts for i in p] == list(range(310))


def test_keywords_split_and_count_texts_once(spark):
    """One pass finds phrases, one reads texts for runs of words; phrases and their words' scores share the counts."""
    rows = [(1, "dog of cat|dog, the cat's 12.5 and dog of bird. dog of cat and the bird; Dog of Cat"), (2, None), (1, "dog of cat. the cat-fish sat on a mat")]
    d = spark.createDataFrame(rows, "id int, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    p = text.phrases(d, "id", "text")
    assert sorted(r["phrase"] for r in p.collect() if r["phrase"] == "dog") == ["dog"] * 6 and {"bird", "fish sat", "mat"} <= {r["phrase"] for r in p.collect()}
    assert plan(p).count("Generate") == 1
    runs = text.adjoined(d, "id", "text")
    assert {(r["id"], r["phrase"], r["n"]) for r in runs.collect()} == {(1, "dog of cat", 3)} and plan(runs).count("posexplode") == 1
    k = text.keywords(d, "id", "text")
    assert {r["phrase"]: r["score"] for r in k.collect()}["dog"] == 1.0 and plan(k).count("Generate") == 2


def test_simulated_stays_are_drawn_from_all_devices(spark):
    """The densities' devices are all there, however many, and agents that share none of their draws arrive at their own times."""
    import numpy as np

    from wayfarer.operators import simulation

    day = F.timestamp_seconds(F.lit(1482400000) + F.col("id") % 20_000).cast("timestamp_ntz")
    few = spark.range(6_500).select(F.col("id").alias("event_id"), F.format_string("%012x", "id").alias("mac_address"), day.alias("date_time"))
    later = few.withColumn("date_time", F.expr("date_time + interval 1 second * (event_id % 900 + 1)"))
    model = simulation.stay_model(few.union(later))
    assert model.count() == 6_500 and model.agg(F.min("at"), F.max("at"), F.count_distinct("at")).first() == (0, 6_499, 6_500)
    want = {r[0] for r in few.select(S.second_of_day("date_time")).collect()}
    assert {r["arrival"] for r in model.collect()} == want and {r["stay"] for r in model.collect()} == set(map(float, range(1, 901)))
    drawn = {r["id"]: r for r in simulation._drawn(model, 6_500, 300, 7).collect()}
    at = {r["at"]: r for r in model.collect()}
    for agent in range(300):
        a, _, s, _ = simulation._draw(np.random.default_rng([7, agent]), 6_500)
        assert (drawn[agent]["arrival"], drawn[agent]["stay"]) == (at[a]["arrival"], at[s]["stay"])
    stores = spark.createDataFrame([("B1", 0.0, 0.0), ("B2", 1.0, 1.0)], "store_id string, x double, y double")
    chain = spark.createDataFrame([("B1", "B2", 1.0), ("B2", "B1", 1.0)], "src string, dst string, p double")
    first = spark.createDataFrame([("B1", 1.0)], "store_id string, p double")
    assert simulation.simulate_network(chain, first, stores, model, 100, 240).select("mac_address").distinct().count() > 50
    assert simulation.simulate_network(chain, first, stores, model.limit(0), 100, 240).count() == 0
