"""The registered queries of the mobility engine; their SQL is in :mod:`.oracles`.

Every query reads whole tables. Floats are rounded to six digits, since sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import analysis, bayes, clusters, features, flows, graphs, joins, markov, mixtures, outliers, simulation, statistics, text, trajectories
from ..operators import cleaning
from ..schema import MALLS
from ..sources import adapter
from ..sources.adapter import signals, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: What the registered Bayes queries look at.
_BAYES = ["radius_of_gyration", "av_path_length"]


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Float columns rounded, without a negative zero; a small shift first lets exact halves fall one way."""
    shift = 3.0 * 10.0 ** -(digits + 3)
    return df.select(*((F.round(F.col(c) + shift, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all devices, with a class that a quarter of them lacks and a two-way split, both by device number."""
    d = features.device_features(signals(spark, sf_dir))
    number = F.conv(F.substring("mac_address", -2, 2), 16, 10).cast("int")
    label = F.element_at(F.array(*map(F.lit, (*bayes.CLASSES, bayes.UNKNOWN))), number % 4 + 1)
    return d.withColumns({"dbscan_label": label, "is_out_of_hours": number % 2})


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.store_positions(signals(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_features(spark, sf_dir)


@query
def device_features(spark, d):
    f = features.device_features(signals(spark, d), adapter.oui(spark, d))
    flat = f.select("*", *(F.col(f"{s}.{v}").alias(f"{s}_{v}") for s in ("centroid", "start_coordinate", "end_coordinate") for v in "xy"))
    return rounded(flat.drop("centroid", "start_coordinate", "end_coordinate"))


@query
def device_frequency(spark, d):
    return features.frequency(signals(spark, d))


@query
def radius_of_gyration(spark, d):
    return rounded(features.gyration(signals(spark, d)))


@query
def gyration_without_repeats(spark, d):
    return rounded(features.gyration(signals(spark, d), drop_repeats=True))


@query
def length_of_stay(spark, d):
    return features.length_of_stay(signals(spark, d))


@query
def out_of_hours(spark, d):
    return features.out_of_hours(signals(spark, d))


@query
def count_density_std(spark, d):
    return rounded(features.density_deviation(signals(spark, d), 60))


@query
def step_features(spark, d):
    return rounded(features.step_features(signals(spark, d)))


@query
def step_features_without_repeats(spark, d):
    return rounded(features.step_features(signals(spark, d), drop_repeats=True))


@query
def wifi_type_priority(spark, d):
    return features.wifi_priority(signals(spark, d))


@query
def start_end(spark, d):
    return features.start_end(signals(spark, d))


@query
def shops_visited(spark, d):
    return features.shops_visited(signals(spark, d))


@query
def forward_probability(spark, d):
    return rounded(features.forward_probability(signals(spark, d)))


@query
def remove_consecutive_runs(spark, d):
    return features.remove_consecutive(signals(spark, d)).select("event_id", "mac_address", "store_id")


@query
def first_of_run(spark, d):
    return features.first_of_runs(signals(spark, d)).select("event_id", "mac_address", "store_id")


@query
def turning_runs(spark, d):
    return rounded(features.turning_runs(signals(spark, d)))


@query
def msd_curve(spark, d):
    return rounded(features.diffusion(signals(spark, d)), 4)


@query
def fraction_visited(spark, d):
    return rounded(features.fraction_visited(signals(spark, d)))


@query
def direction_bias(spark, d):
    shops = stores(spark, d).where(S.is_shop("store_id")).select("store_id", F.col("x").alias("shop_x"), F.col("y").alias("shop_y"))
    return features.direction_bias(signals(spark, d), shops)


@query
def manufacturer_join(spark, d):
    s = joins.add_manufacturer(signals(spark, d), adapter.oui(spark, d))
    return s.groupBy("manufacturer").agg(F.count("*").alias("signals"), F.count_distinct("mac_address").alias("devices"))


@query
def label_threshold(spark, d):
    p = features.fraction_visited(signals(spark, d))
    p = p.withColumn("p", F.round(F.col("fraction") * 1.2, 6))
    return rounded(p.select("mac_address", "p", S.label_of("p").alias("label")))


@query
def semi_devices(spark, d):
    s = signals(spark, d)
    few = features.frequency(s).where("frequency % 2 = 0")
    return joins.keep_devices(s, few).select("event_id", "mac_address")


@query
def anti_devices(spark, d):
    s = signals(spark, d)
    return joins.drop_devices(s, features.frequency(s).where("frequency % 2 = 0")).select("event_id", "mac_address")


@query
def legacy_clean(spark, d):
    return cleaning.legacy_clean(signals(spark, d), 1, 0, 10, 0.5).select("event_id", "mac_address")


@query
def first_last_arrival(spark, d):
    return joins.first_last(signals(spark, d))


@query
def composite_key_overwrite(spark, d):
    s = signals(spark, d)
    fixed = s.where("y > 90").select("mac_address", "date_time", (F.col("x") + 1).alias("x"), F.lit(0.0).alias("y"))
    return rounded(joins.overwrite_positions(s, fixed.dropDuplicates(["mac_address", "date_time"])).select("event_id", "x", "y"))


@query
def shop_corridor_ratio(spark, d):
    return rounded(joins.shop_corridor_ratio(signals(spark, d)))


@query
def store_categories(spark, d):
    directory = stores(spark, d).select("store_id", F.when(F.col("visitors") % 2 == 0, "even").otherwise("odd").alias("store_category")).where("store_id <> 'B101'")
    s = joins.with_categories(signals(spark, d), directory)
    return s.groupBy("store_category").agg(F.count("*").alias("n"))


@query
def duplicate_fill(spark, d):
    s = cleaning.resolve_duplicates(adapter.coarse_signals(spark, d))
    return rounded(s.select("event_id", "mac_address", "date_time", "x", "y"))


@query
def duplicate_devices(spark, d):
    return cleaning.duplicate_devices(adapter.coarse_signals(spark, d))


@query
def around_duplicates(spark, d):
    w = cleaning.around_duplicates(adapter.coarse_signals(spark, d))
    total = F.aggregate("window", F.lit(0.0), lambda s, p: s + p["x"] + p["y"])
    return rounded(w.select("mac_address", "n", F.size("window").alias("size"), total.alias("total")))


@query
def signal_periods(spark, d):
    return cleaning.periods(signals(spark, d)).select("mac_address", "n", "seconds")


@query
def out_of_hour_periods(spark, d):
    p = cleaning.periods(signals(spark, d))
    return rounded(p.groupBy("mac_address", "off_hours").agg(F.count("*").alias("periods"), F.avg("seconds").alias("mean_seconds")))


@query
def unrealistic_speeds(spark, d):
    return cleaning.unlikely_speeds(signals(spark, d), 0.02, 1.0)


@query
def store_neighbours(spark, d):
    return rounded(cleaning.store_neighbours(signals(spark, d), 0.02))


@query
def store_outliers(spark, d):
    return rounded(outliers.density_outliers(signals(spark, d), 8.0, 10))


@query
def store_two_means(spark, d):
    return rounded(outliers.two_means(signals(spark, d)))


@query
def store_two_means_step(spark, d):
    p = outliers.places(signals(spark, d))
    return rounded(outliers.two_means_step(p, outliers.two_means_start(p))).withColumnRenamed("group", "store_id")


@query
def stationary_devices(spark, d):
    s = signals(spark, d).withColumns({"x": F.floor(F.col("x") / 100), "y": F.floor(F.col("y") / 25)})
    return cleaning.stationary_devices(s)


@query
def knn_store_clean(spark, d):
    return cleaning.clean_stores(signals(spark, d), 3, 1.0).select("event_id", "store_id")


@query
def kth_neighbour_distance(spark, d):
    p = stores(spark, d).select(F.lit("all").alias("store_id"), F.col("store_id").alias("point_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return rounded(cleaning.kth_neighbour(p, 5))


@query
def kth_neighbour_signals(spark, d):
    p = signals(spark, d).select("store_id", F.col("event_id").alias("point_id"), "x", "y")
    return rounded(cleaning.kth_neighbour(p, 5))


@query
def signals_per_bin(spark, d):
    return flows.per_bin(signals(spark, d), 15)


@query
def arrivals_per_bin(spark, d):
    return flows.arrivals(features.start_end(signals(spark, d)), 30)


@query
def stay_by_band(spark, d):
    s = signals(spark, d).groupBy("mac_address", F.to_date("date_time").alias("day")).agg(F.min("date_time").alias("start_time"), F.max("date_time").alias("end_time"))
    return flows.stay_by_band(s.withColumn("length_of_stay", S.seconds_between("start_time", "end_time")), 1000)


@query
def sliding_flow(spark, d):
    return flows.sliding_flow(signals(spark, d), 1440, 720)


@query
def sliding_flow_half_open(spark, d):
    return flows.sliding_flow(signals(spark, d), 1440, 720, compat=False)


@query
def sliding_shopper_count(spark, d):
    return flows.sliding_visitors(signals(spark, d), 60, 30)


@query
def net_flow(spark, d):
    return flows.net_flow(flows.adjacency(signals(spark, d)))


@query
def in_degree(spark, d):
    return flows.in_degree(flows.adjacency(signals(spark, d)))


@query
def store_visitors(spark, d):
    s = signals(spark, d)
    directory = stores(spark, d).select("store_id").union(spark.createDataFrame([("B999",)], "store_id string"))
    return flows.add_visitors(s, directory)


@query
def store_position(spark, d):
    return rounded(stores(spark, d))


@query
def shop_frequency(spark, d):
    return flows.shop_frequency(signals(spark, d))


@query
def shop_area_v1(spark, d):
    return rounded(flows.shop_area(signals(spark, d)))


@query
def shop_area_v2(spark, d):
    return rounded(flows.shop_area(signals(spark, d), rounded=True))


@query
def area_power_law(spark, d):
    return rounded(flows.area_power_law(signals(spark, d)))


@query
def in_degree_rank(spark, d):
    return flows.degree_rank(flows.shop_frequency(signals(spark, d)))


@query
def rank_probability(spark, d):
    return rounded(flows.rank_probability(flows.shop_frequency(signals(spark, d))))


@query
def top_manufacturers(spark, d):
    s = joins.add_manufacturer(features.frequency(signals(spark, d)), adapter.oui(spark, d))
    return s.groupBy("manufacturer").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "manufacturer").limit(10)


@query
def top_lines_per_part(spark, d):
    top = flows.top_per_group(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"), "l_partkey", "l_extendedprice", 3, "l_orderkey")
    return top.groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query
def mall_venn(spark, d):
    s = signals(spark, d).select("store_id", "location").where("store_id is not null").distinct()
    return flows.venn(s, "store_id", "location", list(MALLS))


@query
def manufacturer_venn(spark, d):
    f = joins.add_manufacturer(devices(spark, d), adapter.oui(spark, d))
    return analysis.manufacturers_and_class(f, ["FRANCE", "KENYA", "PERU"], "Stationary")


@query
def manufacturer_circles(spark, d):
    f = joins.add_manufacturer(devices(spark, d), adapter.oui(spark, d))
    return rounded(analysis.circles(f, ["FRANCE", "KENYA", "PERU", "CHINA"], "Stationary"))


@query
def pair_plot(spark, d):
    return rounded(analysis.pair_plot(devices(spark, d), ["radius_of_gyration", "av_path_length", "av_turning_angle"]))


@query
def confident_posteriors(spark, d):
    p = bayes.sequential(devices(spark, d), _BAYES)
    return rounded(analysis.confident_posteriors(p, "p_1", 0.5, 10), 4)


@query
def clean_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_words(F.col("text"))).alias("cleaned"))


@query
def distinct_signals(spark, d):
    s = adapter.coarse_signals(spark, d).select("mac_address", "date_time", "store_id").distinct()
    return s.groupBy("mac_address").agg(F.count("*").alias("n"))


@query
def union_malls(spark, d):
    s = signals(spark, d)
    out = None
    for mall in MALLS:
        one = s.where(F.col("location") == mall).groupBy("location", "store_id").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def label_difference(spark, d):
    f = devices(spark, d)
    return f.where("frequency > 10").select("mac_address").exceptAll(f.where(f"dbscan_label = '{bayes.UNKNOWN}'").select("mac_address"))


@query
def community_store_visits(spark, d):
    s = signals(spark, d)
    community = F.conv(F.substring("mac_address", -2, 2), 16, 10).cast("int") % 3
    c = s.select("mac_address").distinct().withColumn("community", community)
    return joins.community_visits(s, c)


@query
def manufacturer_stats(spark, d):
    f = joins.add_manufacturer(devices(spark, d), adapter.oui(spark, d))
    return rounded(statistics.by_manufacturer(f, "radius_of_gyration", 3))


@query
def kde_likelihood(spark, d):
    f = devices(spark, d)
    out = bayes.likelihoods(f, bayes.training(f, _BAYES), _BAYES)
    return rounded(out.select("mac_address", *(f"l_{x}_{k}" for x in _BAYES for k in range(3))), 8)


@query
def sequential_bayes(spark, d):
    return rounded(bayes.sequential(devices(spark, d), _BAYES, trace=True))


@query
def bayes_labels(spark, d):
    return bayes.label_devices(devices(spark, d), _BAYES, confidence=0.5).select("mac_address", "dbscan_label", "bayesian_label")


@query
def bayes_progress(spark, d):
    return rounded(bayes.progress(bayes.sequential(devices(spark, d), _BAYES, trace=True), len(_BAYES), 0.04))


@query
def naive_bayes(spark, d):
    return rounded(bayes.naive(devices(spark, d), _BAYES), 8)


@query
def two_class_labels(spark, d):
    return rounded(bayes.two_class(devices(spark, d), _BAYES))


@query
def recursive_bayes(spark, d):
    return bayes.recursive(devices(spark, d), _BAYES, (0.4, 0.6), 0.6)


@query
def bayes_bootstrap(spark, d):
    return bayes.bootstrap(devices(spark, d), _BAYES, 3, (0.4, 0.6), 0.5)


@query
def cumulative_ks(spark, d):
    return rounded(bayes.cumulative_ks(devices(spark, d), _BAYES))


@query
def density_check(spark, d):
    return rounded(bayes.density_check(devices(spark, d), "radius_of_gyration", "Shopper"))


@query
def ks_1d(spark, d):
    return rounded(statistics.ks_1d(devices(spark, d), "radius_of_gyration", "is_out_of_hours"))


@query
def ks_features(spark, d):
    names = ["frequency", "radius_of_gyration", "av_path_length", "av_turning_angle", "total_path_length"]
    return rounded(statistics.ks_features(devices(spark, d), names, "is_out_of_hours"))


@query
def ks_normal(spark, d):
    return rounded(statistics.ks_normal(signals(spark, d)))


@query
def ks_2d(spark, d):
    f = devices(spark, d).select("frequency", "radius_of_gyration", "is_out_of_hours")
    return rounded(statistics.ks_2d(f, "frequency", "radius_of_gyration", "is_out_of_hours"))


@query
def energy_statistic(spark, d):
    return rounded(statistics.energy_statistic(devices(spark, d), ["radius_of_gyration", "av_path_length"], "is_out_of_hours"))


@query
def energy_test(spark, d):
    return statistics.energy_test(devices(spark, d), ["radius_of_gyration", "av_path_length"], "is_out_of_hours", 19)


@query
def log_bin(spark, d):
    return rounded(statistics.log_bin(table(spark, d, "orders"), "o_totalprice", 1.0, 1000.0, 1.6), 12)


@query
def linear_histogram(spark, d):
    return rounded(statistics.histogram(table(spark, d, "orders"), "o_totalprice", 20), 12)


@query
def value_frequency(spark, d):
    return statistics.value_frequency(table(spark, d, "lineitem"), "l_linenumber")


@query
def loglog_regression(spark, d):
    p = devices(spark, d).where("total_path_length > 0")
    return rounded(flows.regression(p, F.log10(F.col("frequency").cast("double")), F.log10("total_path_length")))


@query
def matrix_correlation(spark, d):
    s = signals(spark, d)
    cells = lambda x: x.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").cast("double").alias("value"))
    early, late = s.where("day(date_time) <= 15"), s.where("day(date_time) > 15")
    return rounded(statistics.matrix_correlation(cells(flows.adjacency(early)), cells(flows.adjacency(late))))


@query
def zscore(spark, d):
    f = devices(spark, d).select("mac_address", "radius_of_gyration", "av_path_length")
    return rounded(statistics.zscore(f, ["radius_of_gyration", "av_path_length"]))


@query
def pca_variance(spark, d):
    return rounded(statistics.pca_variance(devices(spark, d), ["radius_of_gyration", "av_path_length", "av_turning_angle"]))


def _points(spark, d):
    z = statistics.zscore(devices(spark, d).select("mac_address", "radius_of_gyration", "av_path_length"), ["radius_of_gyration", "av_path_length"])
    return z.select(F.col("mac_address").alias("id"), F.round("radius_of_gyration", 9).alias("u"), F.round("av_path_length", 9).alias("v"))


@query
def dbscan_core_points(spark, d):
    return clusters.core_points(_points(spark, d), ["u", "v"], 0.45, 6)


@query
def dbscan_labels(spark, d):
    return clusters.dbscan(_points(spark, d), ["u", "v"], 0.45, 6)


@query
def kmeans(spark, d):
    return clusters.kmeans(_points(spark, d), ["u", "v"], 3).select("id", "cluster")


@query
def gaussian_mixture(spark, d):
    return rounded(clusters.gaussian_mixture(_points(spark, d), ["u", "v"], 3).select("id", "cluster", "probability"))


def _split(spark, d):
    """The points and the components that a split of them by class starts with."""
    f = devices(spark, d).select(F.col("mac_address").alias("id"), "dbscan_label")
    p = _points(spark, d).join(f, "id")
    return p, mixtures.split_start(p, ["u", "v"], F.col("dbscan_label") == "Mall Worker")


@query
def mixture_from_split(spark, d):
    p, start = _split(spark, d)
    return rounded(mixtures.mixture_from(p, ["u", "v"], start).select("id", "cluster", "probability"), 4)


@query
def mixture_step(spark, d):
    p, start = _split(spark, d)
    points, mean = mixtures.centred(p, ["u", "v"])
    m, _ = mixtures.maximisation_step(points, mixtures.Gaussians(start.weights, start.means - mean, start.covariances))
    rows = [(i, float(w), *map(float, mu + mean), float(c[0, 0]), float(c[0, 1]), float(c[1, 1])) for i, (w, mu, c) in enumerate(zip(m.weights, m.means, m.covariances, strict=True))]
    return rounded(spark.createDataFrame(rows, "cluster int, weight double, mean_u double, mean_v double, cov_uu double, cov_uv double, cov_vv double"))


@query
def bayesian_mixture(spark, d):
    return rounded(mixtures.bayesian_mixture(_points(spark, d), ["u", "v"], 3).select("id", "cluster", "probability"), 4)


@query
def bayesian_mixture_step(spark, d):
    """The posterior that the classes' points lead to."""
    f = devices(spark, d).select(F.col("mac_address").alias("id"), "dbscan_label")
    kind = F.coalesce(*(F.when(F.col("dbscan_label") == c, i) for i, c in enumerate(bayes.CLASSES)), F.lit(3))
    points, mean = mixtures.centred(_points(spark, d).join(f, "id").withColumn("kind", kind.cast("double")), ["u", "v", "kind"])
    xy = points.select("x0", "x1")
    q = mixtures.default_prior(xy, 4).update(mixtures.hard(points, F.round(F.col("x2") + float(mean[2])), 4, ["x0", "x1"]))
    rows = [(i, *map(float, (a, b, *(m + mean[:2]), v, s[0, 0], s[0, 1], s[1, 1]))) for i, (a, b, m, v, s) in enumerate(zip(q.alpha, q.beta, q.means, q.nu, q.spread, strict=True))]
    return rounded(spark.createDataFrame(rows, "cluster int, alpha double, beta double, mean_u double, mean_v double, nu double, spread_uu double, spread_uv double, spread_vv double"))


@query
def gaussian_nb(spark, d):
    f = devices(spark, d).select("mac_address", "radius_of_gyration", "av_path_length", F.col("is_out_of_hours").alias("label"))
    return clusters.gaussian_nb(f, ["radius_of_gyration", "av_path_length"], "label").select("mac_address", "predicted")


@query
def markov_transitions(spark, d):
    return rounded(markov.transitions(signals(spark, d)))


@query
def markov_transitions_collapsed(spark, d):
    return rounded(markov.transitions(signals(spark, d), returns=False))


@query
def markov_initial(spark, d):
    return rounded(markov.initial(signals(spark, d)))


@query
def markov_step(spark, d):
    s = signals(spark, d)
    return rounded(markov.step(markov.initial(s), markov.transitions(s)))


@query
def markov_steady_state(spark, d):
    s = signals(spark, d)
    return rounded(markov.steady_state(markov.initial(s).select("store_id", "p"), markov.transitions(s), 5))


@query
def markov_stationary(spark, d):
    return rounded(markov.stationary(markov.transitions(signals(spark, d))))


@query
def markov_residuals(spark, d):
    s = signals(spark, d)
    return rounded(markov.residuals(markov.initial(s), markov.transitions(s), 4), 9)


@query
def ingoing_probability(spark, d):
    return rounded(markov.ingoing(markov.transitions(signals(spark, d))))


@query
def markov_mixture(spark, d):
    return markov.mixture(signals(spark, d), 2, 2)


@query
def hmm_labels(spark, d):
    return markov.hidden_states(signals(spark, d), 2, 3).select("mac_address", "label", F.size("states").alias("length"))


@query
def visit_pivot_long(spark, d):
    return graphs.visits(signals(spark, d))


@query
def store_classes(spark, d):
    return graphs.store_classes(graphs.visits(signals(spark, d)))


@query
def common_stores(spark, d):
    c = graphs.common_stores(graphs.visits(signals(spark, d)))
    return c.select("a", "b", "common", F.array_join("stores", ",").alias("stores"))


@query
def similarity_col(spark, d):
    return rounded(graphs.similarity(graphs.visits(signals(spark, d)), "col"))


@query
def similarity_row(spark, d):
    return rounded(graphs.similarity(graphs.visits(signals(spark, d)), "row"))


@query
def list_overlap(spark, d):
    return graphs.list_overlap(graphs.visits(signals(spark, d)))


def _store_edges(spark, d):
    e = flows.adjacency(signals(spark, d))
    both = e.union(e.select("dst", "src", "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@query
def modularity(spark, d):
    c = stores(spark, d).select(F.col("store_id").alias("node"), F.substring("store_id", 1, 1).alias("community"))
    return rounded(graphs.modularity(flows.adjacency(signals(spark, d)), c))


@query
def modularity_as_written(spark, d):
    c = stores(spark, d).select(F.col("store_id").alias("node"), F.substring("store_id", 1, 1).alias("community"))
    return rounded(graphs.modularity(flows.adjacency(signals(spark, d)), c, as_written=True))


@query
def louvain(spark, d):
    return graphs.louvain(_store_edges(spark, d))


@query
def girvan_newman(spark, d):
    return graphs.girvan_newman(_store_edges(spark, d))


@query
def edge_betweenness(spark, d):
    return rounded(graphs.betweenness(_store_edges(spark, d)))


@query
def trajectory_paths(spark, d):
    t = trajectories.trajectories(signals(spark, d))
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    return t.select("mac_address", F.size("path").alias("n"), first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"))


def _mall_paths(spark, d):
    """A path for each mall and store of a kind: stores' daily mean places."""
    s = signals(spark, d).where("store_id is not null")
    day = s.groupBy(F.col("store_id").alias("mac_address"), F.to_date("date_time").alias("day")).agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    return trajectories.trajectories(day.withColumns({"date_time": F.col("day").cast("timestamp_ntz"), "event_id": F.lit(0)}))


@query
def hausdorff_directed(spark, d):
    return rounded(trajectories.hausdorff(_mall_paths(spark, d), undirected=False))


@query
def hausdorff_undirected(spark, d):
    return rounded(trajectories.normalised(trajectories.hausdorff(_mall_paths(spark, d))))


@query
def hausdorff_within(spark, d):
    return rounded(trajectories.within(signals(spark, d), 30.0))


@query
def hausdorff_nearest(spark, d):
    return rounded(trajectories.nearest(signals(spark, d), 3))


@query
def hausdorff_core_points(spark, d):
    return clusters.vector_core_points(trajectories.standardised_rows(trajectories.hausdorff(_mall_paths(spark, d))), 3.0, 3)


@query
def hausdorff_clusters(spark, d):
    return clusters.vector_dbscan(trajectories.standardised_rows(trajectories.hausdorff(_mall_paths(spark, d))), 3.0, 3)


@query
def hausdorff_sampled(spark, d):
    return rounded(trajectories.sampled(_mall_paths(spark, d), 8, 2))


@query
def animation_frames(spark, d):
    f = trajectories.frames(adapter.coarse_signals(spark, d))
    return f.select("date_time", F.size("places").cast("long").alias("devices"))


@query
def store_pairs(spark, d):
    p = stores(spark, d).select("store_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return rounded(joins.store_pairs(p))


@query
def polygon_store_id(spark, d):
    box = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), side, strict=True))) for side in ((0, 0, 90, 10), (90, 10, 80, 60), (80, 60, 10, 55), (10, 55, 0, 0))))
    shops = stores(spark, d).where(S.is_shop("store_id")).select("store_id", F.conv(F.substring("store_id", 2, 3), 10, 10).cast("int").alias("i"))
    e = shops.select(F.col("store_id").alias("name"), ((F.col("i") % 7) * 60).alias("ox"), (F.floor(F.col("i") / 7) % 3 * 30).alias("oy"), F.explode(box).alias("s"))
    edges = e.select("name", *((F.col(f"s.{v}{k}") + F.col(f"o{v}")).alias(f"{v}{k}") for k in (1, 2) for v in "xy"))
    return joins.points_in_polygons(signals(spark, d).select(F.col("event_id").alias("point_id"), "x", "y"), edges)


@query
def rake_phrases(spark, d):
    p = text.phrases(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("id").agg(F.count("*").alias("phrases"), F.count_distinct("phrase").alias("distinct_phrases"))


@query
def rake_word_scores(spark, d):
    return rounded(text.word_scores(text.phrases(table(spark, d, "documents"), "doc_id", "text")))


@query
def rake_keywords(spark, d):
    return rounded(text.keywords(table(spark, d, "documents"), "doc_id", "text", least=3, most_words=3, least_frequency=2))


@query
def rake_adjoined(spark, d):
    return text.adjoined(table(spark, d, "documents"), "doc_id", "text")


@query
def keyword_graph(spark, d):
    docs = table(spark, d, "documents")
    k = text.keyword_pipeline(docs, "doc_id", "text").select(F.col("id").cast("string").alias("store"), "word", "score")
    _, e = text.keyword_graph(k, docs.select(F.col("doc_id").cast("string").alias("store"), F.col("source").alias("category")))
    return e


@query
def keyword_degree(spark, d):
    return statistics.value_frequency(text.degrees(keyword_graph(spark, d)), "degree")


@query
def page_text(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.length(text.strip_tags(F.col("html"))).alias("n_chars"))


@query
def mac_bits(spark, d):
    return signals(spark, d).select("mac_address").distinct().select("mac_address", S.mac_bits("mac_address", compat=False).alias("bits"))


@query
def reverse_mac(spark, d):
    return signals(spark, d).select("mac_address").distinct().select("mac_address", S.reverse_mac("mac_address").alias("reversed"))


def _simulated(spark, d):
    s = signals(spark, d)
    n = max(50, s.select("mac_address").distinct().count())
    return simulation.simulate_network(markov.transitions(s), markov.initial(s), stores(spark, d), simulation.stay_model(s), n, 240)


@query
def simulate_network(spark, d):
    return simulation.simulated_devices(_simulated(spark, d))


@query
def simulate_angles(spark, d):
    places = stores(spark, d)
    n = signals(spark, d).select("mac_address").distinct().count()
    return simulation.simulate_angles(places, n, 30).groupBy("store_id").agg(F.count("*").alias("n"))


@query
def simulation_vs_real(spark, d):
    return simulation.compare(signals(spark, d), _simulated(spark, d), 60)


@query
def dfa_exponent(spark, d):
    return rounded(statistics.dfa(signals(spark, d)))


def _named(spark, d):
    return joins.add_manufacturer(signals(spark, d), adapter.oui(spark, d))


@query
def analysis_ready(spark, d):
    columns = ["av_speed", "av_straightness"]
    return rounded(analysis.analysis_ready(features.device_features(signals(spark, d)), columns).select("mac_address", "frequency", *columns))


@query
def track_slopes(spark, d):
    return rounded(analysis.slopes(signals(spark, d)))


@query
def signals_with_directory(spark, d):
    return rounded(analysis.with_directory(signals(spark, d), stores(spark, d).select("store_id", "x", "y")).select("event_id", "x", "y", "x_actual", "y_actual"))


@query
def data_gaps(spark, d):
    return analysis.gaps(_named(spark, d), "FRANCE")


@query
def signals_without_store(spark, d):
    return rounded(analysis.without_store(signals(spark, d).withColumn("store_id", F.when(S.is_shop("store_id"), F.col("store_id")))))


@query
def duplicate_manufacturers(spark, d):
    return analysis.manufacturers_of(_named(spark, d), cleaning.duplicate_devices(adapter.coarse_signals(spark, d)).where("moved > 0"))


@query
def step_speeds(spark, d):
    return rounded(analysis.step_speeds(signals(spark, d)))


@query
def manufacturer_volume(spark, d):
    return analysis.volume_by_manufacturer(_named(spark, d), 30, 60)


@query
def gyration_by_mall(spark, d):
    return rounded(analysis.by_mall(signals(spark, d), features.gyration, "radius_of_gyration"))


@query
def class_statistics(spark, d):
    return rounded(analysis.group_statistics(devices(spark, d), "dbscan_label", ["radius_of_gyration", "av_path_length"]))


@query
def largest_classes(spark, d):
    return analysis.largest_groups(devices(spark, d), "dbscan_label", 2).select("dbscan_label", "mac_address")


@query
def likeliest_start(spark, d):
    return rounded(analysis.likeliest_start(markov.initial(signals(spark, d))))


@query
def store_codes(spark, d):
    return analysis.one_hot(signals(spark, d).select("event_id", "store_id"), "store_id").select("event_id", "store_id", "code", "size")


@query
def similarity_slice(spark, d):
    names = graphs.store_classes(graphs.visits(signals(spark, d))).where("mac_address like '%0'").select(F.col("class").alias("name")).distinct()
    return rounded(analysis.matrix_slice(graphs.similarity(graphs.visits(signals(spark, d)), "col", names), names))


@query
def cleaned_malls(spark, d):
    return rounded(analysis.clean_malls(adapter.coarse_signals(spark, d)).groupBy("location").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in _QUERIES}
