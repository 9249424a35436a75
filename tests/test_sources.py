import datetime as dt
import glob
import xml.etree.ElementTree as xml

import pytest

from wayfarer.operators import features, flows, markov
from wayfarer.sources import adapter, readers, sinks
from wayfarer.streaming import live

SF = "/root/testdata/sf0.001"


def test_signals_csv_round_trip(spark, tmp_path):
    s = adapter.signals(spark, SF)
    sinks.write_csv(s, f"{tmp_path}/signals", ["mac_address", "date_time", "location", "store_id", "x", "y", "wifi_type", "email"], sort=True)
    back = readers.read_signals(spark, f"{tmp_path}/signals", "Phoenix Mall", version=1)
    assert back.count() == s.where("location = 'Phoenix Mall'").count() and dict(back.dtypes)["date_time"] == "timestamp_ntz"
    some = s.where("x > 100").select("mac_address").distinct()
    kept = readers.read_signals(spark, f"{tmp_path}/signals", version=3, features=some)
    assert kept.select("mac_address").distinct().count() == some.count()
    with pytest.raises(ValueError):
        readers.read_signals(spark, f"{tmp_path}/signals", version=9)
    sinks.write_by_location(s, f"{tmp_path}/malls")
    assert len(glob.glob(f"{tmp_path}/malls/location=*")) == 3


def test_directories_and_parameters(spark, tmp_path):
    (tmp_path / "shops.csv").write_text('frequency,store_id,area,centroid,x,y,count_of_shoppers\n3,B1,2.5,"[1.0, 2.0]",1,2,4\n1,B2,1,[3.5  4],3,4,1\n')
    d = {r["store_id"]: r["centroid"] for r in readers.read_directory(spark, f"{tmp_path}/shops.csv", 2).collect()}
    assert (d["B1"].x, d["B1"].y, d["B2"].x, d["B2"].y) == (1.0, 2.0, 3.5, 4.0)
    (tmp_path / "lm.csv").write_text("mac address,community\na,1\nb,1\nc,2\n")
    of, groups = readers.read_communities(spark, f"{tmp_path}/lm.csv")
    assert of.count() == 3 and {r["community"]: r["devices"] for r in groups.collect()} == {1: ["a", "b"], 2: ["c"]}
    s = adapter.signals(spark, SF)
    sinks.write_markov(markov.transitions(s), markov.initial(s), f"{tmp_path}/chain")
    a, pi = readers.read_markov(spark, f"{tmp_path}/chain")
    assert a.count() == markov.transitions(s).count() and pi.count() > 0
    (tmp_path / "x.html").write_text("<p>a <b>b</b></p><script>no</script>")
    assert readers.read_html_text(spark, f"{tmp_path}/x.html").first()["text"] == "a b"


def test_graph_and_matrix_files(spark, tmp_path):
    v = spark.createDataFrame([('a"&', "store"), ("b", "keyword")], "id string, node_type string")
    e = spark.createDataFrame([('a"&', "b", 2.0)], "src string, dst string, weight double")
    sinks.write_graphml(v, e, f"{tmp_path}/g")
    whole = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/g/part-*")))
    assert len(xml.fromstring(whole)[0]) == 3
    sinks.write_matrix(spark.createDataFrame([("a", "b", 1.5)], "a string, b string, distance double"), f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").first()[0].split() == ["a", "b", "1.500000"]
    sinks.write_adjacency(e, f"{tmp_path}/adj")
    assert spark.read.csv(f"{tmp_path}/adj").count() == 1


def test_graphml_keeps_odd_names(spark, tmp_path):
    names = ["a&b", '<"x">', "tab\there\nline\r", "it's é 日", "bell\x07", "&amp;", ""]
    v = spark.createDataFrame([(n, "store") for n in names] + [(None, None)], "id string, node_type string")
    e = spark.createDataFrame([(names[0], names[1], 2)], "src string, dst string, weight int")
    sinks.write_graphml(v, e, f"{tmp_path}/odd")
    graph = xml.fromstring("\n".join(open(f, newline="").read() for f in sorted(glob.glob(f"{tmp_path}/odd/part-*"))))[0]
    assert sorted(n.get("id") for n in graph if n.tag.endswith("node")) == sorted([*(n.replace("\x07", "") for n in names), ""])
    assert [(n.get("source"), n.get("target"), n.get("weight")) for n in graph if n.tag.endswith("edge")] == [(names[0], names[1], "2")]


def test_streams(spark, tmp_path):
    s = adapter.signals(spark, SF).drop("email", "wifi_type")
    s.repartition(1).sortWithinPartitions("date_time").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")

    def rows(df, mode="append"):
        q = df.writeStream.format("memory").queryName("got").outputMode(mode).option("checkpointLocation", f"{tmp_path}/{len(glob.glob(f'{tmp_path}/*'))}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table("got").collect()

    assert len(rows(live.moves(stream))) == sum(r["weight"] for r in flows.adjacency(s).collect())
    assert len(rows(live.approximate_window_counts(stream), "complete")) > 0
    visits = rows(live.visits(stream), "append")
    assert all(r["visit"].end > r["visit"].start for r in visits)


def test_features_cover_every_device(spark):
    s = adapter.signals(spark, SF)
    f = features.device_features(s, adapter.oui(spark, SF))
    assert f.count() == s.select("mac_address").distinct().count() and f.where("manufacturer is null").count() == 0
    assert f.where("total_path_length < 0 or av_straightness < 1").count() == 0
    assert f.agg({"start_time": "min"}).first()[0] >= dt.datetime(2024, 1, 1)
