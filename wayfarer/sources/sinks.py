"""Sinks: CSV and Parquet exports, Markov parameters, GraphML and distance matrices."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, sort: bool = False) -> None:
    """CSV with a header; ``sort`` orders each file by device and time."""
    out = df.select(columns) if columns else df
    if sort:
        out = out.repartition("mac_address").sortWithinPartitions("mac_address", "date_time")
    out.write.mode("overwrite").csv(path, header=True)


def write_by_location(df: DataFrame, path: str) -> None:
    """Parquet, a folder for each mall."""
    df.write.mode("overwrite").partitionBy("location").parquet(path)


def write_markov(transitions: DataFrame, initial: DataFrame, path: str) -> None:
    transitions.write.mode("overwrite").parquet(f"{path}/transitions")
    initial.write.mode("overwrite").parquet(f"{path}/initial")


def write_matrix(cells: DataFrame, path: str) -> None:
    """Text lines of ``a b value`` with six decimals, from ``(a, b, distance)``: spread over tasks, never whole in one."""
    cells.select(F.format_string("%s %s %10.6f", "a", "b", "distance").alias("value")).write.mode("overwrite").text(path)


def write_adjacency(edges: DataFrame, path: str) -> None:
    """CSV cells ``src, dst, weight`` without header."""
    edges.select("src", "dst", "weight").write.mode("overwrite").csv(path)


#: What stands for a character in an attribute (fixed values).
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"}


def attribute(value: str) -> Column:
    """A column in double quotes, as XML wants an attribute; null is empty, characters that XML has no place for go."""
    plain = F.regexp_replace(F.coalesce(F.col(value).cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    return F.concat(F.lit('"'), functools.reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), plain), F.lit('"'))


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of GraphML lines: elements are written by tasks, the frame around them by files that sort first and last."""
    head = vertices.sparkSession.createDataFrame([('<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">',)], "value string")
    v = vertices.select(F.format_string("<node id=%s label=%s/>", attribute("id"), attribute("node_type")).alias("value"))
    e = edges.select(F.format_string('<edge source=%s target=%s weight="%s"/>', attribute("src"), attribute("dst"), F.col("weight").cast("string")).alias("value"))
    tail = vertices.sparkSession.createDataFrame([("</graph></graphml>",)], "value string")
    head.coalesce(1).union(v).union(e).union(tail.coalesce(1)).write.mode("overwrite").text(path)
