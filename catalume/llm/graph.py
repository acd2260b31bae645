"""Connected components of a link table, by alternating star operations on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, discard, join_spread, materialize


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Large star: links each larger neighbour of a node to the smallest of the node and its neighbours. Small star: the same for the node and its smaller neighbours. Of ``few`` edges, the smallest ones are sent to all tasks."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    joined = lambda rows: rows.join(F.broadcast(least), "u") if few else join_spread(rows, least, "u", F.xxhash64("v"))  # noqa: E731  a hub's rows go to many tasks
    told = lambda rows: joined(rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if large:
        linked = told(both.where("v > u"))
    else:
        linked = told(near).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of ``links`` (u, v, both of one type of whole numbers): root is the smallest node that is reachable.

    Links may repeat and point either way. Every round writes its links to the shared folder; it ends when they stay as
    they are, each node then being linked to its root alone. Only a count and a checksum come to the driver.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        few = before[0] <= SENT_ROWS // 4
        old, edges = edges, materialize(_star(_star(edges, True, few), False, few), "links")
        discard(old)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
