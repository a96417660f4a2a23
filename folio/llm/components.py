"""Connected components over an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the component's smallest node) for every node of ``edges`` (``a``, ``b``, both long).

    Alternates the large-star and small-star steps: each node hands its larger
    neighbours, then its smaller ones, to its smallest neighbour.  A logarithmic
    number of rounds in practice; each is written to the shared folder, and only
    its row counts reach the driver.  Nodes without an edge to another give no row.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("u")).first()
        if now == sign or now[0] == now[2] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        sign = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
