"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every step is an aggregation with map-side combine and a join on node, so a hub with any share
of the edges is pre-aggregated and split; nothing is collected. Each round is written to the
shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.llm.shared import Kept


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Null ends and loops are dropped; repeated edges count once; no edges give no rows.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u > v").distinct()
    now = Kept(spark, ends, "edges")
    mark = _mark(now.df)
    while mark[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = Kept(spark, small, "edges")
        now.drop()
        now, before, mark = new, mark, _mark(new.df)
        if mark == before:
            break
    roots = now.df.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).collect()[0]
    return r["n"], r["x"] or 0
