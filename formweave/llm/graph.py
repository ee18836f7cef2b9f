"""Connected components by alternating star contractions (Kiveris et al., 2014).

Each round is a partially aggregated minimum and an equi-join, both free of per-node collections.
Nodes that hold a good share of all edges are few: their minimum is broadcast, so their edges stay
where they are instead of meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Scratch

#: A hub has one edge in ``SHARE`` or more, and ``LEAST`` at least.
SHARE, LEAST = 128, 256


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``: component is the smallest node reachable.

    Nodes are of any type with an order. Only nodes that have an edge to another node are returned.
    Null ends and loops are dropped, repeated edges count once.
    """
    spark = edges.sparkSession
    e = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    e, state = scratch.cut(e, "edges"), None
    kind, total = StructType([StructField("u", e.schema["b"].dataType)]), e.count()
    for _ in range(rounds):
        # The smaller ends are the centres of stars.
        by = e.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        now = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("x"), F.collect_list(F.when(F.col("n") >= max(LEAST, total / SHARE), F.struct(F.col("b"))))).first()
        if tuple(now)[:2] == state:
            break
        state, total, hubs = tuple(now)[:2], now[0], now[2]
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u")
        if hubs:
            few = F.broadcast(spark.createDataFrame([tuple(h) for h in hubs], kind))
            at_hubs = large.join(F.broadcast(least.join(few, "u", "left_semi")), "u")
            large = at_hubs.unionByName(large.join(few, "u", "left_anti").join(least, "u"))
        else:
            large = large.join(least, "u")
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "star")
        scratch.drop(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
