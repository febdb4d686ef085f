"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.staging import release, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(hash(a, b))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any direction -> (node, component), the component named by its smallest node.

    Nodes without an edge aren't in the result. Every step is a join on the node and a partial aggregate; a hub's rows
    are only joined to one small row of it. Null ends are dropped.
    """
    many = edges.count()
    now = staged(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), many)
    mark = _mark(now)
    while mark[0]:
        both = _both(now)
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large.where("a <> b"), 2 * mark[0])
        down = large.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        least = down.groupBy(F.col("x").alias("u")).agg(F.min("y").alias("m"))
        small = down.join(least, down["x"] == least["u"])
        now = staged(small.select(F.col("y").alias("a"), F.col("m").alias("b")).unionAll(small.select(F.col("x"), F.col("m"))).where("a <> b").distinct(), 2 * mark[0])
        new = _mark(now)
        if new == mark:
            break
        mark = new
    star = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return star.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().join(star.select("node"), "node", "left_anti"))
