"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    out = e.join(least, "a")
    up = out.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node it is joined to.

    Alternates two steps, each a grouping and a join: hang every larger neighbour, then
    every smaller one, on the least neighbour, until only stars are left. Nothing but links
    is ever held for a node. Every round's links are a stored table.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = stage.keep(e, f"{name}-0")
    k = 0
    while True:
        many = e.groupBy("a").count().where("count > 1").limit(1)
        chained = e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a").limit(1)
        if not many.count() and not chained.count():
            break
        k += 1
        e = stage.keep(_large_star(e).distinct(), f"{name}-{k}l")
        e = stage.keep(_small_star(e).distinct(), f"{name}-{k}s")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
