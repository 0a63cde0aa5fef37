"""Ranking without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PREFIXES = (2, 6)


def sorted_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, ... in the order of the (unique) string ``key``.

    The rank is the sum of three parts: rows under smaller two-character
    prefixes, rows under smaller six-character prefixes within the same two, and
    the rank within the six. Only the table of two-character prefixes is ordered
    as a whole.
    """
    short, long = (F.substring(F.col(key), 1, n) for n in _PREFIXES)
    leaf = df.groupBy(short.alias("_p"), long.alias("_q")).agg(F.count("*").alias("_n"))
    top = leaf.groupBy("_p").agg(F.sum("_n").alias("_m"))
    top = top.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_top"))
    within = Window.partitionBy("_p").orderBy("_q")
    offsets = (
        leaf.withColumn("_mid", F.sum("_n").over(within) - F.col("_n"))
        .join(top, "_p")
        .select("_q", (F.col("_top") + F.col("_mid")).alias("_off"))
    )
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(key))
    ranked = df.withColumn("_q", long).withColumn("_rn", rank)
    return ranked.join(offsets, "_q").select(
        *df.columns, (F.col("_off") + F.col("_rn") - 1).alias(name)
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group; the limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n)
