"""Equi-joins of a long table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a right side of at most this many rows is broadcast, a larger one shuffled
BROADCAST_ROWS = 500_000
# in the shuffled join, the heaviest keys are spread over this many partitions
HOT_KEYS = 10_000
SPREAD = 32
# rows that one task sorts or groups
TASK_ROWS = 2_000_000


def join_per_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
    left_rows: Callable[[], int] | None = None,
    task_rows: int = TASK_ROWS,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Inner join on ``key``; ``right`` holds each key once.

    ``right`` should be a stored table: its rows are counted first. If there are
    more than ``broadcast_rows``, both sides are shuffled and the ``HOT_KEYS``
    keys with the largest ``weight`` (their number of left rows) are salted by a
    hash of ``spread_by``, so that no key has to fit in one task.

    The shuffled sides are dealt into so many partitions that a task sorts about ``task_rows``
    rows of ``left``, however many there are: they are counted, as in a stored table, unless
    ``left_rows`` gives a number that they do not exceed.

    Where ``left`` has keys that ``right`` lacks and these may be frequent, ``keys``, a stored table of
    (key, weight) that holds them too, each once, tells the heaviest keys instead of ``right``.
    """
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(right), key)
    n = max(1, -(-(left.count() if left_rows is None else left_rows()) // task_rows))
    sides = salted_sides(left, right, key, spread_by, weight, n, right if keys is None else keys)
    return sides[0].join(sides[1], [key, "_salt"]).drop("_salt")


def salted_sides(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, weight: str, n: int, keys: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Both sides by (key, _salt) in ``n`` partitions, the heaviest of ``keys`` spread over ``SPREAD`` salts."""
    hot = (
        keys.orderBy(F.desc(weight), key)
        .limit(HOT_KEYS)
        .select(key, F.lit(True).alias("_hot"))
    )
    slot = F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int")
    salted_left = (
        left.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.when(F.col("_hot"), slot).otherwise(F.lit(0)))
        .drop("_hot")
    )
    slots = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_right = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(slots))
        .drop("_hot")
    )
    return salted_left.repartition(n, key, "_salt"), salted_right.repartition(n, key, "_salt")


def attach_small(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner",
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small; broadcast only if it proves to be."""
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def dealt(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """A stored table by ``key``, in so many partitions that a task gets at most about ``task_rows``."""
    return rows.repartition(max(1, -(-rows.count() // task_rows)), key)
