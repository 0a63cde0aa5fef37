"""Documents dealt to shards down a weighted tree of regions, racks and shards.

Every shard draws ``-ln(u) / weight`` with u hashed from the document's key and the shard's
number; a rack's draw is the least of its shards', a region's the least of its racks'. The
least of exponential draws is an exponential draw of the summed weight, so each level chooses
in proportion to its subtree's weight, and a document descends from the region of least draw
to its rack and its shard. A draw depends on nothing but the key and its own subtree, so when
a weight grows or a shard is added, documents move only into the subtrees that changed, and
never between others (the law ``key``).

Slots number a shard's documents without a gap: documents are counted per (shard, bucket)
with buckets of bounded size, and numbered within their bucket.

Defined cases: a null text has size 8 and the checksum of no bytes; a null doc_id is a key of
its own; rows that repeat go to one shard, into slots of their own; an empty table
gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage

PER_BUCKET = 50_000


@dataclass(frozen=True)
class Tree:
    """weights[region][rack] lists the weights of a rack's shards; shards are numbered in order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, regions: int, racks: int, shards: int) -> Tree:
        return cls((((1.0,) * shards,) * racks,) * regions)

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, numbered last, in the last rack."""
        *rest, last = self.weights
        return Tree((*rest, (*last[:-1], (*last[-1], weight))))

    def leaves(self) -> list[float]:
        return [w for region in self.weights for rack in region for w in rack]


def draws(key: Sequence[Column | str], tree: Tree, seed: int) -> Column:
    """The shards' draws, in order of their numbers."""
    def draw(shard: int, weight: float) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(shard), *key)
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return -F.ln(u) / F.lit(weight)

    return F.array(*[draw(i, w) for i, w in enumerate(tree.leaves())])


def descend(drawn: Column, tree: Tree) -> Column:
    """(region, rack, shard) from the shards' draws; racks are numbered within their region."""
    choice, first = None, 0
    for r, region in enumerate(tree.weights):
        racks = []
        for k, rack in enumerate(region):
            own = F.slice(drawn, first + 1, len(rack))
            best = F.array_min(own)
            at = F.array_position(own, best).cast("int") + F.lit(first - 1)
            racks.append(F.struct(best.alias("draw"), F.lit(k).alias("rack"), at.alias("shard")))
            first += len(rack)
        rack = racks[0] if len(racks) == 1 else F.least(*racks)
        node = F.struct(rack["draw"].alias("draw"), F.lit(r).alias("region"),
                        rack["rack"].alias("rack"), rack["shard"].alias("shard"))
        choice = node if choice is None else F.least(choice, node)
    return choice


def assign(
    docs: DataFrame, stage: Stage, tree: Tree, seed: int = 1, per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    key = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)))
    more = tree.grown()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
        # the grown tree's draws begin with the tree's own
        draws(key, more, seed).alias("drawn"))
    rows = rows.withColumns({"x": descend(F.col("drawn"), tree),
                             "grown": descend(F.col("drawn"), more)["shard"]})
    n = len(tree.leaves())
    rows = stage.keep(rows.select(
        "doc_id", "size", "text_crc32", "row", "x.region", "x.rack", "x.shard", "grown"), "sharded")
    buckets = max(64, -(-rows.count() // (n * per_bucket)))
    bucket = F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    # at most shards x buckets rows, a shard's buckets in one window
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    placed = rows.withColumn("nth", F.row_number().over(inside))
    return placed.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "region", "rack", "shard",
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))
