"""Exact top-k search by inner product, with MaxScore over posting lists.

A vector is read as a document: every dimension is two terms, one for its positive and one for
its negative components, and a posting is a vector with the size of its component (the
impact). The index is a stored table with a row per shard and term: postings in ascending
order, and the term's largest impact, which bounds what it can add to a score.

A query goes through a shard's postings in blocks. Its terms are ordered by bound; those
behind the point where all the rest together stay below the k-th best score so far are
non-essential: a vector found on none of the essential lists cannot get into the result. The
essential lists are traversed, the others are only probed for candidates whose score so far
plus the bound of what is left still reaches the k-th best, ties included. What is left is
bounded by the smaller of the summed term bounds and the product of the norms (of the query's
remaining part and of the shard's longest vector). A first shard gives every query its
opening threshold; the others start from it, and the shards' best are merged.

A task meets one shard and one part of the queries, both of bounded size, so neither the
index nor the queries are ever in one place.

Defined cases: vectors that are null or hold a null or a component that is not finite take no
part; components saturate at 2^26 either way, so that sums stay within a long; vectors of unequal length
count as if filled up with zeros; rows that repeat are candidates of their own, also for each
other; a null vec_id is no query, and as a candidate comes after all others of its score; fewer
candidates than k give all of them; an empty table gives no row; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage

K = 5
EVERY = 50
SCALE = 256
LIMIT = 1 << 26
PER_SHARD = 1 << 16  # vectors
PER_PART = 1 << 16  # queries
LEAST_SHARDS = 16
BLOCK = 1 << 13  # postings of so many vectors at a time
STEP = 4  # lists probed between two looks at the bound
LAST = np.iinfo(np.int64).max  # stands for a null vec_id: after all others

INDEX = "shard int, dim int, sign int, bound long, at array<int>, impact array<int>, ids array<long>, rows array<long>"
FOUND = "query_row long, query_id long, vec_id long, score long"

ORACLE = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id,
    list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM t WHERE place <= {K}"""


def whole_components(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as integers."""
    def one(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale)))

    return F.transform(vector, lambda x: one(x).cast("int"))


def usable(vector: str) -> Column:
    """Neither null nor with a component that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def _lists(table: pa.Table) -> np.ndarray:
    """One row per vector, short ones filled up with zeros."""
    column = table["x"].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _postings(table: pa.Table) -> pa.Table:
    """The index rows of one shard; the row of dimension -1 names its vectors."""
    shard, x = table["shard"][0].as_py(), _lists(table)
    norm = int(np.ceil(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))) + 1
    ids, rows = table["vec_id"].combine_chunks(), table["row"].combine_chunks()
    out = [(shard, -1, 0, norm, None, None, ids.to_numpy(zero_copy_only=False) if not ids.null_count
            else np.array([LAST if i is None else i for i in ids.to_pylist()]), rows.to_numpy())]
    for d in range(x.shape[1]):
        for sign in (1, -1):
            at = np.flatnonzero(sign * x[:, d] > 0)
            if len(at):
                impact = np.abs(x[at, d])
                out.append((shard, d, sign, int(impact.max()), at.astype(np.int32), impact.astype(np.int32), None, None))
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in INDEX.split(", ")])


def index(vectors: DataFrame, stage: Stage, shards: int) -> DataFrame:
    """Stored posting lists of (vec_id, row, x), by shard and term."""
    dealt = vectors.select("vec_id", "row", "x", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    return stage.keep(dealt.groupBy("shard").applyInArrow(_postings, INDEX), "postings")


class Shard:
    """A shard's posting lists, and each dimension's components for probing."""

    def __init__(self, table: pa.Table, block: int) -> None:
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bound: dict[tuple[int, int], int] = {}
        dims = table["dim"].to_pylist()
        head = dims.index(-1)
        self.norm = table["bound"][head].as_py()
        self.ids, self.rows = (np.array(table[c][head].as_py(), dtype=np.int64) for c in ("ids", "rows"))
        self.edges = np.append(np.arange(0, len(self.ids), block), len(self.ids))
        self.components: dict[int, np.ndarray] = {}
        columns = [table[c] for c in ("dim", "sign", "bound", "at", "impact")]
        for i in range(table.num_rows):
            if i == head:
                continue
            d, sign, bound = (c[i].as_py() for c in columns[:3])
            at, impact = (c[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[3:])
            self.lists[d, sign] = at, impact, np.searchsorted(at, self.edges)
            self.bound[d, sign] = bound
            self.components.setdefault(d, np.zeros(len(self.ids), dtype=np.int64))[at] = sign * impact

    def best(self, query: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors that reach ``least``, other than row ``own``."""
        dims = [d for d in np.flatnonzero(query).tolist() if d in self.components]
        bounds = [abs(int(query[d])) * self.bound.get((d, 1 if query[d] > 0 else -1), 0) for d in dims]
        order = np.argsort(-np.array(bounds, dtype=np.int64), kind="stable")
        dims, bounds = [dims[i] for i in order], np.array(bounds, dtype=np.int64)[order]
        weights = query[dims].astype(np.int64)
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        norms = np.append(np.sqrt(np.cumsum(weights[::-1].astype(np.float64) ** 2))[::-1], 0) * self.norm
        # a score is less than this above what is known after the first j terms
        rest = np.where(norms < rest, np.ceil(norms * (1 + 1e-9)), rest).astype(np.int64)
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b, (lo, hi) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist())):
            # below zero, also a vector on no list can be among the best
            every = least is None or least <= 0
            n = len(dims) if least is None else int(np.argmax(rest < least)) if rest[-1] < least else len(dims)
            known, seen = np.zeros(hi - lo, dtype=np.int64), np.full(hi - lo, every)
            for d, w in zip(dims[:n], weights[:n].tolist()):
                for sign in (1, -1):
                    if (d, sign) in self.lists:
                        at, impact, cuts = self.lists[d, sign]
                        here = at[cuts[b]: cuts[b + 1]] - lo
                        known[here] += sign * w * impact[cuts[b]: cuts[b + 1]]
                        if sign * w > 0:
                            seen[here] = True
            seen &= self.rows[lo:hi] != own
            found = np.flatnonzero(seen)
            known, found = known[found], found + lo
            for j in range(n, len(dims)):
                if (j - n) % STEP == 0:
                    alive = known + rest[j] >= least
                    known, found = known[alive], found[alive]
                    if not len(found):
                        break
                known += weights[j] * self.components[dims[j]][found]
            if least is not None:
                alive = known >= least
                known, found = known[alive], found[alive]
            places, scores = np.append(places, found), np.append(scores, known)
            if len(places) > k:
                first = np.lexsort((self.ids[places], -scores))[:k]
                places, scores = places[first], scores[first]
            if len(places) == k:
                least = int(scores.min()) if least is None else max(least, int(scores.min()))
        return places, scores


def _search(k: int, block: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=[c.split()[0] for c in FOUND.split(", ")])
        shard, queries = Shard(left, block), _lists(right)
        width = max(shard.components, default=-1) + 1
        if width > queries.shape[1]:
            queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        out: list[list[np.ndarray]] = [[], [], [], []]
        rows, names = right["row"].to_numpy(), right["vec_id"].to_numpy()
        for i, least in enumerate(right["least"].to_pylist()):
            places, scores = shard.best(queries[i], rows[i], k, least)
            for c, v in zip(out, (np.full(len(places), rows[i]), np.full(len(places), names[i]),
                                  shard.ids[places], scores)):
                c.append(v)
        columns = [np.concatenate(c).astype(np.int64) for c in out]
        arrays = [pa.array(c, pa.int64(), mask=(c == LAST) if j == 2 else None) for j, c in enumerate(columns)]
        return pa.table(arrays, names=[c.split()[0] for c in FOUND.split(", ")])
    return run


def _meet(lists: DataFrame, queries: DataFrame, numbers: tuple[int, int], parts: int, k: int, block: int) -> DataFrame:
    """Every shard numbered from the first to the last with every part of the queries."""
    first, last = numbers
    sides = (
        lists.where(F.col("shard").between(first, last)).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))),
        queries.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last)))))
    left, right = (s.groupBy("shard", "part") for s in sides)
    return left.cogroup(right).applyInArrow(_search(k, block), FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query, with their rank; a query has at most k rows per shard."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    embeddings: DataFrame, stage: Stage, k: int = K, every: int = EVERY, scale: int = SCALE,
    per_shard: int = PER_SHARD, per_part: int = PER_PART, least_shards: int = LEAST_SHARDS, block: int = BLOCK,
) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: the k best for every row whose vec_id ``every`` divides."""
    vectors = stage.keep(embeddings.where(usable("embedding")).select(
        "vec_id", F.monotonically_increasing_id().alias("row"), whole_components("embedding", scale).alias("x")),
        "vectors")
    n, asked = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, parts = max(least_shards, -(-n // per_shard)), max(1, -(-asked // per_part))
    lists = index(vectors, stage, shards)
    queries = vectors.where(F.col("vec_id") % every == 0).withColumn(
        "part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int"))
    opening = stage.keep(
        _meet(lists, queries.withColumn("least", F.lit(None).cast("long")), (0, 0), parts, k, block), "opening")
    known = opening.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(
        F.col("n") == k).select(F.col("query_row").alias("row"), "least")
    if shards == 1:
        return best_of(opening, k)
    others = _meet(lists, queries.join(known, "row", "left"), (1, shards - 1), parts, k, block)
    return best_of(opening.union(stage.keep(others, "others")), k)
