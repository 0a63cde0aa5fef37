"""Exact top-k search against all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexicade.llm import maxscore
from lexicade.llm.stage import Stage

SCHEMA = "vec_id long, embedding array<float>"


def wanted(rows, k, every):
    """(query_id, rank, vec_id, score) of every query row, by looking at all of them."""
    use = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for a, (i, x) in enumerate(use):
        if i is None or i % every:
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(use) if a != b]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def found(spark, rows, k=5, every=50, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "x", "shard", "part")})
    got = maxscore.top_k(df, Stage(spark), k=k, every=every, **how)
    return sorted([(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()], key=repr)


def vectors(n, dim, seed, spread=64):
    rng = random.Random(seed)
    return [(i, [rng.choice((-1, 0, 0, 1)) * rng.randint(0, spread) / 256 for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("n, dim, spread, how", [
    (300, 8, 64, {"least_shards": 3, "block": 16}),
    (300, 8, 1, {"least_shards": 1, "block": 50}),  # very many ties
    (200, 40, 200, {"least_shards": 4, "block": 1000, "per_part": 10}),
    (120, 6, 30, {"least_shards": 2, "per_shard": 20, "k": 1}),
])
def test_all_scores(spark, n, dim, spread, how):
    rows = vectors(n, dim, n + dim, spread)
    assert found(spark, rows, every=7, **how) == wanted(rows, how.get("k", 5), 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(30, 4, 5) + [
        (50, None), (100, [1.0, None]), (150, [nan]), (200, [inf, 0.0]), (250, [-inf]),
        (300, []), (350, [0.0, 0.0, 0.0, 0.0, 0.0, 9.0]), (400, [-0.001, 0.25]),
        (450, [0.1, 0.2, 0.3, 0.4]), (450, [0.1, 0.2, 0.3, 0.4]), (451, [0.1, 0.2, 0.3, 0.4]),
        (None, [0.1, 0.2, 0.3, 0.4]), (None, [5.0, 5.0])]
    for least_shards in (1, 3):
        assert found(spark, rows, least_shards=least_shards, block=8) == wanted(rows, 5, 50)


def test_fewer_candidates_and_negative_scores(spark):
    rows = [(0, [1.0, 1.0]), (1, [-1.0, -1.0]), (2, [-2.0, 0.0])]
    assert found(spark, rows) == [(0, 1, 1, -131072), (0, 2, 2, -131072)]
    rows = [(0, [1.0])] + [(i, [-float(i)]) for i in range(1, 40)]
    assert found(spark, rows, block=4) == wanted(rows, 5, 50)


def test_large_components_saturate(spark):
    limit = maxscore.LIMIT
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1e30])]
    assert found(spark, rows) == [(0, 1, 1, limit * limit - 256 * limit)]


def test_empty_table_and_single_row(spark):
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []


def test_lists_are_left_out(spark):
    """With a high threshold only essential lists are read, and the result stays the same."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (500, 30))
    x[7] = 40
    query = np.r_[50, 40, rng.integers(0, 3, 28)].astype(np.int64)
    table = pa.table([pa.array([0] * 500, pa.int32()), pa.array(range(500), pa.int64()),
                      pa.array(range(500), pa.int64()), pa.array(x.tolist(), pa.list_(pa.int32()))],
                     names=["shard", "vec_id", "row", "x"])
    shard = maxscore.Shard(maxscore._postings(table), 100)
    scores = x @ query
    order = np.lexsort((np.arange(500), -scores))[:1]
    touched = {d: 0 for d in shard.components}

    class Watched(dict):
        def __getitem__(self, key):
            touched[key[0]] += 1
            return dict.__getitem__(self, key)

    shard.lists = Watched(shard.lists)
    places, best = shard.best(query, -1, 1, int(scores[order[0]]))
    assert places.tolist() == order.tolist() and best.tolist() == scores[order].tolist()
    assert sum(v == 0 for v in touched.values()) >= 20
