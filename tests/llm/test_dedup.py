"""Near duplicates against all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexicade.llm import dartminhash as dm
from lexicade.llm.components import components
from lexicade.llm.stage import Stage

LOW = {i: i + 32 for i in range(65, 91)}


def shingled(text):
    w = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", (text or "").translate(LOW))
    return Counter(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({text or "": 1})


def classes(rows):
    """Least row number of every row's component."""
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum((a & sets[j]).values())
            if both >= 0.8 * (sum(a.values()) + sum(sets[j].values()) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def partition(ids, keys):
    groups = {}
    for i, k in zip(ids, keys):
        groups.setdefault(k, []).append(str(i))
    return sorted(sorted(g) for g in groups.values())


def test_classes_are_those_of_all_pairs(corpus, rows, spark):
    got = dm.near_duplicates(corpus, Stage(spark)).collect()
    assert len(got) == len(rows)
    want = classes(rows)
    ids = [i for i, _ in rows]
    least = {}
    for i, k in zip(ids, want):
        least.setdefault(k, []).append(-1 if i is None else i)
    assert sorted(len(v) for v in least.values()) == sorted(
        n for (_, n) in {((r.class_id, r.n_class)): (r.class_id, r.n_class) for r in got}.values())
    known = [(i, k) for i, k in zip(ids, want) if i is not None]
    mine = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    by = {}
    for i, k in known:
        by.setdefault(k, set()).add(mine[i])
    assert all(len(v) == 1 for v in by.values())


def test_group_of_edits_that_only_meet_in_the_middle(spark):
    """Copies far from each other but near one text, more than a block of them."""
    random.seed(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for k in random.sample(range(300), 6):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows.append((99, "something else entirely that shares no words with the others"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows)
    for block in (7, 1000):
        got = {r.doc_id: r.class_id for r in dm.near_duplicates(df, Stage(spark), block=block).collect()}
        assert [got[i] for i, _ in rows] == [rows[k][0] for k in want]


def test_one_of_each_keeps_columns_and_one_row(corpus, rows, spark):
    out = dm.one_of_each(corpus, Stage(spark))
    assert out.columns == corpus.columns
    got = out.collect()
    assert len(got) == len(set(classes(rows)))
    assert sum(r.doc_id in (900_005, 900_006) for r in got) == 1


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    x, y = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    elements = np.concatenate([np.repeat(h, x), np.repeat(h, y)])
    doc = np.repeat([0, 1], [x.sum(), y.sum()])
    s = dm.signatures(elements, doc, 2, 2000)
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert (s != 0).all() and abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 2000)


@pytest.mark.parametrize("n", [1, 50])
def test_chain_is_one_component(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(links, Stage(spark), "c").collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_empty_table(empty, spark):
    assert dm.near_duplicates(empty, Stage(spark)).count() == 0
