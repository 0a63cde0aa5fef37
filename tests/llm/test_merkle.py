"""The manifest against a tree built level by level in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexicade.llm import merkle
from lexicade.llm.stage import Stage
from tests.llm.conftest import CLASHING, SCHEMA

LOW = {i: i + 32 for i in range(65, 91)}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def proofs(leaves, arity):
    """Root, and per leaf the list of (left, right) siblings."""
    at, paths = list(range(len(leaves))), [[] for _ in leaves]
    level = list(leaves)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // arity * arity
            paths[i].append(("".join(level[run:a]), "".join(level[a + 1: run + arity])))
        at = [a // arity for a in at]
        level = [H(*level[i: i + arity]) for i in range(0, len(level), arity)]
    return (level[0] if level else None), paths


def manifest(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r[0], r[3], r[2], r[4], r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        own = sorted(groups[g], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *proofs([d for _, d in own], arity)))
    root, above = proofs([t[1] for t in trees], arity)
    out = []
    for (own, subroot, paths), up in zip(trees, above):
        for (r, d), path in zip(own, paths):
            doc_id, text, lang, source, n_chars = r
            folded = d
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                folded = leaf(doc_id, source, lang, n_chars, text.translate(LOW))
            for left, right in path + up:
                folded = H(left, folded, right)
            proof = H(*[x for pair in path + up for x in pair])
            out.append((doc_id, d, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def found(df, spark, **how):
    got = merkle.manifest(df, Stage(spark), **how)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r[n] for n in names) for r in got.collect()], key=repr)


@pytest.mark.parametrize("levels, per_part", [(5, 20_000), (1, 13), (2, 50)])
def test_given_and_odd_rows(spark, corpus, levels, per_part):
    rows = [tuple(r) for r in corpus.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = manifest(rows)
    assert found(corpus, spark, shape=merkle.Shape(8, levels), per_part=per_part) == want
    assert {v[-1] for v in want} == {True, False}


@pytest.mark.parametrize("n, arity, levels", [(1, 8, 5), (2, 8, 1), (8, 8, 1), (9, 8, 1), (65, 8, 1), (30, 2, 2), (27, 3, 1)])
def test_sizes_around_full_runs(spark, n, arity, levels):
    rows = [(i, f"Text {i}", "en" if i % 7 else None, "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, spark, shape=merkle.Shape(arity, levels), per_part=5) == manifest(rows, arity)


def test_a_group_per_row_and_one_hot_group(spark):
    rows = [(i, "A", f"l{i:03d}" if i < 100 else "hot", "s", 1) for i in range(300)]
    rows += [(299, "A", "hot", "s", 1)] * 20  # equal rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, spark, shape=merkle.Shape(8, 1), per_part=11) == manifest(rows)


def test_tampering_is_seen_only_where_letters_change(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 0][:4]
    rows = [(ids[0], "UPPER", "en", "s", 1), (ids[1], "lower", "en", "s", 1), (ids[2], None, "en", "s", 1),
            (ids[3], "É 1", "en", "s", 1)]
    got = found(spark.createDataFrame(rows, SCHEMA), spark)
    assert {r[0]: r[-1] for r in got} == {ids[0]: False, ids[1]: True, ids[2]: True, ids[3]: True}


def test_queue_stays_small(monkeypatch):
    """Within a block no more than one run a level waits."""
    import pyarrow as pa

    most = []
    real = merkle.heapq.heappush

    def push(queue, item):
        real(queue, item)
        most.append(len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", push)
    n, shape = 5000, merkle.Shape(levels=5)  # one block
    batch = pa.record_batch([pa.array(["g"] * n), pa.array([n] * n), pa.array([0] * n), pa.array(range(n)),
                             pa.array(["d"] * n)], names=["g", "n", "block", "idx", "digest"])
    nodes = sum(b.num_rows for b in merkle._forward(shape)(iter([batch])))
    assert nodes == 625 + 79 + 10 + 2 + 1 and max(most) <= 8 * shape.levels


def test_empty_table(spark, empty):
    assert found(empty.withColumns({c: F.lit("x") for c in CLASHING}), spark) == []
