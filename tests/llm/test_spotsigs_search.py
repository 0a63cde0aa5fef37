"""Similar documents against all pairs of fingerprints."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicade.llm.setjoin import size_bounds
from lexicade.llm.spotsigs import signatures
from lexicade.llm.spotsigs_search import similar_documents


def all_pairs(rows, least):
    """(doc_id, text) with class, rows of the class and links, by every pair of fingerprints."""
    texts = [t or "" for _, t in rows]
    s, of = signatures(pa.array(texts, pa.large_string()))
    sets = [set() for _ in texts]
    for x, i in zip(s.tolist(), of.tolist()):
        sets[i].add(x)
    nodes = {}
    for i, x in enumerate(sets):
        nodes.setdefault(frozenset(x), []).append(i)
    names = list(nodes)
    links, root = [0] * len(names), list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            both = len(a & names[j])
            if both >= least * (len(a) + len(names[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = {}
    for i, name in enumerate(names):
        classes.setdefault(find(i), []).extend(nodes[name])
    out = []
    for i, name in enumerate(names):
        members = classes[find(i)]
        ids = [rows[k][0] for k in members]
        best = min((x for x in ids if x is not None), default=None)
        out += [(rows[k][0], best, len(members), links[i]) for k in nodes[name]]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.class_id, r.n_class, r.n_links) for r in df.collect()), key=str)


def edits(seed=5, families=12, copies=9):
    """Families of texts that differ in a few words, of several lengths, with exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for f in range(families):
        base = [w for _ in range(rng.choice([4, 12, 40, 120]))
                for w in (rng.choice(["the", "of", "and"]), *rng.sample(words, rng.choice([1, 2, 3])))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            cut = rng.choice([0, 0, len(text) // 9])
            rows.append((len(rows), " ".join(text[cut:])))
    return rows


@pytest.mark.parametrize("least,elements", [(0.8, 1 << 20), (0.8, 300), (0.5, 1000)])
def test_links_are_those_of_all_pairs(spark, stage, least, elements):
    rows = edits()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = all_pairs(rows, least)
    assert any(n > 3 for *_, n in want)
    assert found(similar_documents(docs, stage, least=least, elements=elements)) == want


def test_given_documents_and_odd_rows(corpus, rows, stage):
    got = similar_documents(corpus, stage)
    assert got.columns == ["doc_id", "text_hash", "class_id", "n_class", "n_links"]
    assert found(got) == all_pairs(rows, 0.8)


def test_hot_signature_is_dealt_into_blocks(spark, stage):
    """Texts that share one passage and nothing else meet, but are not similar."""
    shared = "the alpha beta gamma of delta epsilon zeta "
    rows = [(i, shared + " ".join(f"and {i}a{k} {i}b{k} {i}c{k}" for k in range(i % 3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(similar_documents(docs, stage, elements=20)) == all_pairs(rows, 0.8)


def test_sizes_two_classes_apart_are_never_similar():
    for least in (0.5, 0.8, 0.9):
        bounds = size_bounds(least, 5000)
        for low, high in zip(bounds, bounds[2:]):
            following = bounds[bounds.index(low) + 1] - 1  # largest size of the lower class
            assert following < least * high


def test_empty_table_and_bounds(spark, stage, empty):
    assert similar_documents(empty, stage).count() == 0
    with pytest.raises(ValueError):
        similar_documents(empty.withColumn("x", F.lit(1)), stage, least=0)
