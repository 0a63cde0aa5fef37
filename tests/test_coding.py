"""Dictionary-coded n-grams against counting strings, and plans that touch texts once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicade.operators import coding as co
from lexicade.operators import vocabulary as vo
from lexicade.plans import corpus as pc
from lexicade.plans import representation as rp
from lexicade.sources.artifacts import Store

FOLDER = "/root/testdata/sf0.001"
DOCS = [(1, 0, ["a", "b", "a", "b", "zz", "a"]), (2, 1, []), (3, 1, None), (4, 0, ["a"]), (5, 1, ["b", "é", "é", "b"]),
        (6, 0, ["zz"]), (7, 1, ["a", "b"] * 500)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, label int, tokens array<string>")


def words(spark, *some):
    return co.dictionary(spark.createDataFrame([(w,) for w in some], "word string"))


@pytest.mark.parametrize("known", [("a", "b", "é"), ("", "a"), ("a", "b", "zz", "é", "")])
@pytest.mark.parametrize("n_range", [(1, 3), (2, 2), (1, 1)])
def test_counts_are_those_of_strings(spark, docs, known, n_range, monkeypatch):
    monkeypatch.setattr(co, "TOKENS_AT_A_TIME", 3)
    frequent = spark.createDataFrame([(w, 1) for w in known], "word string, df long")
    want = vo.frequent_term_counts(docs, frequent, "tokens", n_range, ("doc_id", "label"))
    got = co.gram_counts(co.code(docs, words(spark, *known), ("doc_id", "label")), n_range, ("doc_id", "label"))
    got = co.spell(got, words(spark, *known)).select("doc_id", "label", "term", "cnt")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_known_grams(spark, docs):
    w = words(spark, "a", "b")
    coded = co.code(docs, w, ("doc_id",))
    known = spark.sparkContext.broadcast(np.array([1, (1 << co.BITS) + 2]))
    got = co.spell(co.gram_counts(coded, (1, 3), ("doc_id",), known), w)
    assert {(r.doc_id, r.term): r.cnt for r in got.collect()} == {
        (1, "a"): 3, (1, "a b"): 2, (4, "a"): 1, (7, "a"): 500, (7, "a b"): 500}
    none = spark.sparkContext.broadcast(np.zeros(0, dtype=np.int64))
    assert co.gram_counts(coded, (1, 3), ("doc_id",), none).isEmpty()


def test_large_dictionaries_are_not_sent(spark):
    frequent = spark.createDataFrame([("a",), ("bb",)], "word string")
    assert co.dictionary(frequent, max_words=1) is None and co.dictionary(frequent, max_bytes=2) is None
    assert co.dictionary(frequent.where("false")).value.to_pylist() == []


def test_units_are_the_same_without_a_dictionary(spark, monkeypatch):
    """The way for vocabularies that are too large gives the same tables."""
    src = rp.Source(FOLDER, min_df=3)
    coded = Store(spark)
    want = [rp.unit_features(spark, src, coded), rp.unit_matrix(spark, src, coded)]
    monkeypatch.setattr(rp, "dictionary", lambda frequent: None)
    strings = Store(spark)
    got = [rp.unit_features(spark, src, strings), rp.unit_matrix(spark, src, strings)]
    assert not got[0].isEmpty() and not got[1].isEmpty()
    for g, w in zip(got, want):
        g = g.select(w.columns)
        assert g.exceptAll(w).isEmpty() and w.exceptAll(g).isEmpty()


def test_texts_are_cleaned_once(spark):
    """With the prepared corpus stored, no further step reads the documents."""
    store, src = Store(spark), rp.Source(FOLDER)
    pc.prepared_corpus(spark, FOLDER, store)
    for df in (rp.source_documents(spark, src, store), rp.source_documents(spark, src, store, "train")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all("/prepared/" in f for f in df.inputFiles()) and "Exchange" not in plan


def test_counting_coded_tokens_sorts_and_shuffles_nothing(spark):
    store, src = Store(spark), rp.Source(FOLDER)
    docs, _ = rp.coded_documents(spark, src, store)
    plan = co.gram_counts(docs, (1, 3), ("doc_id",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("broadcast_rows, moved", [(500_000, 0), (1, 1)])
def test_texts_are_shuffled_only_for_many_ids(spark, broadcast_rows, moved, monkeypatch):
    # as for an input with more splits than cores
    monkeypatch.setattr("lexicade.sources.corpus.spread_small", lambda df, key: df)
    store = Store(spark)
    df = pc.split_corpus(spark, FOLDER, store, broadcast_rows=broadcast_rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert (len(exchanges) > 0) == bool(moved)
    assert df.select("doc_id").exceptAll(pc.split_assignments(spark, FOLDER, store).select("doc_id")).isEmpty()
    assert df.where(F.col("text_nfkc").isNull()).isEmpty()
