"""Models on a small separable corpus."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexicade.operators import corpus as oc
from lexicade.operators import models as mo
from lexicade.sources.artifacts import Store


@pytest.fixture(scope="module")
def data(spark):
    rows = [
        (i, i % 2, Vectors.sparse(3, {0: 1.0, 1 + (i % 2 if i % 10 else 1 - i % 2): 1.0}))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    return oc.stratified_split(df).persist()


@pytest.mark.parametrize("kind", mo.MODELS)
def test_model_learns_and_survives_storage(spark, data, kind):
    model = mo.fit_model(kind, data.where("split = 'train'"))
    held = data.where("split <> 'train'")
    scored = mo.predict(model, held, kind)
    right = (F.col("probability") > 0.5).cast("int") == F.col("true_label")
    row = scored.agg(F.avg(right.cast("double")), F.min("probability"), F.max("probability"),
                     F.count("*")).first()
    assert row[0] > 0.8 and 0 < row[1] < 0.5 < row[2] < 1 and row[3] == held.count()
    path = Store(spark).path("model", kind=kind)
    mo.save_model(spark, model, path)
    again = mo.predict(mo.load_model(spark, path), held, kind)
    assert again.exceptAll(scored).isEmpty()


def test_vectors_and_zero_rows(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    cells = spark.createDataFrame([(1, 2, 0.5), (1, 0, 1.0)],
                                  "doc_id long, idx long, value double")
    store = Store(spark)
    stored = mo.feature_vectors(docs, cells, 4, store, n=1)
    vectors = mo.as_ml_vectors(spark, store.path("features", size=4, n=1), stored.schema)
    got = {r.doc_id: r.features for r in vectors.collect()}
    assert got[1] == Vectors.sparse(4, {0: 1.0, 2: 0.5}) and got[2].numNonzeros() == 0


def test_store_builds_once_and_keys_all_parameters(spark):
    store, built = Store(spark), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert store.table(lambda: build(3), "t", n=3).count() == 3
    assert store.table(lambda: build(3), "t", n=3).count() == 3
    assert store.table(lambda: build(4), "t", n=4).count() == 4
    assert built == [3, 4]
    assert store.path("t", w=0.2) != store.path("t", w=0.0)


def test_runs_report_what_they_did(spark):
    """A series with a run that has too few features, runs side by side."""
    from dataclasses import replace

    from lexicade.plans import experiments as ex
    from lexicade.plans.representation import Source

    src = Source("/root/testdata/sf0.001", min_df=5, n_range=(1, 1))
    spec = ex.Spec("s", "plain", src, "logreg", "bow", 0.0)
    specs = [spec, replace(spec, name="again", weighting="tfidf"), replace(spec, name="bare", z=99.0)]
    preds, failed = ex.run_experiments(spark, specs, Store(spark), parallelism=3)
    assert failed == {"bare": "fewer than two features"}
    got = preds.groupBy("model").agg(F.count("*").alias("n"), F.min("elapsed_s").alias("t")).collect()
    assert {r.model for r in got} == {"plain", "again"} and len({r.n for r in got}) == 1
    assert all(r.t > 0 for r in got)


def test_store_can_be_dropped(spark):
    store = Store(spark)
    store.table(lambda: spark.range(2), "t", n=2)
    path = store.path("t", n=2)
    store.drop()
    assert not store.exists(path)
