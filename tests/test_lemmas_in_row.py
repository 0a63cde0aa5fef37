"""Lemmas made within a row: no shuffle of tokens or texts; repeated keys as before."""

from lexicade.operators import lemmas as le
from lexicade.plans.corpus import all_tokens
from lexicade.sources.artifacts import Store


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark):
    docs = spark.createDataFrame(
        [(1, "a", ["cats", "dogs", None]), (2, "a", []), (3, "a", None), (4, "a", ["cats"]), (4, "a", ["dogs", "x"]),
         (None, "a", ["dogs"]), (None, "a", ["cats"])], "doc_id long, split string, tokens_lower array<string>")
    lemmas = spark.createDataFrame([("cats", "cat", 3), ("dogs", "dogs", 2)], "token string, lemma string, uses long")
    return docs, lemmas


def test_lemmas_within_the_row_are_those_of_tokens_taken_apart(spark):
    docs, lemmas = tables(spark)
    single = docs.where("doc_id < 4")
    assert "Generate" not in plan(le.lemmatize(single, lemmas, keep=["split"]))
    for some in (single, docs):
        got, want = (sorted(map(str, f.collect())) for f in (
            le.lemmatize(some, lemmas, keep=["split"]),
            le._lemmatize_apart(some, lemmas, "tokens_lower", "doc_id", "tokens_lemmatized", ["split"], 10)))
        assert got == want


def test_texts_are_not_shuffled_for_their_lemmas(spark):
    docs = spark.createDataFrame([(1, "The cats and a cat"), (2, None), (3, "cats")], "doc_id long, text string")
    once = all_tokens(docs, Store(spark), folder="once")
    assert "Join" not in plan(once)
    rows = {r.doc_id: r.tokens_lemmatized for r in once.collect()}
    assert rows == {1: ["the", "cat", "and", "a", "cat"], 2: [], 3: ["cat"]}
    # rows of one document get the tokens of all of them, those without a key are left out
    more = docs.unionByName(spark.createDataFrame([(3, "dogs"), (None, "x")], docs.schema))
    both = all_tokens(more, Store(spark), folder="both")
    assert both.columns == once.columns
    assert sorted((r.doc_id, r.text_raw, tuple(r.tokens_lemmatized)) for r in both.where("doc_id = 3").collect()) == [
        (3, "cats", ("cat", "dogs")), (3, "dogs", ("cat", "dogs"))]
    assert both.where("doc_id is null").isEmpty() and both.count() == 4
