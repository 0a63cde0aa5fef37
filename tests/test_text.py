"""Worked text examples."""

import pytest
from pyspark.sql import functions as F

from lexicade.functions import naming
from lexicade.functions import text as tx
from lexicade.functions.stemming import porter_stem
from lexicade.operators.lemmas import lemma_table, lemmatize


def one(spark, value, expr, type_="string"):
    df = spark.createDataFrame([(value,)], f"x {type_}")
    return df.select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("watch them again.<br /><br /> However i have", "watch them again. However i have"),
    ("‘a’ “b” — c – d … e", "'a' \"b\" - c - d ... e"),
    ("ﬁne  ½", "fine 1⁄2"),
    ("  \t\n", ""),
])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, tx.clean_text) == want


def test_typography_alone(spark):
    assert one(spark, "´ ’ ‘ ` „x” …\x96\x97−", tx.unify_typography) == "' ' ' ' \"x\" ...---"


@pytest.mark.parametrize("raw, want", [
    ("i didn't like it", "i did not like it"),
    ("Don't. I'm here, it's 'cause", "Do not. I am here, it is because"),
    ("no apostrophe at all", "no apostrophe at all"),
    ("we're gonna go", "we are going to go"),
    ("the 80's Kindred's tale", "the 80's Kindred's tale"),
    ("CAN'T", "Cannot"),
])
def test_expand_contractions(spark, raw, want):
    assert one(spark, raw, tx.expand_contractions) == want


def test_long_text_expands_like_words(spark):
    raw = " ".join(["word"] * 5000 + ["don't", "x"]) * 3
    assert one(spark, raw, tx.expand_contractions) == raw.replace("don't", "do not")


def test_tokens_and_letters(spark):
    text = "re-watched the 80's... A.S.A.P.!"
    cased = one(spark, text, tx.tokenize)
    assert cased == ["re-watched", "the", "80", "'s", "...", "A", ".", "S", ".", "A", ".", "P",
                     ".", "!"]
    got = one(spark, cased, lambda c: tx.letter_tokens(tx.lower_tokens(c)), "array<string>")
    assert got == ["rewatched", "the", "s", "a", "s", "a", "p"]


def test_part_of_speech_filter(spark):
    text = "I have got myself quite a proud collection with many more titles on my list !"
    tokens = text.lower().split()
    kept = one(spark, tokens, tx.content_tokens, "array<string>")
    assert [t for t in tokens if t not in kept] == ["have", "a", "many", "my"]
    assert one(spark, ["can", "will", "must"], tx.content_tokens, "array<string>") == [
        "can", "will", "must"]


def test_ngrams_order_and_short_lists(spark):
    tokens = "it is a fun movie .".split()
    got = one(spark, tokens, tx.ngrams, "array<string>")
    assert got[:6] == tokens
    assert got[6:11] == ["it is", "is a", "a fun", "fun movie", "movie ."]
    assert got[11:] == ["it is a", "is a fun", "a fun movie", "fun movie ."]
    assert one(spark, ["x"], tx.ngrams, "array<string>") == ["x"]
    assert one(spark, [], tx.ngrams, "array<string>") == []


# published pairs of the algorithm
@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"),
    ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
    ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"),
    ("digitizer", "digit"), ("vietnamization", "vietnam"), ("hopefulness", "hope"),
    ("triplicate", "triplic"), ("formalize", "formal"), ("goodness", "good"),
    ("adjustable", "adjust"), ("adoption", "adopt"), ("bowdlerize", "bowdler"),
    ("probate", "probat"), ("cease", "ceas"), ("controlling", "control"), ("skies", "sky"),
    ("is", "is"), ("dying", "die"),
])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_stem_lists_keep_shape(spark):
    df = spark.createDataFrame([(["Runs", "runs"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(tx.stem_tokens("t")).collect()] == [["run", "run"], [], None]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_lemmas_plain_and_salted(spark, limit, tmp_path):
    rows = [(1, ["cats", "cat", "was", "the", "boxes", "box"]), (2, []), (3, ["cats"] * 3 + ["s"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens_lower array<string>")
    lemma_table(docs, "tokens_lower").write.parquet(str(tmp_path / "l"))
    table = spark.read.parquet(str(tmp_path / "l"))
    got = {r[0]: r[1] for r in lemmatize(docs, table, broadcast_rows=limit).collect()}
    assert got == {1: ["cat", "cat", "was", "the", "box", "box"], 2: [], 3: ["cat"] * 3 + ["s"]}


def test_lemmas_with_given_dictionary(spark):
    docs = spark.createDataFrame([(1, ["women", "ladies", "gas"])], "doc_id long, t array<string>")
    words = spark.createDataFrame([("woman",), ("lady",), ("gas",)], "token string")
    got = {r.token: r.lemma for r in lemma_table(docs, "t", words).collect()}
    assert got == {"women": "woman", "ladies": "lady", "gas": "gas"}


def test_run_names(spark):
    def parse(name):
        parsed = naming.parse_with_defaults("n")
        df = spark.createDataFrame([(name,)], "n string")
        return df.select(*[c.alias(k) for k, c in parsed.items()]).first().asDict()

    assert parse("tokens_lower_CustomTfidf_Z2_linear_svm") == {
        "model": "linear_svm", "token_col": "tokens_lower", "ngram": "1-3", "k": 0, "z": 2.0,
        "w": 0.0}
    got = parse("linear_svm_k500_w10")
    assert (got["k"], got["w"]) == (500, 10.0)
    assert parse("ng1-2_logreg")["ngram"] == "1-2"


def test_outcome_and_strict_label(spark):
    df = spark.createDataFrame([(0.5, 1), (0.51, 1), (0.9, 0), (0.1, 0)], "p double, y int")
    got = [r[0] for r in df.select(tx.outcome_label("p", "y")).collect()]
    assert got == ["False Negative", "Correctly Classified", "False Positive",
                   "Correctly Classified"]


@pytest.mark.parametrize("text, want", [
    ("'don't go' and 'it's fine'", "'do not go' and 'it is fine'"), ("''Can't''", "''Cannot''"),
    ("rock 'n' roll", "rock 'n' roll"), ("'quoted'", "'quoted'"),
])
def test_contractions_in_quotes(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.expand_contractions("t").alias("x")).first().x == want
