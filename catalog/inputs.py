"""Inputs that the registered queries derive from the given tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicade.sources.corpus import TOKEN_COLUMNS, load_corpus, load_documents

# markup, typography and contractions, appended to every given text
NOISE = (
    " I don't like it… <br />It’s “bad” — really, we’re  gonna <b class='x'>LEAVE</b> "
    "`now`. Can't you see (they've said) „so“? DON'T − never ‘don’t go’ 'it's' ''fine''"
)

MODELS = ("linear_svm", "logreg")
BASELINE = "text_expanded_lower_TF-IDF_linear_svm"
SPECIALIST = "bert_basic_baseline"
BASE = "Base_SVM"
THRESHOLD = 0.254


def run_names(*experiments: str) -> list[tuple[str, str]]:
    """(experiment, model) of every run of the given series."""
    series = {
        "run_basic": [
            f"{t}_{c}_{r}_{m}" for t, c, r, m in product(
                ("text_clean", "text_expanded"), ("lower", "cased"), ("BoW", "TF-IDF"), MODELS)],
        "run_on_preprocessing": [
            f"{t}_{r}_{m}" for t, r, m in product(TOKEN_COLUMNS, ("BoW", "TF-IDF"), MODELS)],
        "run_custom": [
            f"{t}_{r}_Z{z}_{m}" for t, r, z, m in product(
                TOKEN_COLUMNS, ("CustomBow", "CustomTfidf"), range(5), MODELS)],
        "run_n_grams": [f"ng{r}_{m}" for r, m in product(("1-1", "1-2", "1-3"), MODELS)],
        "grid_search": [
            f"{m}_k{k}_w{w}" for m, k, w in product(MODELS, (0, 500, 5000, 10000), (0, 1, 10))
            if k or not w],
        "params": [
            f"{m}_ng{g}_k{k}_z{z}_w{w}" for m, g, k, z, w in product(
                MODELS, ("1-1", "1-3"), (0, 500), ("0.0", "2.0", "2.5"), (0, 10))],
        "bert": [SPECIALIST],
        "cascade": [BASE, "Base_LogReg", "SVM_Specialist", "BERT_Basic", "BERT_Specialist"],
    }
    return [(e, m) for e in experiments or series for m in series[e]]


def predictions(spark: SparkSession, folder: str, *experiments: str) -> DataFrame:
    """Deterministic predictions of every run for every labelled document.

    The probability is a multiple of 1/1000 (edges such as 0, 0.254, 0.5 and 1 do
    occur) taken from a hash of the run name and the whole text; each run has its own
    skill, the share of documents for which it leans to the true label.
    """
    runs = F.array(*[
        F.struct(F.lit(e).alias("experiment"), F.lit(m).alias("model"))
        for e, m in run_names(*experiments)
    ])
    docs = load_corpus(spark, folder).select(
        "doc_id", "label", F.md5("text").alias("t"), F.explode(runs).alias("run"))
    rows = docs.select("run.*", "doc_id", F.col("label").alias("true_label"), "t")
    h = F.md5(F.concat_ws(":", "model", "t", F.col("doc_id").cast("string")))

    def number(text, start: int):
        return F.conv(F.substring(text, start, 6), 16, 10).cast("int")

    u = F.pmod(number(h, 1), F.lit(1001))
    leans = F.pmod(number(h, 7), F.lit(100)) < 55 + F.pmod(number(F.md5("model"), 1), F.lit(40))
    right = F.when(F.col("true_label") == 1, F.greatest(u, 1000 - u)).otherwise(
        F.least(u, 1000 - u))
    p = F.when(leans, right).otherwise(u) / F.lit(1000.0)
    return rows.select("experiment", "model", "doc_id", "true_label", p.alias("probability"))


def noisy_documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_documents(spark, folder).select(
        "doc_id", F.concat("text", F.lit(NOISE)).alias("text"))
