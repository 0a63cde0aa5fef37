"""Queries over texts, tokens and run names."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as s
from catalog.inputs import noisy_documents, predictions
from catalog.registry import register
from lexicade.functions import text as tx
from lexicade.functions.naming import parse_with_defaults
from lexicade.operators.lemmas import lemma_table, lemmatize
from lexicade.plans.corpus import all_tokens, native_tokens
from lexicade.sources.artifacts import Store
from lexicade.sources.corpus import load_documents, spread_small

COMPATIBLE, COMPOSED = " ﬁne ½ Ａé", " fine 1⁄2 Aé"
SPACED = "    \t end 　"


@register("text_nfkc", f"SELECT doc_id, text || {s.q(COMPOSED)} AS text FROM documents")
def text_nfkc(spark, folder):
    raw = F.encode(F.concat("text", F.lit(COMPATIBLE)), "UTF-8")
    return load_documents(spark, folder).select(
        "doc_id", tx.nfkc(tx.decode_utf8(raw)).alias("text"))


@register("text_typography",
          s.with_(s.NOISY) + f"SELECT doc_id, {s.typography('text')} AS text FROM noisy")
def text_typography(spark, folder):
    return noisy_documents(spark, folder).select("doc_id", tx.unify_typography("text").alias("text"))


@register("text_strip_tags", f"SELECT page_id, {s.strip_tags('html')} AS text FROM pages")
def text_strip_tags(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html")
    return spread_small(pages, "page_id").select("page_id", tx.strip_tags("html").alias("text"))


_SPACED = " || ".join(f"chr({ord(c)})" for c in SPACED)


@register("text_whitespace",
          f"SELECT doc_id, {s.spaces(f'text || {_SPACED}')} AS text FROM documents")
def text_whitespace(spark, folder):
    return load_documents(spark, folder).select(
        "doc_id", tx.collapse_spaces(F.concat("text", F.lit(SPACED))).alias("text"))


@register("text_clean", s.with_(s.NOISY) + f"SELECT doc_id, {s.clean('text')} AS text FROM noisy")
def text_clean(spark, folder):
    return noisy_documents(spark, folder).select("doc_id", tx.clean_text("text").alias("text"))


@register("text_expand",
          s.with_(s.NOISY) + f"SELECT doc_id, {s.expand(s.clean('text'))} AS text FROM noisy")
def text_expand(spark, folder):
    cleaned = noisy_documents(spark, folder).withColumn("clean", tx.clean_text("text"))
    return cleaned.select("doc_id", tx.expand_contractions("clean").alias("text"))


_CASED = f"cased AS (SELECT doc_id, {s.tokens(s.expand(s.clean('text')))} AS c FROM noisy)"


def _tokens(name: str, expr: str) -> None:
    sql = s.with_(s.NOISY, _CASED) + f"SELECT doc_id, {expr} AS tokens FROM cased"

    @register(name, sql)
    def query(spark, folder):
        return native_tokens(noisy_documents(spark, folder)).select(
            "doc_id", F.col(name).alias("tokens"))


_tokens("tokens_cased", "c")
_tokens("tokens_lower", s.lower("c"))
_tokens("tokens_letters", s.letters(s.lower("c")))
_tokens("tokens_filtered", s.filtered(s.lower("c")))


@register("tokens_stemmed", s.stemmed_documents())
def tokens_stemmed(spark, folder):
    docs = native_tokens(noisy_documents(spark, folder))
    return docs.select("doc_id", tx.stem_tokens("tokens_lower").alias("tokens"))


_LEMMAS = s.with_(
    s.NOISY, _CASED,
    f"lows AS MATERIALIZED (SELECT doc_id, {s.lower('c')} AS t FROM cased)",
    "words AS MATERIALIZED (SELECT DISTINCT unnest(t) AS token FROM lows)",
    f"forms AS ({s.lemma_candidates('words')})",
    """lemmas AS (SELECT f.token, arg_min(f.lemma, length(f.lemma) * 100 + f.o) AS lemma
      FROM forms f JOIN words w ON f.lemma = w.token GROUP BY f.token)""",
    """spread AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM lows)""",
) + """SELECT doc_id, list(coalesce(lemma, token) ORDER BY pos) AS tokens
  FROM spread LEFT JOIN lemmas USING (token) GROUP BY doc_id"""


@register("tokens_lemmatized", _LEMMAS)
def tokens_lemmatized(spark, folder):
    docs = native_tokens(noisy_documents(spark, folder)).select("doc_id", "tokens_lower")
    table = Store(spark).table(
        lambda: lemma_table(docs, "tokens_lower"), "lemmas", folder=folder)
    return lemmatize(docs, table, name="tokens")


@register("representations", s.with_(
    s.NOISY, f"cleaned AS (SELECT doc_id, text, {s.clean('text')} AS text_clean FROM noisy)",
    f"""expanded AS (SELECT *, {s.expand('text_clean')} AS text_expanded FROM cleaned)""",
    f"""cased AS MATERIALIZED (SELECT *, {s.tokens('text_expanded')} AS c FROM expanded)""",
    f"""spread AS MATERIALIZED (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos
      FROM (SELECT doc_id, {s.lower('c')} AS t FROM cased))""",
    "words AS MATERIALIZED (SELECT DISTINCT token FROM spread)",
    f"stems AS MATERIALIZED ({s.porter_steps('words')})",
    f"forms AS ({s.lemma_candidates('words')})",
    """lemmas AS MATERIALIZED (SELECT f.token,
      arg_min(f.lemma, length(f.lemma) * 100 + f.o) AS lemma
      FROM forms f JOIN words w ON f.lemma = w.token GROUP BY f.token)""",
    """mapped AS (SELECT doc_id, list(stem ORDER BY pos) AS stems,
      list(coalesce(lemma, token) ORDER BY pos) AS lemmas
      FROM spread JOIN stems USING (token) LEFT JOIN lemmas USING (token) GROUP BY doc_id)""",
) + f"""SELECT doc_id, text AS text_raw, text_clean, text_expanded, c AS tokens_cased,
  {s.lower('c')} AS tokens_lower, {s.filtered(s.lower('c'))} AS tokens_filtered,
  {s.letters(s.lower('c'))} AS tokens_letters, stems AS tokens_stemmed,
  lemmas AS tokens_lemmatized FROM cased JOIN mapped USING (doc_id)""")
def representations(spark, folder):
    return all_tokens(noisy_documents(spark, folder), Store(spark), folder=folder)


@register("ngrams", s.with_(
    f"lows AS (SELECT doc_id, {s.lower(s.tokens('text'))} AS t FROM documents)",
) + f"SELECT doc_id, {s.grams('t')} AS ngrams FROM lows")
def ngrams(spark, folder):
    low = tx.lower_tokens(tx.tokenize("text"))
    docs = load_documents(spark, folder).select("doc_id", low.alias("t"))
    return docs.select("doc_id", tx.ngrams("t").alias("ngrams"))


@register("space_tokens", "SELECT doc_id, string_split(text, ' ') AS tokens FROM documents")
def space_tokens(spark, folder):
    return load_documents(spark, folder).select("doc_id", tx.split_spaces("text").alias("tokens"))


@register("word_tokens", f"""SELECT doc_id,
  regexp_extract_all(lower(text), {s.q(tx.WORD_PATTERN)}) AS lower_words,
  regexp_extract_all(text, {s.q(tx.WORD_PATTERN)}) AS cased_words FROM documents""")
def word_tokens(spark, folder):
    return load_documents(spark, folder).select(
        "doc_id", tx.word_tokens("text").alias("lower_words"),
        tx.word_tokens("text", lowercase=False).alias("cased_words"))


@register("parse_run_name", s.with_(*s.predictions()) + """SELECT model AS run, count(*) AS n,
  CASE WHEN contains(model, 'svm') OR contains(model, 'SVM') THEN 'linear_svm'
       ELSE 'logreg' END AS model,
  coalesce(nullif(regexp_extract(model, '(text_raw|text_clean|text_expanded|tokens_[a-z]+)', 1),
    ''), 'tokens_lower') AS token_col,
  coalesce(nullif(regexp_extract(model, '(?:^|_)ng(\\d+-\\d+)(?:_|$)', 1), ''), '1-3') AS ngram,
  coalesce(try_cast(regexp_extract(model, '(?:^|_)k(\\d+)(?:_|$)', 1) AS INT), 0) AS k,
  coalesce(try_cast(regexp_extract(model, '(?:^|_)[zZ](\\d+(?:[.]\\d+)?)(?:_|$)', 1) AS DOUBLE),
    2.0) AS z,
  coalesce(try_cast(regexp_extract(model, '(?:^|_)w(\\d+(?:[.]\\d+)?)(?:_|$)', 1) AS DOUBLE),
    0.0) AS w
  FROM preds GROUP BY model""")
def parse_run_name(spark, folder):
    runs = predictions(spark, folder).groupBy(F.col("model").alias("run")).agg(
        F.count("*").alias("n"))
    parsed = parse_with_defaults("run")
    return runs.select("run", "n", *[c.alias(n) for n, c in parsed.items()])


@register("predict_label", s.with_(*s.predictions("run_n_grams", "bert")) +
          "SELECT model, doc_id, pred FROM hard_labels")
def predict_label(spark, folder):
    return predictions(spark, folder, "run_n_grams", "bert").select(
        "model", "doc_id", tx.predict_label("probability").alias("pred"))


@register("outcome_label", s.with_(*s.predictions("run_n_grams", "bert")) + """
  SELECT model, doc_id, CASE WHEN ok = 1 THEN 'Correctly Classified'
    WHEN pred = 0 AND true_label = 1 THEN 'False Negative'
    WHEN pred = 1 AND true_label = 0 THEN 'False Positive' ELSE 'Unknown' END AS outcome,
  round(abs(probability - 0.5), 6) + 0.0 AS uncertainty FROM hard_labels""")
def outcome_label(spark, folder):
    return predictions(spark, folder, "run_n_grams", "bert").select(
        "model", "doc_id", tx.outcome_label("probability", "true_label").alias("outcome"),
        (F.round(tx.uncertainty("probability"), 6) + 0.0).alias("uncertainty"))
