"""Queries over the corpus, its n-grams and their scores."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import sql as s
from catalog.registry import register, rounded
from lexicade.functions import text as tx
from lexicade.operators import corpus as oc
from lexicade.operators import scoring as sc
from lexicade.operators import vocabulary as vo
from lexicade.operators.coding import gram_sums, merged, spell
from lexicade.operators.joins import dealt
from lexicade.operators.weighting import inverse_frequency, tfidf as tfidf_weights
from lexicade.plans import representation as rp
from lexicade.plans.corpus import all_tokens, split_assignments, split_corpus
from lexicade.sources.artifacts import Store
from lexicade.sources.corpus import TOKEN_COLUMNS, load_corpus, read_split, write_splits

COLUMNS = TOKEN_COLUMNS
_KEY = ("doc_id", "label", "split")


def _counts(spark, src, store, split=None):
    # counted by document without a further shuffle
    docs = rp.source_documents(spark, src, store, split).repartition("doc_id")
    return vo.term_counts(docs, "tokens", src.n_range, ("doc_id", "label", "split"))


def _train_size(spark, src, store):
    return F.lit(rp.train_size(spark, src, store))


def _class_counts(spark, src, store):
    return rp.unit_class_counts(spark, src, store)


def _scored(spark, folder, store, **options):
    return rp.unit_features(spark, rp.Source(folder, **options), store)


# ----------------------------------------------------------------- corpus ----
@register("corpus_load", s.with_(s.CORPUS) + "SELECT doc_id, text, label FROM corpus")
def corpus_load(spark, folder):
    return load_corpus(spark, folder)


@register("dedup_exact", s.with_(s.CORPUS, s.UNIQUE) + "SELECT doc_id, text, label FROM uniq")
def dedup_exact(spark, folder):
    return oc.drop_duplicate_texts(load_corpus(spark, folder))


@register("dedup_report", s.with_(s.CORPUS) + """SELECT count(*) AS rows_in,
  count(DISTINCT text) AS rows_kept, count(*) - count(DISTINCT text) AS rows_removed FROM corpus""")
def dedup_report(spark, folder):
    return oc.duplicate_report(load_corpus(spark, folder))


@register("split_stratified", s.with_(*s.split_corpus()) +
          "SELECT doc_id, label, split FROM split")
def split_stratified(spark, folder):
    return split_assignments(spark, folder, Store(spark)).select("doc_id", "label", "split")


@register("split_profile", s.with_(*s.split_corpus()) + """SELECT split, label,
  count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
  FROM split GROUP BY split, label""")
def split_profile(spark, folder):
    return rounded(oc.split_profile(split_assignments(spark, folder, Store(spark))), "share")


@register("split_preview", s.with_(*s.split_corpus()) + """SELECT doc_id, text, label, split
  FROM split QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id) <= 5""")
def split_preview(spark, folder):
    return oc.first_rows(split_corpus(spark, folder, Store(spark))).select(
        "doc_id", "text", "label", "split")


@register("corpus_roundtrip", s.with_(
    *s.token_docs("tokens_cased"),
    f"""cols AS (SELECT doc_id, label, split, {s.clean('text')} AS text_clean,
      {s.tokens(s.expand(s.clean('text')))} AS c FROM split)""",
) + f"""SELECT split, label, count(*) AS n_docs, sum(length(text_clean))::BIGINT AS n_chars,
  sum(len(c))::BIGINT AS n_cased, sum(len({s.filtered(s.lower('c'))}))::BIGINT AS n_filtered,
  sum(len({s.letters(s.lower('c'))}))::BIGINT AS n_letters, sum(len(c))::BIGINT AS n_stemmed,
  sum(len(c))::BIGINT AS n_lemmatized FROM cols GROUP BY split, label""")
def corpus_roundtrip(spark, folder):
    store = Store(spark)
    docs = split_corpus(spark, folder, store)
    path = store.path("corpus", folder=folder)
    write_splits(all_tokens(docs, store, folder=folder), path)
    parts = [
        read_split(spark, path, name, (
            "split", "label", "text_clean", "tokens_cased", "tokens_filtered",
            "tokens_letters", "tokens_stemmed", "tokens_lemmatized"))
        for name in oc.SPLITS
    ]
    stored = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sizes = [F.sum(F.size(f"tokens_{c}")).alias(f"n_{c}")
             for c in ("cased", "filtered", "letters", "stemmed", "lemmatized")]
    return stored.groupBy("split", "label").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text_clean")).alias("n_chars"), *sizes)


# ------------------------------------------------------------- vocabulary ----
@register("term_counts", s.with_(*s.token_docs(), s.term_counts()) +
          "SELECT doc_id, label, split, term, cnt FROM cnts")
def term_counts(spark, folder):
    return _counts(spark, rp.Source(folder), Store(spark))


@register("vocabulary", s.with_(*s.features()) +
          "SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df FROM feats")
def vocabulary(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    return vo.indexed_vocabulary(_class_counts(spark, src, store).select("term", "df"))


@register("count_matrix", s.with_(*s.features()) + """SELECT c.doc_id, c.label, c.split, c.term,
  c.cnt, f.df FROM cnts c JOIN feats f USING (term)""")
def count_matrix(spark, folder):
    return rp.unit_matrix(spark, rp.Source(folder), Store(spark))


@register("vocab_transform", s.with_(*s.features("tokens_cased", 2)) + """SELECT c.doc_id,
  c.split, c.term, c.cnt FROM cnts c JOIN feats f USING (term) WHERE c.split <> 'train'""")
def vocab_transform(spark, folder):
    src = rp.Source(folder, token_col="tokens_cased", n_range=(1, 2))
    store = Store(spark)
    vocab = store.table(
        lambda: vo.vocabulary(_counts(spark, src, store, "train"),
                              _train_size(spark, src, store)), "vocabulary", **src.key())
    held = _counts(spark, src, store).where("split <> 'train'")
    docs = rp.source_documents(spark, src, store).where("split <> 'train'")
    return vo.apply_vocabulary(held, vocab, rows=vo.terms_at_most(docs, "tokens", src.n_range)).select("doc_id", "split", "term", "cnt")


@register("stop_units", s.with_(*s.token_docs(), s.term_counts()) + """
  SELECT term, df_pos, df_neg, round(df_pos / n_pos, 6) AS share_pos,
    round(df_neg / n_neg, 6) AS share_neg
  FROM (SELECT term, count(*) FILTER (WHERE label = 1) AS df_pos,
          count(*) FILTER (WHERE label <> 1) AS df_neg FROM cnts GROUP BY term),
       (SELECT count(*) FILTER (WHERE label = 1) AS n_pos,
          count(*) FILTER (WHERE label <> 1) AS n_neg FROM split)
  WHERE df_pos / n_pos > 0.3::DOUBLE AND df_neg / n_neg > 0.3::DOUBLE""")
def stop_units(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    docs = rp.assignments(spark, src, store)
    coded = rp.coded_by(spark, src, store, "stop_words", lambda rows: vo.stop_words(rows, docs))
    if coded is None:
        return rounded(vo.stop_units(_counts(spark, src, store), docs), "share_pos", "share_neg")
    sums = gram_sums(merged(coded[0], _KEY), src.n_range)
    stops = spell(vo.stops(sums, docs, unit="gram"), coded[1])
    return rounded(stops.select("term", "df_pos", "df_neg", "share_pos", "share_neg"), "share_pos", "share_neg")


@register("rare_units", s.with_(*s.token_docs(), s.term_counts()) +
          "SELECT term, sum(cnt)::BIGINT AS total FROM cnts GROUP BY term HAVING sum(cnt) < 10")
def rare_units(spark, folder):
    return vo.rare_units(_counts(spark, rp.Source(folder), Store(spark)))


@register("informative_units", s.with_(*s.token_docs(), s.term_counts()) + """
  SELECT term, total::BIGINT AS total
  FROM (SELECT term, sum(cnt) AS total, count(*) FILTER (WHERE label = 1) AS df_pos,
          count(*) FILTER (WHERE label <> 1) AS df_neg FROM cnts GROUP BY term),
       (SELECT count(*) FILTER (WHERE label = 1) AS n_pos,
          count(*) FILTER (WHERE label <> 1) AS n_neg FROM split)
  WHERE total >= 10 AND NOT (df_pos / n_pos > 0.3::DOUBLE AND df_neg / n_neg > 0.3::DOUBLE)""")
def informative_units(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    docs = rp.assignments(spark, src, store)
    coded = rp.coded_by(spark, src, store, "used_words", vo.frequent_uses)
    if coded is None:
        return vo.informative_units(_counts(spark, src, store), docs)
    sums = gram_sums(merged(coded[0], _KEY), src.n_range).withColumn("total", F.col("c_pos") + F.col("c_neg"))
    return spell(vo.informative(sums, docs, unit="gram"), coded[1]).select("term", "total")


# ---------------------------------------------------------------- z-scores ---
@register("class_counts", s.with_(*s.features()) + "SELECT term, df, c_pos, c_neg FROM feats")
def class_counts(spark, folder):
    return _class_counts(spark, rp.Source(folder), Store(spark))


@register("zscores", s.with_(*s.z_features()) + f"""SELECT term, df, c_pos, c_neg,
  {s.r6('logodds')} AS logodds, {s.r6('z')} AS z FROM z""")
def zscores(spark, folder):
    return rounded(_scored(spark, folder, Store(spark)), "logodds", "z")


@register("zscore_filter", s.with_(*s.z_features()) + """SELECT t.threshold, term FROM z,
  (SELECT unnest([0.0, 1.0, 2.0, 3.0, 4.0])::DOUBLE AS threshold) t WHERE abs(z) > threshold""")
def zscore_filter(spark, folder):
    store = Store(spark)
    return store.table(lambda: sc.kept_lists(_scored(spark, folder, store)), "kept", folder=folder)


@register("keep_union", s.with_(*s.z_features()) +
          "SELECT term FROM z WHERE z > 2 UNION SELECT term FROM z WHERE -z > 2")
def keep_union(spark, folder):
    store = Store(spark)
    scored = store.table(lambda: _scored(spark, folder, store), "scored", folder=folder)
    return sc.keep_either_class(scored, 2.0)


def _swept(col: str) -> list[str]:
    """Token lists of the training split; its vocabulary is the dictionary of lemmas."""
    if col in ("tokens_stemmed", "tokens_lemmatized"):
        return s.mapped_docs(col, "split = 'train'")
    return s.token_docs(col)


def sweep_sql() -> str:
    parts = []
    for col in COLUMNS:
        parts.append("SELECT * FROM (" + s.with_(*_swept(col), s.term_counts(), s.FEATURES, s.Z) + f"""SELECT
          '{col}' AS token_col, threshold, count(*) AS base_size,
          count(*) FILTER (WHERE z > threshold) AS kept_pos,
          count(*) FILTER (WHERE -z > threshold) AS kept_neg,
          count(*) FILTER (WHERE abs(z) > threshold) AS kept
          FROM z, (SELECT unnest([0.0, 1.0, 2.0, 3.0, 4.0])::DOUBLE AS threshold)
          GROUP BY threshold)""")
    return " UNION ALL ".join(parts)


@register("zscore_sweep", sweep_sql())
def zscore_sweep(spark, folder):
    store = Store(spark)
    rp.prepared_corpus(spark, folder, store)

    def swept(col):
        scored = rp.unit_features(spark, rp.Source(folder, token_col=col), store)
        return sc.threshold_sweep(scored.withColumn("token_col", F.lit(col)), by=["token_col"])

    with ThreadPool(3) as pool:  # the columns are independent of each other
        return reduce(DataFrame.unionByName, pool.map(swept, COLUMNS, chunksize=1))


def _depth_sql() -> str:
    parts = [
        "SELECT * FROM (" + s.with_(*s.z_features("tokens_lower", n)) +
        f"SELECT {n} AS max_n, count(*) AS base_size, "
        "count(*) FILTER (WHERE abs(z) > 2) AS pruned_size FROM z)" for n in (1, 2, 3)]
    return " UNION ALL ".join(parts)


@register("ngram_depth", _depth_sql())
def ngram_depth(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    return sc.ngram_depth(_class_counts(spark, src, store))


@register("top_features", s.with_(*s.z_features()) + f"""SELECT "class", rank, term,
  replace(term, ' ', '_') AS label, {s.r6('z')} AS z FROM (
    SELECT *, row_number() OVER (PARTITION BY "class" ORDER BY strength DESC, term) AS rank FROM (
      SELECT 'Positive' AS "class", term, z, round(z, 6) AS strength FROM z UNION ALL
      SELECT 'Negative', term, z, round(-z, 6) FROM z)) WHERE rank <= 15""")
def top_features(spark, folder):
    scored = rounded(_scored(spark, folder, Store(spark)), "z")
    return rounded(sc.top_features(scored), "z")


@register("keep_discard_report", s.with_(*s.z_features()) + """SELECT "group", rank,
  replace(term, ' ', '_') AS label, abs(z) AS weight, group_total FROM (
    SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY o, term) AS rank,
      count(*) OVER (PARTITION BY "group") AS group_total FROM (
      SELECT *, CASE WHEN "group" = 'neutral' THEN abs(z) ELSE -abs(z) END AS o FROM (
        SELECT term, round(z, 6) + 0.0 AS z, CASE WHEN round(z, 6) > 2 THEN 'positive'
          WHEN round(z, 6) < -2 THEN 'negative' ELSE 'neutral' END AS "group" FROM z)))
  WHERE rank <= 150""")
def keep_discard_report(spark, folder):
    store = Store(spark)
    scored = store.table(
        lambda: rounded(_scored(spark, folder, store), "z"), "scored", folder=folder)
    return sc.keep_discard_report(scored)


# ----------------------------------------------------------------- weights ---
@register("select_features", s.with_(*s.z_features()) + """SELECT c.doc_id, c.split, c.term, c.cnt
  FROM cnts c JOIN z USING (term) WHERE abs(z.z) > 2""")
def select_features(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    kept = store.table(
        lambda: sc.keep_features(rp.unit_features(spark, src, store), 2.0), "kept", **src.key())
    chosen = sc.select_columns(rp.unit_matrix(spark, src, store).drop("df"), kept)
    return chosen.select("doc_id", "split", "term", "cnt")


_TFIDF = """raw AS (SELECT c.doc_id, c.split, c.term,
    c.cnt * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + f.df)) + 1.0::DOUBLE) AS x
  FROM cnts c JOIN feats f USING (term),
       (SELECT count(*) AS n FROM split WHERE split = 'train'))"""


@register("tfidf", s.with_(*s.features(), _TFIDF) + f"""SELECT doc_id, split, term,
  {s.r6('x / sqrt(sum(x * x) OVER (PARTITION BY doc_id))')} AS weight FROM raw""")
def tfidf(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    matrix = dealt(rp.unit_matrix(spark, src, store), "doc_id")
    weighted = tfidf_weights(inverse_frequency(matrix, _train_size(spark, src, store)))
    return rounded(weighted.select("doc_id", "split", "term", "weight"), "weight")


@register("representation", s.with_(
    *s.z_features(),
    """kept AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx
      FROM z WHERE abs(z) > 2)""",
) + "SELECT doc_id, split, idx, df, cnt FROM cnts JOIN kept USING (term)")
def representation(spark, folder):
    return rp.load_representation(spark, rp.Source(folder), Store(spark), z=2.0).cells
