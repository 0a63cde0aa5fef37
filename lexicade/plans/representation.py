"""From a token column to a feature matrix, building what is missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexicade.functions import text as tx
from lexicade.operators import concepts as oc
from lexicade.operators.coding import (
    code, dealt_documents, dictionary, gram_counts, gram_sums, grams_at_most, known_gram_counts, spell,
)
from lexicade.operators.joins import join_per_key
from lexicade.operators.models import feature_vectors
from lexicade.operators.ranking import sorted_index
from lexicade.operators.scoring import class_counts, keep_features, z_scores
from lexicade.operators.vocabulary import (
    MAX_DF, MIN_DF, df_limits, frequent_term_counts, frequent_words, known_term_counts,
)
from lexicade.operators.weighting import inverse_frequency, tfidf
from lexicade.plans.corpus import prepared_corpus, split_assignments, token_documents
from lexicade.sources.artifacts import Store


@dataclass(frozen=True)
class Source:
    """Where the units come from and which of them are kept."""

    folder: str
    label: str = "quality"
    token_col: str = "tokens_lower"
    n_range: tuple[int, int] = (1, 3)
    min_df: int = MIN_DF
    max_df: float = MAX_DF

    def key(self) -> dict[str, object]:
        return dict(self.__dict__)


@dataclass(frozen=True)
class Representation:
    """Cells (doc_id, split, idx, df, cnt), documents and the number of features.

    ``store`` and ``key`` say where tables made from it are kept.
    """

    docs: DataFrame
    cells: DataFrame
    size: int
    n_train: int
    store: Store
    key: dict[str, object]


def source_documents(spark: SparkSession, src: Source, store: Store,
                     split: str | None = None) -> DataFrame:
    """Rows (doc_id, label, split, tokens).

    ``token_col`` is a token column, or ``words:<text column>:lower|cased`` for the
    default word tokeniser on a text column.
    """
    if not src.token_col.startswith("words:"):
        return token_documents(spark, src.folder, store, src.token_col, src.label, split)
    _, column, case = src.token_col.split(":")
    docs = prepared_corpus(spark, src.folder, store, src.label, split)
    words = tx.word_tokens(column, lowercase=case == "lower")
    # unlike a token column, a text without words has no unit at all
    present = F.when(F.size(words) > 0, words)
    return docs.select("doc_id", "label", "split", present.alias("tokens"))


def assignments(spark: SparkSession, src: Source, store: Store) -> DataFrame:
    return split_assignments(spark, src.folder, store, src.label)


def train_size(spark: SparkSession, src: Source, store: Store) -> int:
    return assignments(spark, src, store).where("split = 'train'").count()


def coded_documents(spark: SparkSession, src: Source, store: Store) -> tuple[DataFrame, Broadcast] | None:
    """Stored (doc_id, label, split, ids) of all splits, and the words the ids stand for.

    The words are those frequent enough in the training split: no n-gram is in more
    documents than any of its words. None where the dictionary is too large for all tasks.
    """
    return coded_by(spark, src, store, "frequent", lambda docs: frequent_words(
        docs.where("split = 'train'"), "tokens", src.min_df))


def coded_by(
    spark: SparkSession, src: Source, store: Store, kind: str, choose: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, Broadcast] | None:
    """``coded_documents`` for the words that ``choose`` takes from the documents; ``kind`` names the choice."""
    params = {**src.key(), "n_range": None, "max_df": None}
    docs = source_documents(spark, src, store)
    words = dictionary(store.table(lambda: choose(docs), kind, **params))
    if words is None:
        return None
    keep = ("doc_id", "label", "split")
    return store.table(lambda: code(docs, words, keep), "coded", of=kind, **params), words


def _class_counts(spark: SparkSession, src: Source, store: Store) -> DataFrame:
    """(term, df, c_pos, c_neg[, gram]) of the kept units of the training split."""
    n_train = F.lit(train_size(spark, src, store))
    coded = coded_documents(spark, src, store)
    if coded is None:
        train = source_documents(spark, src, store, "train").repartition("doc_id")
        frequent = store.table(lambda: frequent_words(train, "tokens", src.min_df), "frequent",
                               **{**src.key(), "n_range": None, "max_df": None})
        counts = frequent_term_counts(train, frequent, "tokens", src.n_range, ("doc_id", "label"))
        return class_counts(counts, n_train, src.min_df, src.max_df)
    docs, words = coded
    sums = gram_sums(docs.where("split = 'train'"), src.n_range)
    per_gram = sums.where(df_limits(F.col("df"), n_train, src.min_df, src.max_df)).drop("df_pos", "df_neg")
    return spell(per_gram, words).select("term", "df", "c_pos", "c_neg", "gram")


def _stored_counts(spark: SparkSession, src: Source, store: Store) -> DataFrame:
    return store.table(lambda: _class_counts(spark, src, store), "class_counts", **src.key())


def unit_class_counts(spark: SparkSession, src: Source, store: Store) -> DataFrame:
    """Stored (term, df, c_pos, c_neg) of the kept units of the training split."""
    return _stored_counts(spark, src, store).drop("gram")


def _scored_units(spark: SparkSession, src: Source, store: Store) -> DataFrame:
    # scores read the counts twice, for their totals and for themselves
    return store.table(lambda: z_scores(_stored_counts(spark, src, store)), "unit_features", **src.key())


def unit_features(spark: SparkSession, src: Source, store: Store) -> DataFrame:
    """Stored (term, df, c_pos, c_neg, logodds, z), fitted on the training split."""
    return _scored_units(spark, src, store).drop("gram")


def unit_matrix(spark: SparkSession, src: Source, store: Store) -> DataFrame:
    """Stored (doc_id, label, split, term, df, cnt) of the kept units, all splits."""
    keep = ("doc_id", "label", "split")

    def build() -> DataFrame:
        vocab = _scored_units(spark, src, store)
        coded = coded_documents(spark, src, store) if "gram" in vocab.columns else None
        if coded is None:
            docs = source_documents(spark, src, store).repartition("doc_id")
            return known_term_counts(docs, vocab.select("term", "df"), "tokens", src.n_range, keep)
        docs, words = coded
        counts = known_gram_counts(docs, vocab, words, src.n_range, keep)
        if counts is not None:
            return counts
        every = gram_counts(dealt_documents(docs, src.n_range), src.n_range, keep)
        return join_per_key(every, vocab.select("gram", "term", "df"), "gram", "doc_id", "df",
                            left_rows=lambda: grams_at_most(docs, src.n_range)).select(*keep, "term", "df", "cnt")

    return store.table(build, "unit_matrix", **src.key())


def encoder_key(embed: Callable | None, encoder: str | None) -> str:
    """Name and version of the encoder, part of the key of every table that depends on it."""
    if embed is None:
        return "neighbour signs 1"
    if not encoder:
        raise ValueError("name the encoder and its version (encoder=...) when embed is given")
    return encoder


def unit_vectors(
    spark: SparkSession, src: Source, store: Store,
    embed: Callable[[DataFrame, DataFrame], DataFrame] | None = None, encoder: str | None = None,
    valences: DataFrame | None = None,
) -> DataFrame:
    """Stored (term, df, embedding, score) of the kept units.

    ``embed(units, train)`` returns the units with an ``embedding`` column and has a name,
    ``encoder``; the default sums the signs of neighbouring words in the training split.
    ``valences`` (token, valence) replaces the lexicon.
    """
    def build() -> DataFrame:
        units = unit_features(spark, src, store).select("term", "df")
        train = source_documents(spark, src, store, "train")
        embedded = embed(units, train) if embed else oc.embed_words(train, units)
        scores = oc.polarity(units.select("term"), lexicon)
        return embedded.join(scores, "term")

    lexicon = valences if valences is not None else oc.valence_table(spark)
    return store.table(build, "unit_vectors", embed=encoder_key(embed, encoder),
                       valences=lexicon_key(valences), **src.key())


def lexicon_key(valences: DataFrame | None) -> str:
    """The given word list's number of rows and checksum."""
    if valences is None:
        return "default"
    row = valences.agg(F.count("*").alias("n"), F.sum(F.crc32(
        F.concat_ws(":", "token", F.col("valence").cast("string")).cast("binary"))).alias("c")).first()
    return f"{row.n}:{row.c}"


def concept_map(
    spark: SparkSession, src: Source, store: Store, k: int, w: float,
    embed: Callable | None = None, seed: int = oc.SEED, encoder: str | None = None,
    valences: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stored (term, df, concept_id) and (concept_id, centroid), for every k and w."""
    params = concept_key(src, k, w, embed, seed, encoder, valences)
    fitted: dict[str, DataFrame] = {}
    held: list[DataFrame] = []

    def fit(part: str) -> DataFrame:
        if not fitted:
            held.append(unit_vectors(spark, src, store, embed, encoder, valences).withColumn(
                "vector", oc.augment("embedding", "score", w)).persist())
            assigned, fitted["centroids"] = oc.fit_concepts(held[0], k, seed=seed)
            fitted["map"] = assigned.select("term", "df", "concept_id")
        return fitted[part]

    try:
        mapped = store.table(lambda: fit("map"), "concept_map", **params)
        return mapped, store.table(lambda: fit("centroids"), "concept_centroids", **params)
    finally:
        for rows in held:
            rows.unpersist()


def concept_key(src: Source, k: int, w: float, embed: Callable | None, seed: int,
                encoder: str | None, valences: DataFrame | None = None) -> dict[str, object]:
    """Every parameter that shapes a concept table; units (k = 0) depend on the source only."""
    if k == 0:
        return {"k": 0, **src.key()}
    return {"k": k, "w": w, "seed": seed, "embed": encoder_key(embed, encoder),
            "valences": lexicon_key(valences), **src.key()}


def concept_features(scored_counts: DataFrame, k: int) -> DataFrame:
    """(concept_id, c_pos, c_neg, logodds, z) over all k ids, from training counts."""
    return z_scores(oc.concept_class_counts(scored_counts, k))


def concept_matrix(
    spark: SparkSession, src: Source, store: Store, k: int, w: float, embed: Callable | None = None,
    seed: int = oc.SEED, encoder: str | None = None, valences: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, int]:
    """Stored counts (doc_id, label, split, concept_id, cnt), (concept_id, df, z, ...) of all concepts, their number."""
    shape = concept_key(src, k, w, embed, seed, encoder, valences)
    mapped, centroids = concept_map(spark, src, store, k, w, embed, seed, encoder, valences)
    n_concepts = centroids.count()
    matrix = unit_matrix(spark, src, store).drop("df")
    counts = store.table(
        lambda: oc.concept_counts(matrix, mapped, ("doc_id", "label", "split")), "concept_matrix", **shape)

    def scored() -> DataFrame:
        train = counts.where("split = 'train'")
        df = train.groupBy("concept_id").agg(F.count("*").alias("df"))
        return concept_features(train, n_concepts).join(df, "concept_id", "left").withColumn(
            "df", F.coalesce("df", F.lit(0)))

    return counts, store.table(scored, "concept_features", **shape), n_concepts


def load_representation(
    spark: SparkSession, src: Source, store: Store, z: float | None = 2.0, k: int = 0,
    w: float = 0.0, embed: Callable | None = None, seed: int = oc.SEED,
    encoder: str | None = None, valences: DataFrame | None = None,
) -> Representation:
    """Units for ``k = 0``, else concepts; pruned at ``z`` unless it is None."""
    shape = concept_key(src, k, w, embed, seed, encoder, valences)
    params = {"z": z, **shape}
    docs = assignments(spark, src, store)
    matrix = unit_matrix(spark, src, store)
    if k == 0:
        def chosen() -> DataFrame:
            scored = unit_features(spark, src, store)
            kept = keep_features(scored, z) if z is not None else scored
            return sorted_index(kept.select("term", "df"), "term")

        kept = store.table(chosen, "kept_units", **params)
        cells = join_per_key(matrix.drop("df"), kept, "term", "doc_id", "df",
                             keys=unit_features(spark, src, store).select("term", "df"))
    else:
        counts, scored, _ = concept_matrix(spark, src, store, k, w, embed, seed, encoder, valences)

        def chosen() -> DataFrame:
            kept = keep_features(scored, z) if z is not None else scored
            # at most k rows
            idx = F.row_number().over(Window.orderBy("concept_id")) - 1
            return kept.select("concept_id", "df", idx.alias("idx"))

        kept = store.table(chosen, "kept_concepts", **params)
        cells = join_per_key(counts, kept, "concept_id", "doc_id", "df")
    return Representation(
        docs, cells.select("doc_id", "split", "idx", "df", "cnt"), kept.count(),
        train_size(spark, src, store), store, params)


def vectors(rep: Representation, weighting: str = "tfidf") -> DataFrame:
    """Stored rows (doc_id, label, split, features, nnz) with raw counts (bow) or TF-IDF."""
    if weighting == "bow":
        cells = rep.cells.withColumn("value", F.col("cnt").cast("double"))
    elif weighting == "tfidf":
        with_idf = inverse_frequency(rep.cells, F.lit(rep.n_train))
        cells = tfidf(with_idf).withColumnRenamed("weight", "value")
    else:
        raise ValueError(f"unknown weighting: {weighting}")
    docs = rep.docs.select("doc_id", "label", "split")
    return feature_vectors(docs, cells, rep.size, rep.store, weighting=weighting, **rep.key)
