"""Corpus preparation: load, deduplicate, split, derive all token columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicade.functions import text as tx
from lexicade.operators.corpus import (
    SEED, SPLIT_ENDS, first_of_digest, stratified_split, text_digest,
)
from lexicade.operators.joins import BROADCAST_ROWS
from lexicade.operators.lemmas import distinct_tokens, lemma_lists, lemma_table, lemmatize, repeated_keys, with_keys
from lexicade.sources.artifacts import Store
from lexicade.sources.corpus import load_corpus, load_documents


def split_assignments(
    spark: SparkSession, folder: str, store: Store, label: str = "quality", seed: str = SEED
) -> DataFrame:
    """Stored table (doc_id, label, odd, split) of the first row of every distinct text.

    It is narrow, so that document counts and splits never touch the texts again; the
    texts' digests are made at the scan and the texts go no further.
    ``odd`` marks texts that NFKC may change.
    """
    def kept() -> DataFrame:
        docs = load_corpus(spark, folder, label, {
            "odd": tx.maybe_not_nfkc("text"), "digest": text_digest("text")})
        return first_of_digest(docs.drop("text"), "digest").select("doc_id", "label", "odd")

    def split() -> DataFrame:
        # the split reads its input several times, so the texts must be behind it
        return stratified_split(store.table(kept, "kept", folder=folder, label=label), seed=seed)

    return store.table(
        split, "splits", folder=folder, label=label, seed=seed, ends=SPLIT_ENDS)


def split_corpus(
    spark: SparkSession, folder: str, store: Store, label: str = "quality",
    split: str | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows (doc_id, text, text_nfkc, label, split).

    The ids that are kept, if they are few enough to broadcast, meet the texts at the scan: no text
    is shuffled, and those that are not kept go no further. Otherwise both sides are
    shuffled by document. Python only sees the texts that NFKC may change: they are normalised apart and
    joined back, which leaves the rest of the plan in the JVM.
    """
    chosen = split_assignments(spark, folder, store, label)
    if split is not None:
        chosen = chosen.where(F.col("split") == split)
    texts = load_documents(spark, folder)
    n, n_odd = chosen.agg(F.count("*"), F.count_if("odd")).first()
    how = "broadcast" if n <= broadcast_rows else "shuffle_hash"
    docs = texts.join(chosen.select("doc_id", "label", "split").hint(how), "doc_id")
    if not n_odd:
        return docs.withColumn("text_nfkc", F.col("text"))
    odd = chosen.where("odd").select("doc_id")
    normal = texts.join(odd.hint(how), "doc_id", "left_semi").select(
        "doc_id", tx.nfkc("text").alias("_nfkc"))
    return docs.join(normal.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("_nfkc", "text").alias("text_nfkc"), "label", "split")


def text_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the cleaned text and its tokens."""
    normal = F.col(f"{text}_nfkc") if f"{text}_nfkc" in docs.columns else tx.nfkc(text)
    return (
        docs.withColumn("text_clean", tx.clean_normalized(normal))
        .withColumn("text_expanded", tx.expand_contractions("text_clean"))
        .withColumn("tokens_cased", tx.tokenize("text_expanded"))
    )


def token_columns(docs: DataFrame) -> DataFrame:
    """Add the token columns that ``tokens_cased`` gives without a lookup table."""
    return (
        docs.withColumn("tokens_lower", tx.lower_tokens("tokens_cased"))
        .withColumn("tokens_filtered", tx.content_tokens("tokens_lower"))
        .withColumn("tokens_letters", tx.letter_tokens("tokens_lower"))
    )


def native_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the text columns and the token columns that need no lookup table."""
    return token_columns(text_columns(docs, text))


def prepared_corpus(
    spark: SparkSession, folder: str, store: Store, label: str = "quality", split: str | None = None,
) -> DataFrame:
    """Stored rows (doc_id, label, split, text_clean, text_expanded, tokens_cased): texts are cleaned once."""
    def build() -> DataFrame:
        return text_columns(split_corpus(spark, folder, store, label)).select(
            "doc_id", "label", "split", "text_clean", "text_expanded", "tokens_cased")

    docs = store.table(build, "prepared", folder=folder, label=label)
    return docs if split is None else docs.where(F.col("split") == split)


def all_tokens(
    docs: DataFrame, store: Store, text: str = "text", key: str = "doc_id",
    dictionary: DataFrame | None = None, **params: object,
) -> DataFrame:
    """Every text and token column of a prepared corpus, with ``text`` as text_raw.

    The lemma table is fitted on the vocabulary of ``docs`` unless a dictionary
    is given, and stored under ``params``.
    """
    base = native_tokens(docs, text)
    lemmas = store.table(
        lambda: lemma_table(base.select("tokens_lower"), "tokens_lower", dictionary),
        "lemmas", **params,
    )
    stemmed = base.withColumn("tokens_stemmed", tx.stem_tokens("tokens_lower"))

    def joined(some: DataFrame) -> DataFrame:
        return stemmed.join(lemmatize(some.select(key, "tokens_lower"), lemmas, "tokens_lower", key).hint("shuffle_hash"), key)

    in_row = lemma_lists(lemmas)
    if in_row is None:
        every = joined(base)
    else:
        # texts move only for documents whose rows share their key: these get the tokens of all of them
        single = stemmed.where(F.col(key).isNotNull())
        repeated = repeated_keys(docs.select(key).where(F.col(key).isNotNull()), [key])
        if repeated is not None:
            single = with_keys(single, repeated, [key], "left_anti")
        every = single.withColumn("tokens_lemmatized", in_row("tokens_lower")).select(
            key, *[c for c in stemmed.columns if c != key], "tokens_lemmatized")
        if repeated is not None:
            every = every.unionByName(joined(with_keys(base, repeated, [key], "left_semi")))
    return every.withColumnRenamed(text, "text_raw").drop(f"{text}_nfkc")


def token_documents(
    spark: SparkSession, folder: str, store: Store, token_col: str = "tokens_lower",
    label: str = "quality", split: str | None = None,
) -> DataFrame:
    """Rows (doc_id, label, split, tokens) with only the chosen token column derived."""
    docs = token_columns(prepared_corpus(spark, folder, store, label, split))
    if token_col == "tokens_lemmatized":
        # the dictionary is the vocabulary of the training split, as every other statistic
        everything = token_columns(prepared_corpus(spark, folder, store, label))
        known = distinct_tokens(everything.where("split = 'train'"), "tokens_lower")
        lemmas = store.table(
            lambda: lemma_table(everything, "tokens_lower", known), "lemmas", folder=folder, label=label)
        return lemmatize(docs, lemmas, name="tokens", keep=("label", "split"))
    tokens = F.col(token_col) if token_col != "tokens_stemmed" else tx.stem_tokens("tokens_lower")
    return docs.select("doc_id", "label", "split", tokens.alias("tokens"))
