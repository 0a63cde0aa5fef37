"""N-gram counts, document-frequency limits, vocabulary, count matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicade.functions.text import ngrams
from lexicade.operators.joins import BROADCAST_ROWS, attach_small, join_per_key
from lexicade.operators.ranking import sorted_index

MIN_DF = 10
MAX_DF = 0.7
STOP_SHARE = 0.3
RARE_COUNT = 10


def units(tokens: Column | str) -> Column:
    """Tokens as the counter sees them: an empty list counts as one empty token."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(t) == 0, F.array(F.lit(""))).otherwise(t)


def term_counts(
    docs: DataFrame,
    tokens: Column | str = "tokens",
    n_range: tuple[int, int] = (1, 3),
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Rows (keep..., term, cnt). ``keep`` must contain the document key.

    If ``docs`` is partitioned by the key (as after the corpus join), the counts
    need no further shuffle.
    """
    grams = _terms(docs, tokens, n_range, keep)
    return grams.groupBy(*keep, "term").agg(F.count("*").alias("cnt"))


def terms_at_most(docs: DataFrame, tokens: Column | str = "tokens", n_range: tuple[int, int] = (1, 3)) -> Callable[[], int]:
    """Counts, when called, a number that the rows of ``term_counts`` do not exceed: tokens are not counted by term for it."""
    size = F.size(units(tokens)).cast("long")
    return lambda: docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] * (n_range[1] - n_range[0] + 1)


def _terms(docs: DataFrame, tokens: Column | str, n_range: tuple[int, int],
           keep: Sequence[str]) -> DataFrame:
    listed = docs.select(*keep, units(tokens).alias("_t"))
    return listed.select(*keep, F.explode(ngrams("_t", n_range)).alias("term"))


def frequent_words(
    docs: DataFrame, tokens: Column | str = "tokens", min_df: int = MIN_DF, by: Sequence[str] = (),
) -> DataFrame:
    """Rows (by..., word, df) of the words in at least ``min_df`` documents."""
    words = docs.select(*by, F.explode(F.array_distinct(units(tokens))).alias("word"))
    return words.groupBy(*by, "word").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def frequent_term_counts(
    docs: DataFrame,
    frequent: DataFrame,
    tokens: Column | str = "tokens",
    n_range: tuple[int, int] = (1, 3),
    keep: Sequence[str] = ("doc_id",),
    by: Sequence[str] = (),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows (keep..., term, cnt) of the n-grams whose words are all ``frequent`` (by..., word, df).

    ``keep`` tells the rows of ``docs`` apart and holds ``by``.

    No n-gram is in more documents than any of its words, so with the stored result of
    ``frequent_words`` nothing is lost that a limit of ``min_df`` would keep, and
    the many rare n-grams are neither counted nor shuffled.
    """
    listed = docs.select(*keep, F.posexplode(units(tokens)).alias("_i", "word"))
    known = frequent.select(*by, "word", F.lit(True).alias("_known"))
    marked = attach_small(listed, known, [*by, "word"], "left", broadcast_rows)
    lo, hi = n_range
    place = Window.partitionBy(*keep).orderBy("_i")
    word = F.when(F.col("_known"), F.col("word"))
    # a word apart from its neighbour in the list is no neighbour; all tokens are still rows
    wide = marked.select(*keep, *[
        (F.lead(word, n).over(place) if n else word).alias(f"_w{n}") for n in range(hi)])
    grams = []
    for n in range(lo, hi + 1):
        whole = F.lit(True)
        for i in range(n):
            whole = whole & F.col(f"_w{i}").isNotNull()
        grams.append(F.when(whole, F.concat_ws(" ", *[f"_w{i}" for i in range(n)])))
    terms = wide.where("_w0 is not null").select(*keep, F.explode(F.array_compact(F.array(*grams))).alias("term"))
    return terms.groupBy(*keep, "term").agg(F.count("*").alias("cnt"))


def known_term_counts(
    docs: DataFrame,
    vocab: DataFrame,
    tokens: Column | str = "tokens",
    n_range: tuple[int, int] = (1, 3),
    keep: Sequence[str] = ("doc_id",),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows (keep..., term, df, cnt) for the terms of a stored (term, df) table.

    A vocabulary small enough to broadcast filters the terms before they are
    counted; a larger one is joined with the counts.
    """
    if vocab.limit(broadcast_rows + 1).count() > broadcast_rows:
        counts = term_counts(docs, tokens, n_range, keep)
        at_most = terms_at_most(docs, tokens, n_range)
        return apply_vocabulary(counts, vocab.select("term", "df"), keep[0], at_most).select(*keep, "term", "df", "cnt")
    known = F.broadcast(vocab.select("term", "df"))
    found = _terms(docs, tokens, n_range, keep).join(known, "term")
    return found.groupBy(*keep, "term", "df").agg(F.count("*").alias("cnt"))


def document_count(docs: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return docs.agg(F.count("*")).scalar()


def df_limits(df: Column, n_docs: Column, min_df: int, max_df: float) -> Column:
    """Both limits inclusive; min_df is a count, max_df a share."""
    return (df >= min_df) & (df <= F.lit(max_df) * n_docs)


def vocabulary(
    counts: DataFrame, n_docs: Column, min_df: int = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """Rows (term, df) within the limits; ``counts`` has one row per document and term."""
    per_term = counts.groupBy("term").agg(F.count("*").alias("df"))
    return per_term.where(df_limits(F.col("df"), n_docs, min_df, max_df))


def indexed_vocabulary(vocab: DataFrame) -> DataFrame:
    """Rows (term, idx, df), idx in the order of the terms."""
    return sorted_index(vocab, "term").select("term", "idx", "df")


def apply_vocabulary(counts: DataFrame, vocab: DataFrame, key: str = "doc_id", rows: Callable[[], int] | None = None) -> DataFrame:
    """Keep the counts of known terms and attach the columns of ``vocab``.

    ``vocab`` is a stored table with a ``df`` column; ``rows`` gives what ``counts`` do not
    exceed, for counts that are not stored (``terms_at_most``).
    """
    return join_per_key(counts, vocab, "term", key, "df", left_rows=rows)


def frequent_uses(docs: DataFrame, tokens: Column | str = "tokens", below: int = RARE_COUNT) -> DataFrame:
    """Rows (word, total) of the words used at least ``below`` times: no n-gram is used more often than its words."""
    words = docs.select(F.explode(units(tokens)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("total")).where(F.col("total") >= below)


def stop_words(
    docs: DataFrame, listed: DataFrame, tokens: Column | str = "tokens", share: float = STOP_SHARE, label: str = "label",
) -> DataFrame:
    """Rows (word) of the words in more rows than ``share`` of the ``listed`` documents of both labels.

    No n-gram is in more documents of a label than its words, so stop units are made of these words only.
    """
    words = docs.select(label, F.explode(F.array_distinct(units(tokens))).alias("term"), F.lit(1).alias("cnt"))
    return stop_units(words, listed, share, label).select(F.col("term").alias("word"))


def label_frequencies(counts: DataFrame, label: str = "label") -> DataFrame:
    """Rows (term, df_pos, df_neg, total)."""
    one = F.col(label) == 1
    return counts.groupBy("term").agg(
        F.count_if(one).alias("df_pos"),
        F.count_if(~one).alias("df_neg"),
        F.sum("cnt").alias("total"),
    )


def stop_units(
    counts: DataFrame, docs: DataFrame, share: float = STOP_SHARE, label: str = "label"
) -> DataFrame:
    """Terms in more than ``share`` of the documents of both labels."""
    return stops(label_frequencies(counts, label), docs, share, label)


def _shares(frequencies: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """Add the shares of the documents of either label."""
    one = F.col(label) == 1
    n = docs.agg(
        F.struct(F.count_if(one).alias("pos"), F.count_if(~one).alias("neg"))
    ).scalar()
    return frequencies.withColumn("_docs", n).withColumns({
        "share_pos": F.try_divide("df_pos", F.col("_docs.pos")),
        "share_neg": F.try_divide("df_neg", F.col("_docs.neg")),
    }).drop("_docs")


def _stop(share: float) -> Column:
    return (F.col("share_pos") > share) & (F.col("share_neg") > share)


def stops(frequencies: DataFrame, docs: DataFrame, share: float = STOP_SHARE, label: str = "label",
          unit: str = "term") -> DataFrame:
    """``stop_units`` from a table (unit, df_pos, df_neg)."""
    return _shares(frequencies, docs, label).where(_stop(share)).select(unit, "df_pos", "df_neg", "share_pos", "share_neg")


def informative(frequencies: DataFrame, docs: DataFrame, share: float = STOP_SHARE, below: int = RARE_COUNT,
                label: str = "label", unit: str = "term") -> DataFrame:
    """``informative_units`` from a table (unit, df_pos, df_neg, total), which is read once."""
    left = _shares(frequencies, docs, label).where(F.col("total") >= below)
    return left.where(~F.coalesce(_stop(share), F.lit(False))).select(unit, "total")


def rare_units(counts: DataFrame, below: int = RARE_COUNT) -> DataFrame:
    """Terms seen fewer than ``below`` times in the whole corpus."""
    totals = counts.groupBy("term").agg(F.sum("cnt").alias("total"))
    return totals.where(F.col("total") < below)


def informative_units(
    counts: DataFrame, docs: DataFrame, share: float = STOP_SHARE, below: int = RARE_COUNT
) -> DataFrame:
    """Rows (term, total) left after rare and stop units are removed."""
    return informative(label_frequencies(counts), docs, share, below)
