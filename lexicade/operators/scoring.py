"""Class log-odds z-scores per feature, and pruning by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicade.functions import stats
from lexicade.functions.text import display_label, ngram_size
from lexicade.operators.joins import BROADCAST_ROWS, join_per_key
from lexicade.operators.ranking import top_per_group
from lexicade.operators.vocabulary import MAX_DF, MIN_DF, df_limits

Z_THRESHOLDS = (0, 1, 2, 3, 4)


def class_counts(
    counts: DataFrame,
    n_docs: Column,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    by: Sequence[str] = (),
    label: str = "label",
    unit: str = "term",
) -> DataFrame:
    """Rows (by..., term, df, c_pos, c_neg) of the terms within the limits.

    One aggregate yields the document frequency and both class counts.
    """
    one = F.col(label) == 1
    per_term = counts.groupBy(*by, unit).agg(
        F.count("*").alias("df"),
        F.sum(F.when(one, F.col("cnt")).otherwise(F.lit(0))).alias("c_pos"),
        F.sum(F.when(one, F.lit(0)).otherwise(F.col("cnt"))).alias("c_neg"),
    )
    return per_term.where(df_limits(F.col("df"), n_docs, min_df, max_df))


def class_totals(per_feature: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): class totals and number of kept features."""
    aggs = [F.sum("c_pos").alias("n_pos"), F.sum("c_neg").alias("n_neg"),
            F.count("*").alias("size")]
    return per_feature.groupBy(*by).agg(*aggs) if by else per_feature.agg(*aggs)


def _scored(df: DataFrame, n_pos: Column, n_neg: Column, size: Column, alpha: float) -> DataFrame:
    c_pos, c_neg = F.col("c_pos"), F.col("c_neg")
    odds = stats.log_odds(c_pos, c_neg, n_pos, n_neg, size, alpha)
    return df.withColumn("logodds", odds).withColumn(
        "z", stats.z_score(F.col("logodds"), c_pos, c_neg, alpha)
    )


def z_scores(
    per_feature: DataFrame, by: Sequence[str] = (), alpha: float = stats.ALPHA
) -> DataFrame:
    """Add ``logodds`` and the signed ``z`` (positive class) to class counts.

    The z-score of the negative class is ``-z``. Totals run over the given rows,
    that is over the kept vocabulary.
    """
    totals = class_totals(per_feature, by)
    if not by:
        once = totals.select(F.struct("n_pos", "n_neg", "size")).scalar()
        t = F.col("_t")
        with_totals = per_feature.withColumn("_t", once)
        return _scored(with_totals, t["n_pos"], t["n_neg"], t["size"], alpha).drop("_t")
    # one row per group (token column or n-gram range)
    joined = per_feature.join(F.broadcast(totals), list(by))
    scored = _scored(joined, F.col("n_pos"), F.col("n_neg"), F.col("size"), alpha)
    return scored.drop("n_pos", "n_neg", "size")


def keep_features(scored: DataFrame, threshold: float) -> DataFrame:
    """Features whose z exceeds the threshold (strictly) for either class."""
    return scored.where(F.abs("z") > threshold)


def keep_either_class(scored: DataFrame, threshold: float, feature: str = "term") -> DataFrame:
    """The same set as keep_features, written as a union of both classes."""
    pos = scored.where(F.col("z") > threshold).select(feature)
    neg = scored.where(-F.col("z") > threshold).select(feature)
    return pos.union(neg).distinct()


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float] = Z_THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    """Rows (by..., threshold, base_size, kept_pos, kept_neg, kept), in one pass."""
    aggs = [F.count("*").alias("base_size")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(F.col("z") > t).alias(f"_p{i}"),
                 F.count_if(F.col("z") < -t).alias(f"_n{i}")]
    wide = scored.groupBy(*by).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_p{i}").alias("kept_pos"),
                 F.col(f"_n{i}").alias("kept_neg"))
        for i, t in enumerate(thresholds)
    ])
    long = wide.select(*by, "base_size", F.explode(rows).alias("_r")).select(
        *by, "base_size", "_r.*")
    return long.withColumn("kept", F.col("kept_pos") + F.col("kept_neg"))


def ngram_depth(
    per_feature: DataFrame, max_n: int = 3, threshold: float = 2.0, alpha: float = stats.ALPHA
) -> DataFrame:
    """Rows (max_n, base_size, pruned_size) for the ranges (1,1) ... (1,max_n).

    Document frequencies do not depend on the range, so one set of class counts
    serves all ranges; only the totals differ.
    """
    sized = per_feature.withColumn("_n", ngram_size("term"))
    per_size = class_totals(sized, ["_n"])
    upto = Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)  # max_n rows
    totals = per_size.select(
        F.col("_n").alias("max_n"),
        *[F.sum(c).over(upto).alias(c) for c in ("n_pos", "n_neg", "size")],
    )
    ranges = F.sequence(F.col("_n"), F.lit(max_n))
    spread = sized.withColumn("max_n", F.explode(ranges)).join(F.broadcast(totals), "max_n")
    scored = _scored(spread, F.col("n_pos"), F.col("n_neg"), F.col("size"), alpha)
    return scored.groupBy("max_n").agg(
        F.count("*").alias("base_size"),
        F.count_if(F.abs("z") > threshold).alias("pruned_size"),
    )


def top_features(scored: DataFrame, n: int = 15, feature: str = "term") -> DataFrame:
    """The n strongest features of each class; the negative class shows ``-z``."""
    both = F.array(
        F.struct(F.lit("Positive").alias("class"), F.col("z").alias("strength")),
        F.struct(F.lit("Negative").alias("class"), (-F.col("z")).alias("strength")),
    )
    sides = scored.select(feature, F.explode(both).alias("_s")).select(feature, "_s.*")
    best = top_per_group(sides, ["class"], [F.desc("strength"), F.col(feature)], n)
    signed = F.when(F.col("class") == "Positive", F.col("strength")).otherwise(
        -F.col("strength"))
    return best.select(
        "class", "rank", feature, display_label(F.col(feature).cast("string")).alias("label"),
        signed.alias("z"),
    )


def keep_discard_report(scored: DataFrame, threshold: float = 2.0, n: int = 150) -> DataFrame:
    """Top n kept-positive, kept-negative and neutral features with group totals."""
    z = F.col("z")
    group = (
        F.when(z > threshold, "positive").when(z < -threshold, "negative").otherwise("neutral")
    )
    # strongest kept features first, weakest neutral features first
    grouped = scored.withColumn("group", group).withColumn(
        "_o", F.when(F.col("group") == "neutral", F.abs(z)).otherwise(-F.abs(z)))
    totals = grouped.groupBy("group").agg(F.count("*").alias("group_total"))
    best = top_per_group(grouped, ["group"], [F.col("_o"), F.col("term")], n)
    return best.join(F.broadcast(totals), "group").select(  # three rows
        "group", "rank", display_label("term").alias("label"), F.abs(z).alias("weight"),
        "group_total",
    )


def kept_lists(
    scored: DataFrame, thresholds: Sequence[float] = Z_THRESHOLDS, feature: str = "term"
) -> DataFrame:
    """Rows (threshold, feature), one per threshold the feature passes."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return scored.select(at, feature, "z").where(
        F.abs("z") > F.col("threshold")).select("threshold", feature)


def select_columns(counts: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame | None:
    """Counts of the kept features only, or None if fewer than two remain.

    ``kept`` is a stored table with term and df.
    """
    if kept.limit(2).count() < 2:
        return None
    return join_per_key(counts, kept.select("term", "df"), "term", key, "df").drop("df")


def score_documents(
    docs: DataFrame, counts: DataFrame, kept: DataFrame, name: str, units: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(model, split, doc_id, true_label, probability) by the mean z of a document's kept terms.

    ``kept`` is a stored (term, df, z), ``counts`` has doc_id, term and cnt; the probability is the
    sigmoid of the mean, one half without a kept term, in six digits. ``units`` is a stored (term, df)
    of all terms of ``counts``: with it, frequent terms that are not kept do not meet in one task either.
    """
    cells = join_per_key(
        counts.select("doc_id", "term", "cnt"), kept.select("term", "df", "z"), "term", "doc_id", "df", broadcast_rows,
        keys=None if units is None else units.select("term", "df"))
    means = cells.groupBy("doc_id").agg((F.sum(F.col("cnt") * F.col("z")) / F.sum("cnt")).alias("_m"))
    p = F.round(1.0 / (1.0 + F.exp(-F.coalesce("_m", F.lit(0.0)))), 6)
    return docs.join(means, "doc_id", "left").select(
        F.lit(name).alias("model"), "split", "doc_id", F.col("label").cast("int").alias("true_label"), p.alias("probability"))
