"""Evaluation tables over long predictions.

All functions take rows (model, doc_id, true_label, probability), possibly with
an experiment column, and handle any number of models in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicade.functions import stats
from lexicade.functions.naming import run_keys
from lexicade.functions.text import outcome_label, predict_label, uncertainty
from lexicade.operators.ranking import top_per_group

SIGNIFICANCE = 0.05
BINS = 50
BAND_NAMES = (
    "[0.4, 0.6]", "[0.3, 0.4) u (0.6, 0.7]", "[0.2, 0.3) u (0.7, 0.8]",
    "[0.1, 0.2) u (0.8, 0.9]", "[0.0, 0.1) u (0.9, 1.0]",
)


def _cells(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the four cells of the confusion matrix."""
    p, y = predict_label("probability"), F.col("true_label")
    return preds.groupBy(*by).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def _scores() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = {
        "p1": _ratio(tp, tp + fp), "r1": _ratio(tp, tp + fn),
        "p0": _ratio(tn, tn + fn), "r0": _ratio(tn, tn + fp),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "f0": _ratio(2 * tn, 2 * tn + fp + fn),
        "acc": _ratio(tp + tn, tp + fp + fn + tn),
        "s1": (tp + fn).cast("double"), "s0": (tn + fp).cast("double"),
    }
    return out


def classification_report(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows (by..., class, precision, recall, f1_score, support), five per group."""
    wide = _cells(preds, by).select(*by, *[c.alias(n) for n, c in _scores().items()])
    c = F.col
    total = c("s0") + c("s1")

    def weighted(m: str) -> Column:
        return _ratio(c(f"{m}0") * c("s0") + c(f"{m}1") * c("s1"), total)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.alias("support"))

    rows = F.array(
        row("0", c("p0"), c("r0"), c("f0"), c("s0")),
        row("1", c("p1"), c("r1"), c("f1"), c("s1")),
        row("accuracy", c("acc"), c("acc"), c("acc"), c("acc")),
        row("macro avg", *[(c(f"{m}0") + c(f"{m}1")) / 2.0 for m in "prf"], total),
        row("weighted avg", *[weighted(m) for m in "prf"], total),
    )
    return wide.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def confusion_matrix(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows (by..., true_label, pred, n, accuracy), all four cells per group."""
    c = F.col
    acc = _ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))
    cells = F.array(*[
        F.struct(F.lit(y).alias("true_label"), F.lit(p).alias("pred"), c(n).alias("n"))
        for y, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ])
    out = _cells(preds, by).select(*by, acc.alias("accuracy"), F.explode(cells).alias("_c"))
    return out.select(*by, "_c.*", "accuracy")


def model_metrics(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows (by..., n, accuracy, macro_f1)."""
    s = _scores()
    return _cells(preds, by).select(
        *by, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
        s["acc"].alias("accuracy"), ((s["f0"] + s["f1"]) / 2.0).alias("macro_f1"),
    )


def same_documents(
    models: DataFrame, baseline: DataFrame, by: Sequence[str] | None = None, key: str = "doc_id"
) -> DataFrame:
    """Rows (by...) of the runs that predict exactly the baseline's documents."""
    by = list(by or run_keys(models))
    size = baseline.agg(F.count("*")).scalar()
    known = baseline.select(key, F.lit(1).alias("_b"))
    per = models.select(*by, key).join(known, key, "left").groupBy(*by).agg(
        F.count("*").alias("_n"), F.count("_b").alias("_m"))
    return per.where((F.col("_n") == size) & (F.col("_m") == size)).select(*by)


def align(
    models: DataFrame, baseline: DataFrame, by: Sequence[str] | None = None, key: str = "doc_id"
) -> DataFrame:
    """Pair every run's predictions with the baseline's on the same document.

    A run is a model, within its experiment where ``models`` has that column. Adds
    ``baseline_probability``; runs on other documents are left out.
    """
    by = list(by or run_keys(models))
    complete = same_documents(models, baseline, by, key)
    pairs = models.join(
        baseline.select(key, F.col("probability").alias("baseline_probability")), key)
    return pairs.join(F.broadcast(complete), list(by), "left_semi")  # a row per model


def _tested(paired: DataFrame, by: Sequence[str], size: Column | None = None) -> DataFrame:
    """McNemar's statistics per group of rows with the baseline's verdict ``_base``.

    Groups with unmatched rows are left out, and, if ``size`` is given, groups of
    another size. p is null where the models never differ in correctness.
    """
    right = predict_label("probability") == F.col("true_label")
    b_ok, c_ok = F.col("_base"), right
    cells = paired.groupBy(*by).agg(
        F.count("*").alias("_n"), F.count("_base").alias("_m"),
        F.count_if(b_ok & c_ok).alias("both_correct"),
        F.count_if(b_ok & ~c_ok).alias("base_only"),
        F.count_if(~b_ok & c_ok).alias("comp_only"),
        F.count_if(~b_ok & ~c_ok).alias("both_wrong"),
    ).where(F.col("_n") == F.col("_m"))
    if size is not None:
        cells = cells.where(F.col("_n") == size)
    b, c, n = F.col("base_only"), F.col("comp_only"), F.col("_n")
    gap = F.abs(b - c) - 1
    return (
        cells.select(
            *by, "both_correct", "base_only", "comp_only", "both_wrong",
            ((F.col("both_correct") + c) / n).alias("acc_model"),
            ((F.col("both_correct") + b) / n).alias("acc_baseline"),
            F.try_divide(gap * gap, b + c).alias("chi2"),
        )
        .withColumn("p_value", stats.chi2_survival(F.col("chi2")))
        .withColumn("direction", direction(
            F.col("p_value"), F.col("acc_model"), F.col("acc_baseline")))
    )


def mcnemar(
    challengers: DataFrame, baseline: DataFrame, baseline_name: str,
    by: Sequence[str] = ("experiment", "model"), key: str = "doc_id",
) -> DataFrame:
    """McNemar's test with continuity correction of every challenger vs one baseline.

    The baseline itself and models on other documents than the baseline's are
    skipped.
    """
    size = baseline.agg(F.count("*")).scalar()
    base = baseline.select(
        key, (predict_label("probability") == F.col("true_label")).alias("_base"))
    paired = challengers.where(F.col("model") != baseline_name).join(base, key, "left")
    return _tested(paired, by, size).withColumn("baseline", F.lit(baseline_name))


def mcnemar_matched(
    preds: DataFrame, baselines: Sequence[str], by: Sequence[str] = ("experiment", "model"),
    key: str = "doc_id",
) -> DataFrame:
    """The test of every run against each of several baselines, which are runs of ``preds``."""
    tests = [mcnemar(preds, preds.where(F.col("model") == b), b, by, key) for b in baselines]
    return reduce(DataFrame.unionByName, tests)


def mcnemar_within(
    preds: DataFrame, group: Sequence[str], variant: str, baseline: object,
    key: str = "doc_id",
) -> DataFrame:
    """The same test inside every group, against the row set of one variant."""
    base = preds.where(F.col(variant) == F.lit(baseline)).select(
        *group, key, (predict_label("probability") == F.col("true_label")).alias("_base"))
    return _tested(preds.join(base, [key, *group], "left"), [*group, variant])


def direction(p: Column, acc: Column, base: Column) -> Column:
    """up or down if significantly better or worse, else none."""
    sure = p < SIGNIFICANCE
    return F.when(sure & (acc > base), "up").when(sure & (acc < base), "down").otherwise("none")


def certainty_histogram(
    preds: DataFrame, bins: int = BINS, by: Sequence[str] = ("model",)
) -> DataFrame:
    """Rows (by..., bin, outcome, n): equal bins over [0, 1], 1 in the last bin."""
    raw = F.width_bucket(F.col("probability"), F.lit(0.0), F.lit(1.0), F.lit(bins))
    bucket = F.least(raw, F.lit(bins)).cast("int")
    outcome = outcome_label("probability", "true_label")
    return preds.groupBy(*by, bucket.alias("bin"), outcome.alias("outcome")).agg(
        F.count("*").alias("n"))


def band(probability: Column | str) -> Column:
    """Symmetric certainty zone 1 (least certain) to 5, edges as in BAND_NAMES."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return (
        F.when((p >= 0.4) & (p <= 0.6), 1)
        .when((p >= 0.3) & (p <= 0.7), 2)
        .when((p >= 0.2) & (p <= 0.8), 3)
        .when((p >= 0.1) & (p <= 0.9), 4)
        .otherwise(5)
    )


def certainty_bands(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows (by..., band, band_range, predictions, incorrect, local_accuracy, workload,
    error_share)."""
    wrong = predict_label("probability") != F.col("true_label")
    zones = preds.groupBy(*by, band("probability").alias("band")).agg(
        F.count("*").alias("predictions"), F.count_if(wrong).alias("incorrect"))
    whole = Window.partitionBy(*by)  # five rows
    n, e = F.col("predictions"), F.col("incorrect")
    names = F.array(*[F.lit(x) for x in BAND_NAMES])
    return zones.select(
        *by, "band", F.element_at(names, F.col("band")).alias("band_range"),
        "predictions", "incorrect",
        (1.0 - e / n).alias("local_accuracy"),
        (n / F.sum(n).over(whole)).alias("workload"),
        _ratio(e, F.sum(e).over(whole)).alias("error_share"),
    )


def extreme_errors(preds: DataFrame, n: int = 5, by: Sequence[str] = ("model",)) -> DataFrame:
    """The n most confident wrong rows on either side, per group."""
    pred = predict_label("probability")
    wrong = preds.withColumn("pred", pred).where(F.col("pred") != F.col("true_label"))
    both = F.array(
        F.struct(F.lit("highest").alias("side"), (-F.col("probability")).alias("_o")),
        F.struct(F.lit("lowest").alias("side"), F.col("probability").alias("_o")),
    )
    sides = wrong.withColumn("_s", F.explode(both)).select(
        *by, "doc_id", "true_label", "pred", "probability", "_s.*")
    best = top_per_group(sides, [*by, "side"], [F.col("_o"), F.col("doc_id")], n)
    return best.drop("_o")


def uncertain_errors(preds: DataFrame, n: int = 10, by: Sequence[str] = ("model",)) -> DataFrame:
    """The n wrong rows nearest to one half, per group."""
    wrong = preds.withColumn("pred", predict_label("probability")).where(
        F.col("pred") != F.col("true_label"))
    scored = wrong.withColumn("uncertainty_score", uncertainty("probability"))
    return top_per_group(
        scored, list(by), [F.col("uncertainty_score"), F.col("doc_id")], n
    ).select(*by, "rank", "doc_id", "true_label", "pred", "probability", "uncertainty_score")
