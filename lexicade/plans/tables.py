"""Result tables that combine run names, metrics and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicade.functions import naming
from lexicade.operators.evaluate import direction, mcnemar_within, model_metrics


def _number(x: Column) -> Column:
    """A number without a fraction where it has none."""
    whole = x.cast("int")
    return F.when(x == whole, whole.cast("string")).otherwise(x.cast("string"))


def parameter_study(preds: DataFrame, exclude: str = "bert_basic_baseline") -> DataFrame:
    """Accuracy per run with its parameters; names without all four are left out."""
    named = preds.where(F.col("model") != exclude).select(
        F.col("model").alias("run"), "true_label", "probability")
    scored = model_metrics(named, ["run"])
    p = naming.parse_run_name("run")
    rows = scored.select(
        F.when(F.col("run").contains("linear_svm"), "SVM").otherwise("LogReg").alias("model"),
        p["ngram"].alias("n_grams"), p["z"].alias("z_score"), p["k"].alias("k_val"),
        p["w"].alias("w_val"), "accuracy",
    ).dropna(subset=["n_grams", "z_score", "k_val", "w_val"])
    w = F.col("w_val")
    return rows.select(
        "*", F.when(w > 0, F.concat(F.lit("w="), w.cast("int").cast("string")))
        .otherwise("w=0").alias("w_label"),
        F.concat_ws("_", "model", "n_grams", F.concat(F.lit("w"), w.cast("string")))
        .alias("config_id"),
    ).orderBy("k_val", "n_grams", "model", "w_val", "z_score")


def ablation_table(scores: DataFrame, p_values: DataFrame, z: float = 2.0) -> DataFrame:
    """Macro-F1 of token column x representation x model next to its baseline.

    ``scores`` has (model, value) with run names as model; ``p_values`` has (model,
    baseline, p_value). The baseline is the run on expanded lower-cased text with
    the same model and the matching plain representation.
    """
    pattern = (
        r"^(tokens_[a-z]+)_(?:(BoW|TF-IDF)|(CustomBow|CustomTfidf)_Z"
        + f"{z:g}".replace(".", r"\.") + r")_(linear_svm|logreg)$"
    )
    run = F.col("model")
    part = [F.regexp_extract(run, pattern, i) for i in range(1, 5)]
    rows = scores.where(run.rlike(pattern)).select(
        run.alias("run"), part[0].alias("token_col"),
        F.concat(part[1], part[2]).alias("representation"), part[3].alias("_m"),
        F.col("value").alias("macro_f1"),
    )
    plain = F.when(F.col("representation").isin("BoW", "CustomBow"), "BoW").otherwise("TF-IDF")
    rows = rows.withColumn(
        "baseline", F.concat(F.lit("text_expanded_lower_"), plain, F.lit("_"), F.col("_m")))
    base = scores.select(run.alias("baseline"), F.col("value").alias("baseline_f1"))
    tests = p_values.select(run.alias("run"), "baseline", "p_value")
    joined = rows.join(base, "baseline", "left").join(tests, ["run", "baseline"], "left")
    rank = F.row_number().over(  # one row per run
        Window.partitionBy("_m").orderBy(F.desc("macro_f1"), "run"))
    return joined.select(
        naming.display_name(F.col("token_col"), naming.TOKEN_DISPLAY).alias("token_processing"),
        "representation",
        naming.display_name(F.col("_m"), naming.MODEL_DISPLAY).alias("model"),
        "run", "macro_f1", "baseline", "baseline_f1", "p_value",
        F.coalesce(F.col("p_value") >= 0.05, F.lit(False)).alias("insignificant"),
        (rank == 1).alias("best"),
    )


def concept_comparison(scores: DataFrame) -> DataFrame:
    """Macro-F1 per number of concepts, weight and model next to the run without."""
    name = F.col("model")
    p = naming.parse_run_name("model")
    named = scores.where(~name.contains("Custom") & ~name.contains("baseline")).select(
        p["model"].alias("_m"), p["k"].alias("k"), p["w"].alias("w"),
        F.col("value").alias("macro_f1"), name.alias("run"),
    ).dropna(subset=["k", "w"])
    base = scores.where(name.rlike("^(linear_svm|logreg)_k0_w0$")).select(
        p["model"].alias("_m"), F.col("value").alias("baseline_f1"))
    rows = named.where("k > 0").join(F.broadcast(base), "_m", "left")  # a row per model
    return rows.select(
        naming.display_name(F.col("_m"), naming.MODEL_DISPLAY).alias("model"), "run", "k",
        F.concat(F.lit("w="), _number(F.col("w"))).alias("weight"), "macro_f1", "baseline_f1",
        (F.col("macro_f1") - F.col("baseline_f1")).alias("gain"),
    )


def pruning_tolerance(preds: DataFrame) -> DataFrame:
    """Per token column, representation and model: the best z by macro-F1, and the
    largest z that is not significantly worse than no pruning (z = 0)."""
    p = naming.parse_run_name("model")
    rep = naming.representation("model")
    rows = preds.select(
        p["token_col"].alias("token_col"), rep.alias("representation"),
        p["model"].alias("classifier"), p["z"].alias("z"), "doc_id", "true_label", "probability",
    ).where(F.col("representation").isin("CustomBow", "CustomTfidf") & F.col("z").isNotNull())
    group = ["token_col", "representation", "classifier"]
    scores = model_metrics(rows, [*group, "z"])
    tests = mcnemar_within(rows, group, "z", 0.0).select(*group, "z", "direction")
    ranked = scores.join(tests, [*group, "z"]).withColumn(
        "_rn", F.row_number().over(
            Window.partitionBy(*group).orderBy(F.desc("macro_f1"), "z")))
    return ranked.groupBy(*group).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("z"))).alias("best_z"),
        F.max("macro_f1").alias("best_macro_f1"),
        F.max(F.when(F.col("direction") != "down", F.col("z"))).alias("tolerated_z"),
    )


def cascade_significance(tests: DataFrame, scores: DataFrame) -> DataFrame:
    """Cascades with display names, macro-F1, best mark and significance."""
    best = F.row_number().over(Window.orderBy(F.desc("macro_f1"), "model"))  # a row per model
    return scores.join(tests.select("model", "p_value", "acc_model", "acc_baseline"), "model") \
        .select(
            naming.display_name(F.col("model"), naming.CASCADE_DISPLAY).alias("label"),
            "model", "macro_f1", "p_value",
            direction(F.col("p_value"), F.col("acc_model"), F.col("acc_baseline"))
            .alias("direction"),
            (best == 1).alias("best"),
        )
