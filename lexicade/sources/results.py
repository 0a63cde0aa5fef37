"""Prediction, report and test tables as CSV folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "true_label int, probability double, doc_id long"
REPORTS = "class string, precision double, recall double, `f1-score` double, support double"
TESTS = (
    "experiment string, text string, representation string, model string, baseline string, "
    "acc_model double, acc_baseline double, p_value double"
)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """``path/experiment=.../model=.../*.csv`` with true_label, probability, doc_id."""
    (
        predictions.select("experiment", "model", "true_label", "probability", "doc_id")
        .hint("rebalance", "experiment", "model")  # few files per model, large models split
        .write.mode("overwrite").partitionBy("experiment", "model")
        .option("header", True).csv(path)
    )


def scan_predictions(
    spark: SparkSession,
    path: str,
    experiment: str | None = None,
    prefix: str = "",
    suffix: str = "",
    contains: str = "",
    exclude: str | None = None,
    tags: dict[str, str] | None = None,
) -> DataFrame:
    """Rows (experiment, model, doc_id, true_label, probability) and given tags.

    Experiment and model are partition columns, so files that the name filters
    exclude are never opened.
    """
    schema = PREDICTIONS + ", experiment string, model string"
    df = spark.read.schema(schema).option("header", True).csv(path)
    model = F.col("model")
    if experiment is not None:
        df = df.where(F.col("experiment") == experiment)
    if prefix:
        df = df.where(model.startswith(prefix))
    if suffix:
        df = df.where(model.endswith(suffix))
    if contains:
        df = df.where(model.contains(contains))
    if exclude is not None:
        df = df.where(model != exclude)
    out = df.select("experiment", "model", "doc_id", "true_label", "probability")
    for name, value in (tags or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out


def write_reports(reports: DataFrame, path: str) -> None:
    """Classification reports, one folder per experiment and model."""
    (
        reports.withColumnRenamed("f1_score", "f1-score")
        .select("experiment", "model", "class", "precision", "recall", "f1-score", "support")
        .hint("rebalance", "experiment", "model")
        .write.mode("overwrite").partitionBy("experiment", "model")
        .option("header", True).csv(path)
    )


def scan_reports(
    spark: SparkSession, path: str, row: str = "macro avg", cell: str = "f1-score"
) -> DataFrame:
    """Rows (experiment, model, value): one cell of every stored report."""
    schema = REPORTS + ", experiment string, model string"
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.where(F.col("class") == row).select(
        "experiment", "model", F.col(cell).alias("value")
    )


def write_tests(tests: DataFrame, path: str) -> None:
    """Significance tests, sorted by experiment, text, representation and model."""
    order = ("experiment", "text", "representation", "model")
    (
        tests.select("experiment", "text", "representation", "model", "baseline",
                     "acc_model", "acc_baseline", "p_value")
        .orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
    )


def read_tests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns of stored significance tests."""
    return spark.read.schema(TESTS).option("header", True).csv(
        paths if isinstance(paths, str) else list(paths))


def read_p_values(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lookup table (model, baseline, p_value)."""
    return read_tests(spark, paths).select("model", "baseline", "p_value")
