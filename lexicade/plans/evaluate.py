"""Evaluate on a split: predictions and classification report, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicade.operators.evaluate import classification_report
from lexicade.operators.linear import Linear
from lexicade.operators.models import predict
from lexicade.sources import results


def evaluate(spark: SparkSession, predictions: DataFrame, path: str, experiment: str) -> tuple[DataFrame, DataFrame]:
    """Write both CSV folders under ``path`` and return (predictions, reports) as read from them.

    ``predictions`` are rows (model, doc_id, true_label, probability) of one or many models. The
    report is made from the stored predictions, so the two always belong together.
    """
    raw, reports = f"{path}/raw_predictions", f"{path}/classification_reports"
    results.write_predictions(predictions.withColumn("experiment", F.lit(experiment)), raw)
    stored = results.scan_predictions(spark, raw, experiment=experiment)
    results.write_reports(classification_report(stored, ["experiment", "model"]), reports)
    return stored, spark.read.schema(f"{results.REPORTS}, experiment string, model string").option(
        "header", True).csv(reports).withColumnRenamed("f1-score", "f1_score")


def evaluate_model(
    model: Linear, vectors: DataFrame, split: str, path: str, experiment: str, name: str,
) -> tuple[DataFrame, DataFrame]:
    """The same for a fitted model on one split of ``vectors`` (doc_id, label, split, features)."""
    scored = predict(model, vectors.where(F.col("split") == split), name)
    return evaluate(vectors.sparkSession, scored, path, experiment)
