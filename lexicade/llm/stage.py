"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicade.sources.artifacts import Store, shared_folder

NO_ID = -(1 << 63)


class Stage:
    """Tables written once and read again, which cuts their lineage.

    They stay, as results may still read them; ``stage.store.drop()`` deletes them all.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.store = Store(spark)

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.store.folder}/{name}"
        # a nested field or array must come back with the type it had
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc, text, i, h): all columns under one name, and a key of doc_id and text.

    i is the doc_id, or the least number where there is none; h is the text's hash.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def partitions_for(df: DataFrame, weight: Column, target: int, least: int = 1) -> int:
    """So many partitions that one has about ``target`` of the summed weight."""
    total = df.select(F.sum(weight.cast("long"))).first()[0] or 0
    return max(least, -(-int(total) // target))


__all__ = ["NO_ID", "Stage", "documents", "keyed", "partitions_for", "shared_folder"]
