"""The labelled corpus and its stored splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_COLUMNS = (
    "tokens_cased", "tokens_lower", "tokens_filtered", "tokens_letters",
    "tokens_stemmed", "tokens_lemmatized",
)
SPLIT_COLUMNS = ("doc_id", "label", "text_raw", "text_clean", "text_expanded", *TOKEN_COLUMNS)
SPLIT_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("text_raw", "text_clean", "text_expanded")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in TOKEN_COLUMNS]
    + [T.StructField("split", T.StringType())]
)
_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
_LABELS = "doc_id long, quality int, toxic int"


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small input out to all cores.

    A scan with fewer splits than cores would leave most of them idle during the
    text functions. A large input has far more splits and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def load_documents(
    spark: SparkSession, folder: str, columns: Sequence[str] = ("doc_id", "text")
) -> DataFrame:
    docs = spark.read.schema(_DOCUMENTS).parquet(f"{folder}/documents.parquet")
    return spread_small(docs.select(*columns), "doc_id")


def load_corpus(
    spark: SparkSession, folder: str, label: str = "quality",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows (doc_id, text, label) and ``extra`` columns, partitioned by document.

    Extra columns are computed before the join, so that a text only they read
    does not have to move.

    The shuffled join is asked for on purpose: everything downstream groups by
    document and can reuse its partitioning.
    """
    more = [c.alias(name) for name, c in (extra or {}).items()]
    docs = load_documents(spark, folder).select("*", *more)
    labels = spark.read.schema(_LABELS).parquet(f"{folder}/labels.parquet")
    wanted = labels.select("doc_id", F.col(label).alias("label"))
    return docs.join(wanted.hint("shuffle_hash"), "doc_id")


def write_splits(docs: DataFrame, path: str, columns: Sequence[str] = SPLIT_COLUMNS) -> None:
    """One table, partitioned by split, with a fixed column order."""
    docs.select(*columns, "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    columns: Sequence[str] | None = None,
    schema: T.StructType = SPLIT_SCHEMA,
) -> DataFrame:
    """Chosen columns of one split; other partitions and columns are not read."""
    df = spark.read.schema(schema).parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select(*columns) if columns else df
