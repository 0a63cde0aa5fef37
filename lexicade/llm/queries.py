"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicade.llm import (
    ctw, dartminhash, decontaminate, hashtree, maxscore, merkle, packing, pii, planes, spans, spotsigs, toxicity,
    variants,
)
from lexicade.llm.stage import Stage, documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@_query()
def op4_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    found = dartminhash.near_duplicates(documents(spark, folder), Stage(spark))
    return found.select("doc_id", "class_id", F.col("n_class").cast("long").alias("n_class"), "keep")


@_query(decontaminate.ORACLE)
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.contamination(
        documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), Stage(spark))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@_query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fifth."""
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, toxicity.training_labels(labels))
    scored = toxicity.scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@_query()
def op1_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.extract(documents(spark, folder), Stage(spark), ["doc_id"])
    return found.select(
        "doc.doc_id", *[pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_found"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; every worker has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query()
def op2_shuffled_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, as read back from the written planes."""
    file = planes.write(documents(spark, folder), Stage(spark), tokenizer_file("word_bpe_49k.json"))
    return planes.read(file)


@_query()
def op9_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 1024 tokens."""
    return packing.pack(documents(spark, folder), Stage(spark), tokenizer_file("byte_bpe_50k.json"))


@_query()
def op5_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of 24, in two regions of three racks of four."""
    tree = hashtree.Tree.even(regions=2, racks=3, shards=4)
    placed = hashtree.assign(documents(spark, folder), Stage(spark), tree)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                         "grown_shard", "region", "rack")


@_query()
def op8_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the sentences of non-first repeated spans."""
    docs = documents(spark, folder).select("doc_id", "text")
    return spans.without_repeats(docs, Stage(spark))


@_query()
def op6_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return spotsigs.fingerprints(documents(spark, folder))


@_query()
def op3_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, learnt outside the held-out fifth."""
    return ctw.score(documents(spark, folder), Stage(spark))


@_query(maxscore.ORACLE)
def op11_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    """The five best vectors for every fiftieth one."""
    found = maxscore.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), Stage(spark))
    return found.select("query_id", "rank", "vec_id", "score")


@_query(merkle.ORACLE)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and check against the root."""
    return merkle.manifest(documents(spark, folder), Stage(spark))


@_query(variants.ORACLE)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word with its near words, its form and the end of its forms."""
    return variants.variants(documents(spark, folder), Stage(spark))
