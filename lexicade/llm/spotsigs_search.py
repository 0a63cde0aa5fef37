"""Similar documents by SpotSigs: fingerprints by set length, rare signatures, pruned Jaccard.

Texts of equal fingerprints are one node. ``setjoin`` partitions them by set length, lets those
meet that share a rare signature, and compares them exactly. Pairs are counted, never listed.

Defined cases: a null text is empty; a text without anchors has the one signature that
``spotsigs`` gives it; rows of one fingerprint have the same class and number of links;
a null doc_id is a row like any other and comes last in a class; an empty table gives no row;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicade.llm.components import components
from lexicade.llm.setjoin import ELEMENTS, lists_of, similar_sets
from lexicade.llm.spotsigs import CHAIN, signatures
from lexicade.llm.stage import Stage
from lexicade.llm.textbytes import blocks, release


def _sign(chain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b, _, _ in blocks(column):
                s, of = signatures(column.slice(a, b - a), chain)
                lengths = np.bincount(of, minlength=b - a)
                edges = np.r_[0, np.cumsum(lengths)]
                keys = [hashlib.blake2b(s[x:y].tobytes(), digest_size=16).digest()
                        for x, y in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a),
                     pa.array(keys, pa.binary()), lists_of(s.view(np.int32), lengths)],
                    names=["doc_id", "text_hash", "node", "signs"])
        release()
    return run


def similar_documents(
    docs: DataFrame, stage: Stage, least: float = 0.8, chain: int = CHAIN, elements: int = ELEMENTS,
) -> DataFrame:
    """(doc_id, text_hash, class_id, n_class, n_links) for every row of ``docs``.

    n_links is the number of other fingerprints whose similarity is at least ``least``,
    class_id the least doc_id of all rows such links join, n_class their number.
    """
    if not 0 < least <= 1 or not math.isfinite(least):
        raise ValueError("least must be above 0 and at most 1")
    text = F.coalesce("text", F.lit(""))
    signed = stage.keep(
        docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
            _sign(chain), "doc_id long, text_hash long, node binary, signs array<int>"), "spots")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = signed.groupBy("node").agg(F.min(order).alias("rep"), F.count("*").alias("n_rows"))
    sets = signed.select("node", F.col("node").alias("root"), "signs").dropDuplicates(["node"])
    sets = stage.keep(sets, "sets")
    found = similar_sets(sets, stage, "similar", least, elements)
    count = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    final = components(found.where("b is not null").select("a", "b"), stage, "similar")
    rooted = stage.keep(
        nodes.join(final, "node", "left").join(count, "node", "left")
        .select("node", "rep", "n_rows", F.coalesce("root", "node").alias("root"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "rooted")
    classes = rooted.groupBy("root").agg(F.min("rep").alias("best"), F.sum("n_rows").alias("n_class"))
    table = stage.keep(rooted.join(classes, "root").select("node", "best", "n_class", "n_links"), "classes")
    return signed.select("doc_id", "text_hash", "node").join(table, "node").select(
        "doc_id", "text_hash", F.col("best.doc_id").alias("class_id"), "n_class", "n_links")
