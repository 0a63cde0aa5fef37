"""Exact deduplication and the stratified split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
# rows of a label up to 50 % are train, up to 85 % validation, the rest test
SPLIT_ENDS = (50, 85)
SEED = "42"
# leading hex digits of the ordering key that form a bucket: 65,536 buckets
_BUCKET_DIGITS = 4


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def drop_duplicate_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Keep the first row (lowest key) of every distinct text.

    Only digests are grouped, with map-side combining, so that many copies of
    one text stay cheap; the rows themselves move once, to the join on the key.
    """
    return first_of_digest(docs, text_digest(text), key)


def first_of_digest(docs: DataFrame, digest: Column | str, key: str = "doc_id") -> DataFrame:
    """The row of lowest key of every digest; where that is a column, no text is needed."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    first = docs.groupBy(digest).agg(F.min(key).alias(key)).select(key)
    return docs.join(first.hint("shuffle_hash"), key, "left_semi")


def duplicate_report(docs: DataFrame, text: str = "text") -> DataFrame:
    per_text = docs.groupBy(text_digest(text)).agg(F.count("*").alias("n"))
    rows, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return per_text.agg(
        rows.alias("rows_in"), kept.alias("rows_kept"), (rows - kept).alias("rows_removed")
    )


def _order_key(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def split_cuts(
    docs: DataFrame, label: str, key: str, ends: Sequence[int], seed: str
) -> DataFrame:
    """Per label, the ordering key of the last row of every split but the last.

    Rows are counted per key bucket; only the buckets that hold a boundary are
    ranked, so no label is ever sorted in one task.
    """
    h = _order_key(key, seed)
    keyed = docs.select(label, key, h.alias("_h"), F.substring(h, 1, _BUCKET_DIGITS).alias("_b"))
    by_label = Window.partitionBy(label)
    wanted = (
        keyed.groupBy(label, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_label.orderBy("_b")))
        .withColumn("_all", F.sum("_n").over(by_label))
        .withColumn("_cut", F.explode(F.array(*[
            F.struct(F.lit(i).alias("no"), F.expr(f"(_all * {end}) div 100").alias("rank"))
            for i, end in enumerate(ends)
        ])))
        .where("_cut.rank > _upto - _n AND _cut.rank <= _upto")
        .select(label, "_b", "_cut.no", (F.col("_cut.rank") - F.col("_upto") + F.col("_n"))
                .alias("_nth"))
    )
    # one row per label and cut, so the broadcast is bounded by the label count
    in_bucket = Window.partitionBy(label, "no").orderBy("_h", key)
    at_cut = (
        keyed.join(F.broadcast(wanted), [label, "_b"])
        .withColumn("_rn", F.row_number().over(in_bucket))
        .where("_rn = _nth")
    )
    return at_cut.groupBy(label).agg(*[
        F.max(F.when(F.col("no") == i, F.struct("_h", key))).alias(f"_cut{i}")
        for i in range(len(ends))
    ])


def stratified_split(
    docs: DataFrame,
    label: str = "label",
    key: str = "doc_id",
    ends: Sequence[int] = SPLIT_ENDS,
    names: Sequence[str] = SPLITS,
    seed: str = SEED,
) -> DataFrame:
    """Add ``split`` with exact shares of every label, by a seeded hash order."""
    cuts = split_cuts(docs, label, key, ends, seed)
    here = F.struct(_order_key(key, seed).alias("_h"), F.col(key))
    split = F.lit(names[-1])
    for i in reversed(range(len(ends))):
        split = F.when(here <= F.col(f"_cut{i}"), names[i]).otherwise(split)
    joined = docs.join(F.broadcast(cuts), label, "left")
    return joined.select(*docs.columns, split.alias("split"))


def split_profile(docs: DataFrame, label: str = "label") -> DataFrame:
    """Rows and class share per split and label."""
    counts = docs.groupBy("split", label).agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy("split"))
    return counts.withColumn("share", F.col("n_rows") / total)


def first_rows(docs: DataFrame, n: int = 5, key: str = "doc_id") -> DataFrame:
    """The first n rows of every split, by key."""
    rank = F.row_number().over(Window.partitionBy("split").orderBy(key))
    return docs.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")
