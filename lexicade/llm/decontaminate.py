"""Benchmark passages in documents, by a broadcast set of word windows.

Words are runs of digits, letters a-z (A-Z lowered) and characters outside ASCII. A window is
``size`` consecutive words of a benchmark item; an item with fewer words is one window, one
without words has none. A document word inside any occurrence of a window is hit.

The windows' own texts are the keys of the broadcast set, so a found key is a verified hit.
The set is broadcast up to ``MOST_BYTES``, measured before; a larger one is joined by a shuffle.
Documents are screened first: a window's longest pair of neighbouring words must be in a
document that holds the window, so only documents with one of those pairs build their own
windows. The screen compares in upper case, which keeps a superset; it never decides a hit.
It is left out where its pairs are more than ``MOST_ANCHORS`` or ``ANCHOR_BYTES``.

Defined cases: a null or wordless text has no words and no hits; repeated rows are judged
row by row; a null doc_id is kept; items with equal windows all count; with an empty
benchmark nothing is hit; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicade.llm.stage import NO_ID, Stage, keyed

MOST_BYTES = 64 << 20
# of a row of the broadcast set beside its text
ROW_BYTES = 64
MOST_ANCHORS = 20_000
ANCHOR_BYTES = 2 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _parts(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def words(text: Column | str) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return _parts(F.translate(text, _UPPER, _LOWER))


def _windows(w: Column, size: int) -> Column:
    """Structs (at, window): every run of ``size`` words, with the place of its first (from 1)."""
    last = F.size(w) - F.lit(size - 1)
    at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice(w, i, size), " ").alias("window")))


def _placed(w: Column, size: int) -> Column:
    return F.transform(_windows(w, size), lambda x: F.struct(
        x["at"].alias("first"), (x["at"] + (size - 1)).alias("last"), x["window"].alias("window")))


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, window, length) without repeats."""
    items = benchmark.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    whole = F.array(F.struct(F.lit(1).alias("at"), F.array_join("w", " ").alias("window")))
    found = F.when(F.size("w") < size, whole).otherwise(_windows(F.col("w"), size))
    return (
        items.select("item_id", F.least(F.size("w"), F.lit(size)).alias("length"),
                     F.explode(found).alias("x"))
        .select("item_id", "length", "x.window").distinct()
    )


def _pairs(w: Column) -> Column:
    """Every word with the one after it; the last word alone."""
    return F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                      lambda x, y: F.concat_ws(" ", x, y))


def _anchors(windows: DataFrame) -> list[str] | None:
    """The longest pair of each window, or its one word, in upper case; None if they are too many or too long."""
    w = F.split("window", " ")
    pairs = F.slice(_pairs(w), F.lit(1), F.greatest(F.size(w) - 1, F.lit(1)))
    longest = F.array_max(F.transform(pairs, lambda x: F.struct(F.length(x), x.alias("x"))))["x"]
    found = windows.select(F.upper(longest).alias("x")).distinct()
    size = found.agg(F.count("*").alias("n"), F.sum(F.octet_length("x")).alias("bytes")).first()
    if size.n > MOST_ANCHORS or (size.bytes or 0) > ANCHOR_BYTES:
        return None
    return [r.x for r in found.collect()]


def covered(spans: Column) -> Column:
    """Number of places in any of the (first, last) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))
    return F.aggregate(
        F.array_sort(spans), zero,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"] - 1, s["last"]))).alias("n"),
            F.greatest(s["last"], x["last"]).alias("last")),
        lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, stage: Stage, size: int = 10) -> DataFrame:
    """Every row's (doc_id, text_hash, n_words, n_hit, items, spans).

    items: sorted ids, as strings, of the items that occur; spans: the (first, last) words,
    from 1, of every occurring window.
    """
    windows = stage.keep(benchmark_windows(benchmark, size), "windows")
    of = windows.agg(F.sum(F.octet_length("window") + ROW_BYTES).alias("bytes"),
                     F.collect_set("length").alias("lengths")).first()
    lengths = of.lengths  # at most ``size``
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"),
                       _parts(F.upper(text)).alias("u"))
    anchors = _anchors(windows)
    if anchors is None:
        may = F.lit(True)
    elif anchors:
        alone = [a for a in anchors if " " not in a]
        both = [a for a in anchors if " " in a]
        may = F.lit(False)
        if both:
            may = may | F.arrays_overlap(_pairs(F.col("u")), F.array(*map(F.lit, both)))
        if alone:
            may = may | F.arrays_overlap("u", F.array(*map(F.lit, alone)))
    else:
        may = F.lit(False)
    rows = stage.keep(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash",
        F.size("u").cast("long").alias("n_words"), F.when(may, words("text")).alias("w")), "words")

    own = rows.where("w is not null")
    lists = [_placed(F.col("w"), n) for n in sorted(lengths)]
    if not lists:
        lists = [F.array().cast("array<struct<first:int,last:int,window:string>>")]
    found = own.select("row", F.explode(F.concat(*lists)).alias("x")).select("row", "x.*")
    # the hint keeps a plan that broadcasts on estimates from a set that is too large
    small = F.broadcast(windows) if (of.bytes or 0) <= MOST_BYTES else windows.hint("merge")
    hits = found.join(small.select("item_id", "window"), "window").groupBy("row").agg(
        F.collect_set(F.struct("first", "last")).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = stage.keep(hits, "hits")
    none = F.array().cast("array<string>")
    return rows.drop("w").join(hits, "row", "left").select(
        "doc_id", "text_hash", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), "spans")


def _bad(docs: DataFrame, benchmark: DataFrame, stage: Stage, size: int, *columns: str) -> DataFrame:
    """Keys (i, h) of the documents that are hit, and chosen columns of theirs."""
    found = contamination(docs, benchmark, stage, size).where("n_hit > 0").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("text_hash").alias("h"), *columns)
    return stage.keep(found.dropDuplicates(["i", "h"]), "bad")


def without_documents(docs: DataFrame, benchmark: DataFrame, stage: Stage, size: int = 10) -> DataFrame:
    """The rows of ``docs`` in which nothing is hit."""
    bad = _bad(docs, benchmark, stage, size)
    return keyed(docs).join(bad.hint("merge"), ["i", "h"], "left_anti").select("doc.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, stage: Stage, size: int = 10) -> DataFrame:
    """All rows of ``docs``; the words of occurring windows are cut out of their texts."""
    bad = _bad(docs, benchmark, stage, size, "spans")
    rows = keyed(docs).join(bad.hint("merge"), ["i", "h"], "left")
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gaps = F.split("text", inside)  # one more than there are words
    hit = F.flatten(F.transform("spans", lambda x: F.sequence(x["first"], x["last"])))
    own = _parts(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(1), F.size(own)), hit)
    kept = F.concat(
        F.array_join(F.transform(stay, lambda i: F.concat(F.element_at(gaps, i), F.element_at(own, i))), ""),
        F.element_at(gaps, -1))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept)
    return rows.select(*[
        text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
places AS (SELECT r, count(DISTINCT p) AS n_hit
           FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
