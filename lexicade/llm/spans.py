"""Repeated passages, by the hashes of runs of consecutive sentences.

A sentence ends at . ! or ? before white space or the end, or at a line break; white space
after it belongs to it, so that a text is the concatenation of its sentences. They compare
lowered, with white space collapsed. Spans are single sentences with at least ``words[0]``
words, pairs with ``words[1]``, and runs of three or more with ``words[2]`` that would have
fewer without their first or without their last sentence, or be fewer than three. Which they
are depends on the sentences alone, so equal passages have equal spans, and the spans of a
passage that meets one of the three bounds cover all its sentences. A sentence counts one word at
least, so a run has at most max(3, ``words[2]``) sentences. All spans are joined globally;
the first occurrence of a span, by doc_id and place, stays, and the sentences that any other
occurrence covers are removed.

Spans are compared by a 64-bit hash and their number of characters. Occurrences are counted
with map-side combining and joined to the repeated spans only, so a passage that a third of all
texts share is nowhere in one task.

Defined cases: a null text stays null and has no sentence; an empty text stays empty; rows that
repeat exactly are one document and are changed alike; null doc_ids come first; other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicade.llm.stage import NO_ID, Stage, keyed

WORDS = (40, 25, 10)
_SENTENCE = r"(?:[^.!?\n]++|[.!?](?!\s|$))++(?:[.!?\n]\s*+)?|[.!?\n]\s*+"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))


def _facts(s: Column) -> Column:
    """Hash, words and characters of every sentence."""
    def of(x: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
        return F.struct(F.xxhash64(plain).alias("h"), F.size(F.split(plain, " ")).alias("w"),
                        F.length(plain).alias("c"))
    return F.transform(s, of)


def _spans(facts: Column, words: tuple[int, int, int]) -> Column:
    """Structs (key, size, at, n) of all spans."""
    longest = max(3, words[2])

    def total(name: str, i: Column, n: Column) -> Column:
        return F.aggregate(F.slice(facts, i + 1, n), F.lit(0), lambda s, x: s + x[name])

    def of(x: Column, i: Column) -> Column:
        y, z, v = (F.get(facts, i + k) for k in (1, 2, 3))
        three = x["w"] + y["w"] + z["w"]
        n = F.array_compact(F.array(
            F.when(x["w"] >= words[0], 1), F.when(x["w"] + y["w"] >= words[1], 2), F.when(three >= words[2], 3)))
        if longest > 3:
            more = F.filter(
                F.sequence(F.lit(4), F.lit(longest)),
                lambda n: (i + n <= F.size(facts)) & (total("w", i, n) >= words[2])
                & ((total("w", i, n - 1) < words[2]) | (total("w", i + 1, n - 1) < words[2])))
            # elsewhere the run of three, or one within any longer run, has the words
            few = (three < words[2]) | (y["w"] + z["w"] + v["w"] < words[2])
            n = F.when(few, F.concat(n, more)).otherwise(n)
        return F.transform(n, lambda n: F.struct(
            F.xxhash64(F.transform(F.slice(facts, i + 1, n), lambda s: s["h"])).alias("key"),
            total("c", i, n).alias("size"), i.alias("at"), n.alias("n")))

    return F.flatten(F.transform(facts, of))


def repeated(docs: DataFrame, stage: Stage, words: tuple[int, int, int] = WORDS) -> DataFrame:
    """(doc_id, text_hash, cut): the (at, n) runs of sentences to remove, of the documents that have any."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _facts(sentences(text)).alias("facts"))
    rows = rows.select("doc_id", "text_hash", F.explode(_spans(F.col("facts"), words)).alias("x"))
    seen = stage.keep(rows.select("x.key", "x.size", "doc_id", "text_hash", "x.at", "x.n"), "spans")
    place = F.struct("doc_id", "text_hash", "at")
    more = stage.keep(
        seen.groupBy("key", "size").agg(F.min(place).alias("first"), F.count("*").alias("m"))
        .where("m > 1").select("key", "size", "first"), "repeated")
    again = seen.join(more.hint("merge"), ["key", "size"]).where(~place.eqNullSafe(F.col("first")))
    return stage.keep(
        again.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "n")).alias("cut")), "cuts")


def without_repeats(docs: DataFrame, stage: Stage, words: tuple[int, int, int] = WORDS) -> DataFrame:
    """``docs`` with their texts freed of repeats, and the columns n_sentences and n_removed."""
    cuts = repeated(docs, stage, words).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("text_hash").alias("h"), "cut")
    rows = keyed(docs).join(cuts.hint("merge"), ["i", "h"], "left").withColumn(
        "s", F.coalesce(sentences(F.col("text")), F.array().cast("array<string>")))
    out = F.flatten(F.transform("cut", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("s") - 1), out)
    kept = F.when(F.col("cut").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("s"), i)), ""))
    removed = F.when(F.col("cut").isNull(), 0).otherwise(F.size(F.array_distinct(out)))
    return rows.select(
        *[kept.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns],
        F.size("s").cast("long").alias("n_sentences"), removed.cast("long").alias("n_removed"))
