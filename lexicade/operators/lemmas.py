"""Lemmas of noun forms, accepted only if a dictionary has them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicade.functions.lexicons import NOUN_ENDINGS
from lexicade.operators.joins import BROADCAST_ROWS, HOT_KEYS, SPREAD


def _candidates(token: Column) -> Column:
    """Array of (length, order, lemma) for every ending that fits."""
    made = [
        F.when(
            token.endswith(ending),
            F.struct(
                (F.length(token) - len(ending) + len(new)).alias("size"),
                F.lit(i).alias("order"),
                F.concat(F.left(token, F.length(token) - len(ending)), F.lit(new)).alias("lemma"),
            ),
        )
        for i, (ending, new) in enumerate(NOUN_ENDINGS)
    ]
    return F.array_compact(F.array(*made))


def _has_ending(token: Column) -> Column:
    return token.rlike("(" + "|".join(ending for ending, _ in NOUN_ENDINGS) + ")$")


def distinct_tokens(docs: DataFrame, tokens: str) -> DataFrame:
    """Rows (token, uses); distinct per document first, to shuffle less."""
    return (
        docs.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token").agg(F.count("*").alias("uses"))
    )


def lemma_table(docs: DataFrame, tokens: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Rows (token, lemma, uses) for the tokens with one of the noun endings.

    Of a token and its candidates found in the dictionary, the shortest wins, the
    token first on ties; if none is found the token stays. The default dictionary
    is the vocabulary itself.
    """
    words = distinct_tokens(docs, tokens)
    known = words if dictionary is None else dictionary
    known = known.select(F.col("token").alias("lemma")).distinct()
    own = F.struct(F.length("token").alias("size"), F.lit(-1).alias("order"),
                   F.col("token").alias("lemma"))
    made = _candidates(F.col("token"))
    words = words.where(_has_ending(F.col("token")))
    forms = words.select("token", F.explode(F.concat(F.array(own), made)).alias("_f"))
    best = (
        forms.select("token", "_f.*").join(known, "lemma", "left_semi")
        .groupBy("token").agg(F.min(F.struct("size", "order", "lemma")).alias("_f"))
    )
    return words.join(best, "token", "left").select(
        "token", F.coalesce("_f.lemma", "token").alias("lemma"), "uses")


def repeated_keys(docs: DataFrame, on: Sequence[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """Rows (on...) that ``docs`` have more than once; None if there are none. Only these columns are read."""
    rows = docs.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    n = rows.limit(broadcast_rows + 1).count()
    if not n:
        return None
    return F.broadcast(rows) if n <= broadcast_rows else rows


def with_keys(docs: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """The rows with one of the keys (left_semi) or with none (left_anti); nulls are equal."""
    same = F.lit(True)
    for c in on:
        same = same & docs[c].eqNullSafe(keys[c])
    return docs.join(keys, same, how)


def lemma_lists(lemmas: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> Callable[[Column | str], Column] | None:
    """A function that replaces the tokens of a list by their lemmas within its row; a null list becomes empty.

    None where the stored table ``lemmas`` has too many lemmas that differ from their token to go to all tasks.
    """
    changed = lemmas.where("lemma <> token").select("token", "lemma")
    if changed.limit(broadcast_rows + 1).count() > broadcast_rows:
        return None
    table = changed.toArrow()
    shared = lemmas.sparkSession.sparkContext.broadcast(
        tuple(table[c].combine_chunks().cast(pa.string()) for c in ("token", "lemma")))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def replaced(lists: pa.Array) -> pa.Array:
        tokens, new = shared.value
        codes = lists.flatten().cast(pa.string()).dictionary_encode()  # every distinct token is looked up once
        found = pc.take(new, pc.index_in(codes.dictionary, value_set=tokens))
        flat = pc.take(pc.coalesce(found, codes.dictionary), codes.indices)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array([0, *sizes.cumsum().tolist()], pa.int32()), flat)

    return lambda tokens: replaced(F.col(tokens) if isinstance(tokens, str) else tokens)


def lemmatize(
    docs: DataFrame, lemmas: DataFrame, tokens: str = "tokens_lower", key: str = "doc_id",
    name: str = "tokens_lemmatized", keep: Sequence[str] = (),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows (key, keep..., name): every token replaced by its lemma if it has one.

    ``lemmas`` is a stored table. Where it is small the tokens stay in their row; only rows that
    share their key are taken apart and put together as one.
    """
    on = [key, *keep]
    in_row = lemma_lists(lemmas, broadcast_rows)
    if in_row is None:
        return _lemmatize_apart(docs, lemmas, tokens, key, name, keep, broadcast_rows)
    repeated = repeated_keys(docs.select(*on), on, broadcast_rows)
    if repeated is None:
        return docs.select(*on, in_row(tokens).alias(name))
    single = with_keys(docs, repeated, on, "left_anti").select(*on, in_row(tokens).alias(name))
    several = with_keys(docs, repeated, on, "left_semi")
    return single.unionByName(_lemmatize_apart(several, lemmas, tokens, key, name, keep, broadcast_rows))


def _lemmatize_apart(
    docs: DataFrame, lemmas: DataFrame, tokens: str, key: str, name: str, keep: Sequence[str], broadcast_rows: int,
) -> DataFrame:
    """Tokens travel with their position and return to their document; in the shuffled form the most used tokens are salted."""
    rows = docs.select(key, *keep, F.posexplode_outer(tokens).alias("_pos", "token"))
    table = lemmas.select("token", "lemma", "uses")
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(F.broadcast(table), "token", "left")
    else:
        hot = (
            table.orderBy(F.desc("uses"), "token").limit(HOT_KEYS)
            .select("token", F.lit(True).alias("_hot"))
        )
        slots = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(
            F.array(F.lit(0)))
        spread = table.join(F.broadcast(hot), "token", "left").withColumn(
            "_salt", F.explode(slots)).drop("_hot")
        # tokens without a noun ending match nothing, so any slot will do for them
        slot = F.pmod(F.xxhash64(key, "_pos"), F.lit(SPREAD)).cast("int")
        spreadable = F.col("_hot") | ~_has_ending(F.col("token"))
        rows = rows.join(F.broadcast(hot), "token", "left").withColumn(
            "_salt", F.when(spreadable, slot).otherwise(F.lit(0))).drop("_hot")
        rows = rows.join(spread, ["token", "_salt"], "left")
    ordered = F.array_sort(F.collect_list(F.when(
        F.col("_pos").isNotNull(),
        F.struct("_pos", F.coalesce("lemma", "token").alias("lemma")))))
    grouped = rows.groupBy(key, *keep).agg(ordered.alias("_t"))
    return grouped.select(key, *keep, F.col("_t.lemma").alias(name))
