"""Concepts: groups of n-grams, from embeddings and lexicon polarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicade.functions import lexicons as lx
from lexicade.functions import stats
from lexicade.functions.text import display_label
from lexicade.operators.coding import ROWS_AT_A_TIME, dictionary
from lexicade.operators.joins import attach_small, join_per_key
from lexicade.operators.ranking import top_per_group
from lexicade.operators.vocabulary import units as token_units

ITERATIONS = 20
SIZE = 64
SEED = 42
# words that a task adds up before it hands their sums on, tokens whose windows are made at a time
HELD_WORDS = 1 << 17
TOKENS_AT_A_TIME = 1 << 15
# centroids are handed to the executors in blocks of at most this many numbers
BLOCK_NUMBERS = 4_000_000
# a lexicon of at most so many rows is looked up within a unit's row
LISTED = 1000


# ----------------------------------------------------------------- polarity ---
def valence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(lx.VALENCES.items()), "token string, valence double")


def polarity(
    units: DataFrame, valences: DataFrame, unit: str = "term",
    negators: Sequence[str] = lx.NEGATORS,
) -> DataFrame:
    """Add ``score`` in (-1, 1) to a table of distinct units.

    Valences of the unit's tokens are summed; a negator among the three tokens
    before one turns its valence around. ``valences`` is a lexicon, one row per
    token. A short one goes into the plan: units are neither taken apart nor shuffled.
    """
    words = F.split(F.lower(F.col(unit)), " ")
    listed = valences.select("token", F.col("valence").cast("double").alias("valence")).limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        return units.withColumn("score", _score_in_row(words, listed, negators))
    rows = units.select(unit, words.alias("_w")).select(
        unit, "_w", F.posexplode("_w").alias("_i", "token"))
    before = F.slice("_w", F.greatest(F.col("_i") - lx.NEGATION_REACH, F.lit(0)) + 1,
                     F.least(F.col("_i"), F.lit(lx.NEGATION_REACH)))
    negated = F.exists(before, lambda t: t.isin(*negators))
    found = attach_small(rows, valences, "token")
    sums = (
        found.withColumn("_v", F.col("valence") * F.when(negated, lx.NEGATION_FACTOR)
                         .otherwise(1.0))
        .groupBy(unit).agg(F.sum("_v").alias("_s"))
    )
    return units.join(sums, unit, "left").withColumn(
        "score", F.coalesce(stats.signed_unit(F.col("_s"), lx.POLARITY_ALPHA), F.lit(0.0))
    ).drop("_s")


def _score_in_row(words: Column, listed: Sequence, negators: Sequence[str]) -> Column:
    """``polarity`` of an array of words, for the rows of a short lexicon."""
    valence: dict[str, float] = {}
    for token, value in listed:
        if token is not None and value is not None:
            valence[token] = valence.get(token, 0.0) + value
    if not valence:
        return F.lit(0.0)
    lookup = F.create_map(*[F.lit(x) for pair in valence.items() for x in pair])

    def weighed(word: Column, i: Column) -> Column:
        before = F.slice(words, F.greatest(i - lx.NEGATION_REACH, F.lit(0)) + 1, F.least(i, F.lit(lx.NEGATION_REACH)))
        sign = F.when(F.exists(before, lambda t: t.isin(*negators)), lx.NEGATION_FACTOR).otherwise(1.0)
        return F.when(word.isin(*valence), F.try_element_at(lookup, word) * sign).otherwise(0.0)

    total = F.aggregate(F.transform(words, weighed), F.lit(0.0), lambda a, x: a + x)
    # most units have no listed word
    found = F.exists(words, lambda t: t.isin(*valence))
    return F.when(found, F.coalesce(stats.signed_unit(total, lx.POLARITY_ALPHA), F.lit(0.0))).otherwise(0.0)


# --------------------------------------------------------------- embeddings ---
def vector_length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit_length(v: Column) -> Column:
    """The vector divided by its length, in double precision."""
    d = v.cast("array<double>")
    # a function of each number would make the length anew for every one
    return F.zip_with(d, F.array_repeat(vector_length(d), F.size(d)), F.try_divide)


def _signs(word: Column, size: int) -> list[Column]:
    """-1 or 1 per dimension, from the bits of the word's MD5 digest."""
    parts = [F.conv(F.substring(F.md5(word), 8 * i + 1, 8), 16, 10).cast("long")
             for i in range(-(-size // 32))]
    return [F.shiftright(parts[d // 32], d % 32).bitwiseAND(F.lit(1)) * 2 - 1 for d in range(size)]


def _sign_rows(words: Sequence[str], size: int) -> np.ndarray:
    """``_signs`` of many words, a row each."""
    digests = b"".join(hashlib.md5(w.encode()).digest() for w in words)
    numbers = np.frombuffer(digests, dtype=">u4").reshape(len(words), 4).astype(np.int64)
    at = np.arange(size)
    return ((numbers[:, at // 32] >> (at % 32) & 1) * 2 - 1).astype(np.int32)


def _window_sums(signs: np.ndarray, ids: np.ndarray, doc: np.ndarray, window: int, lo: int, hi: int) -> np.ndarray:
    """For the tokens lo to hi: the summed signs of all tokens of the same document at most ``window`` away."""
    a, b = max(0, lo - window), min(len(ids), hi + window)
    sums = np.zeros((b - a + 1, signs.shape[1]), dtype=np.int32)
    np.cumsum(signs[ids[a:b]], axis=0, out=sums[1:])
    at, here = np.arange(lo, hi), doc[lo:hi]
    first = np.maximum(np.searchsorted(doc, here), at - window)
    last = np.minimum(np.searchsorted(doc, here, side="right"), at + window + 1)
    return sums[last - a] - sums[first - a]


def _neighbour_sums(known: Broadcast | None, size: int, window: int):
    """Rows (word, sums) of some documents' known words: a task adds up HELD_WORDS words before it hands them on."""
    def rows(held: dict[str, int], sums: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(sums[:len(held)].reshape(-1))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), *[flat[d::size] for d in range(size)]],
            names=["word", *[f"v{d}" for d in range(size)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        sums = np.zeros((HELD_WORDS, size), dtype=np.int64)
        for batch in (b.slice(lo, ROWS_AT_A_TIME) for b in batches for lo in range(0, b.num_rows, ROWS_AT_A_TIME)):
            lists = batch.column(0)
            lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            words = coded.dictionary.to_pylist()
            # a null is no word: it has no signs and no row
            ids = pc.fill_null(coded.indices, len(words)).to_numpy(zero_copy_only=False)
            signs = np.concatenate([_sign_rows(words, size), np.zeros((1, size), dtype=np.int32)])
            wanted = np.ones(len(words) + 1, dtype=bool)
            if known is not None:
                wanted[:-1] = pc.is_in(coded.dictionary, value_set=known.value).to_numpy(zero_copy_only=False)
            wanted[-1] = False
            for lo in range(0, len(ids), TOKENS_AT_A_TIME):
                hi = min(len(ids), lo + TOKENS_AT_A_TIME)
                near = _window_sums(signs, ids, doc, window, lo, hi)
                mine = np.flatnonzero(wanted[ids[lo:hi]])
                mine = mine[np.argsort(ids[lo:hi][mine], kind="stable")]
                word = ids[lo:hi][mine]
                if not len(word):
                    continue
                at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                if len(held) + len(at) > HELD_WORDS:
                    yield rows(held, sums)
                    held, sums = {}, np.zeros((HELD_WORDS, size), dtype=np.int64)
                places = [held.setdefault(words[w], len(held)) for w in word[at]]
                sums[places] += np.add.reduceat(near[mine], at, axis=0)
        if held:
            yield rows(held, sums)
    return run


def word_vectors(
    docs: DataFrame, words: DataFrame, tokens: str = "tokens", size: int = SIZE, window: int = 5,
) -> DataFrame:
    """Rows (word, vector): the summed signs of all words around the word's occurrences.

    The occurrence itself is in its window. A word whose sum is zero, or that ``docs``
    lack, has its own signs. A task adds up the windows of its own documents, so that a row
    per word and task is shuffled, not one per pair of words; the sums are whole numbers, the
    same on any cluster. ``size`` is at most 128.
    """
    some = words.where("word is not null")
    known = dictionary(some)
    fields = ", ".join(f"v{d} long" for d in range(size))
    parts = docs.select(token_units(tokens).alias("_t")).mapInArrow(
        _neighbour_sums(known, size, window), f"word string, {fields}")
    if known is None:
        parts = parts.join(some.select("word").distinct(), "word", "left_semi")
    sums = parts.groupBy("word").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(size)])
    summed = sums.select("word", F.array(*[f"v{d}" for d in range(size)]).alias("_v"))
    own = F.array(*_signs(F.col("word"), size))
    usable = F.exists("_v", lambda x: x != 0)
    return words.join(summed, "word", "left").select(
        "word", F.when(usable, F.col("_v")).otherwise(own).cast("array<double>").alias("vector"))


def embed_words(
    docs: DataFrame, units: DataFrame, tokens: str = "tokens", unit: str = "term",
    size: int = SIZE, window: int = 5,
) -> DataFrame:
    """``units`` with ``embedding``: the mean of their words' vectors, at unit length.

    Every unit keeps its row. Word vectors (``word_vectors``) come from ``docs`` and are
    brought to unit length first; where a mean is zero the first word's vector stands.
    """
    split = units.select(unit, F.posexplode(F.split(F.col(unit), " ")).alias("_i", "word"))
    vectors = word_vectors(docs, split.select("word").distinct(), tokens, size, window).select(
        "word", unit_length(F.col("vector")).alias("v"))
    # a unit has a few words
    parts = split.join(vectors, "word").groupBy(unit).agg(
        F.array_sort(F.collect_list(F.struct("_i", "v"))).alias("_p"))
    first = F.col("_p")[0]["v"]
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate("_p", zero, lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y))
    mean = parts.select(unit, first.alias("_first"), total.alias("_sum"))
    length = vector_length(F.col("_sum"))
    return units.join(mean.select(
        unit, F.when(length > 1e-9, unit_length(F.col("_sum"))).otherwise(F.col("_first")).alias("embedding")),
        unit)


def embed_word2vec(
    docs: DataFrame, units: DataFrame, tokens: str = "tokens", unit: str = "term",
    size: int = SIZE, seed: int = SEED, partitions: int = 8, max_iter: int = 1, min_count: int = 1,
) -> DataFrame:
    """As ``embed_words``, with trained word vectors; units without a known word fail loudly.

    Spark's Word2Vec holds the whole vocabulary on the driver and in every task, so this is
    for vocabularies that fit there.
    """
    model = Word2Vec(
        vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions, maxIter=max_iter,
        inputCol=tokens, outputCol="_mean", windowSize=5,
    ).fit(docs.select(tokens))
    split = units.withColumn(tokens, F.split(F.col(unit), " "))
    mean = vector_to_array(F.col("_mean"))
    embedded = model.transform(split).withColumn("embedding", mean).drop("_mean", tokens)
    length = vector_length(F.col("embedding"))
    missing = F.raise_error(F.concat(F.lit("no vector for unit "), F.col(unit)))
    return embedded.withColumn("embedding", F.when(length > 0, unit_length(F.col("embedding"))).otherwise(
        missing.cast("array<double>")))


def embed_with(
    units: DataFrame, make_encoder: Callable, unit: str = "term", batch_size: int = 256
) -> DataFrame:
    """Rows (unit, embedding) from a user's encoder.

    ``make_encoder`` runs once per worker and returns a function from an array of
    strings to a matrix.
    """
    encode = predict_batch_udf(
        make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return units.withColumn("embedding", unit_length(encode(F.col(unit))))


def augment(embedding: Column | str, score: Column | str, weight: float) -> Column:
    """Append the weighted polarity and bring the vector back to unit length."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    s = F.col(score) if isinstance(score, str) else score
    return unit_length(F.concat(e.cast("array<double>"), F.array(F.lit(float(weight)) * s)))


# --------------------------------------------------------------- clustering ---
def fit_concepts(
    vectors: DataFrame, k: int, vector: str = "vector", seed: int = SEED,
    iterations: int = ITERATIONS,
) -> tuple[DataFrame, DataFrame]:
    """k-means into ``min(k, rows)`` concepts.

    Returns (rows with concept_id, centroids). Rows are assigned with the raw
    centroids; only the returned centroids are scaled to unit length.
    """
    spark = vectors.sparkSession
    k = min(k, vectors.count())
    data = vectors.withColumn("_v", array_to_vector(F.col(vector)))
    model = KMeans(
        k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="concept_id"
    ).fit(data)
    assigned = model.transform(data).drop("_v")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = spark.createDataFrame(rows, "concept_id int, centroid array<double>")
    return assigned, centroids.withColumn("centroid", unit_length(F.col("centroid")))


def nearest_centroid(
    points: DataFrame, centroids: DataFrame, vector: str = "embedding", id_col: str = "concept_id",
    centroid: str = "centroid",
) -> DataFrame:
    """Add the id and squared distance of the nearest centroid (lowest id on ties).

    Centroids reach the executors in blocks of bounded size; a running minimum
    over the blocks makes the result exact for any number of them.
    """
    ordered = centroids.select(
        F.col(id_col).cast("long"), F.col(centroid).cast("array<double>")).orderBy(id_col)
    best = F.lit(None).cast("struct<dist:double,id:bigint>")
    ids: list[int] = []
    rows: list[list[float]] = []
    for cid, vec in ordered.toLocalIterator():
        ids.append(cid)
        rows.append(vec)
        if len(rows) * len(vec) >= BLOCK_NUMBERS:
            best = F.least(best, _nearest_in_block(ids, rows)(F.col(vector)))
            ids, rows = [], []
    if rows:
        best = F.least(best, _nearest_in_block(ids, rows)(F.col(vector)))
    return points.withColumn("_best", best).select(
        *points.columns, F.col("_best.id").alias(id_col), F.col("_best.dist").alias("dist"))


def _nearest_in_block(ids: list[int], rows: list[list[float]]):
    matrix, names = np.array(rows, dtype=np.float64), np.array(ids, dtype=np.int64)
    squares = (matrix ** 2).sum(axis=1)

    @F.pandas_udf("dist double, id bigint")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        at = np.empty(len(x), dtype=np.int64)
        for lo in range(0, len(x), 1024):
            part = x[lo:lo + 1024]
            at[lo:lo + 1024] = (squares - 2.0 * (part @ matrix.T)).argmin(axis=1)
        dist = ((x - matrix[at]) ** 2).sum(axis=1)
        return pd.DataFrame({"dist": dist, "id": names[at]})

    return nearest


# ------------------------------------------------------------ concept tables --
def concept_counts(
    counts: DataFrame, unit_map: DataFrame, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Rows (keep..., concept_id, cnt); units without a concept are dropped.

    ``unit_map`` is a stored table (term, concept_id, df).
    """
    mapped = join_per_key(
        counts, unit_map.select("term", "concept_id", "df"), "term", keep[0], "df")
    return mapped.groupBy(*keep, "concept_id").agg(F.sum("cnt").alias("cnt"))


def concept_class_counts(counts: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Rows (concept_id, c_pos, c_neg) for all ids 0..k-1, zero counts included."""
    one = F.col(label) == 1
    got = counts.groupBy("concept_id").agg(
        F.sum(F.when(one, F.col("cnt")).otherwise(F.lit(0))).alias("c_pos"),
        F.sum(F.when(one, F.lit(0)).otherwise(F.col("cnt"))).alias("c_neg"),
    )
    ids = counts.sparkSession.range(k).select(F.col("id").cast("int").alias("concept_id"))
    return ids.join(got, "concept_id", "left").select(
        "concept_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("c_pos", "c_neg")])


def concept_members(unit_map: DataFrame) -> DataFrame:
    """Rows (concept_id, term, label, representative), one per member.

    The representative is the first unit in vocabulary order. Members stay rows:
    a concept may be too large for one array.
    """
    firsts = unit_map.groupBy("concept_id").agg(
        F.min("term").alias("_first"), F.count("*").alias("size"))
    return attach_small(unit_map.select("concept_id", "term"), firsts, "concept_id").select(
        "concept_id", "term", display_label("term").alias("label"),
        display_label("_first").alias("representative"), "size",
    )


def concept_unit_frequencies(counts: DataFrame, unit_map: DataFrame) -> DataFrame:
    """Rows (concept_id, unit, freq): uses of each unit in the given documents."""
    totals = counts.groupBy("term").agg(F.sum("cnt").alias("freq"))
    return totals.join(unit_map.select("term", "concept_id"), "term").select(
        "concept_id", display_label("term").alias("unit"), "freq")


def top_concepts(scored: DataFrame, members: DataFrame, n: int = 5) -> DataFrame:
    """Members of the n concepts with the highest z of each class, long form."""
    both = F.array(
        F.struct(F.lit("Positive").alias("class"), F.col("z").alias("strength")),
        F.struct(F.lit("Negative").alias("class"), (-F.col("z")).alias("strength")),
    )
    sides = scored.select("concept_id", F.explode(both).alias("_s")).select("concept_id", "_s.*")
    best = top_per_group(sides, ["class"], [F.desc("strength"), F.col("concept_id")], n)
    # 2n rows
    return members.join(F.broadcast(best), "concept_id").select(
        "class", "rank", "concept_id", "representative", "label", F.col("strength").alias("z"))
