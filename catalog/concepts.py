"""Queries over concepts and embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from catalog import sql as s
from catalog.registry import r6, register, rounded
from lexicade.functions import lexicons as lx
from lexicade.functions.text import tokenize, lower_tokens
from lexicade.operators import concepts as co
from lexicade.operators import vocabulary as vo
from lexicade.plans import representation as rp
from lexicade.sources.artifacts import Store
from lexicade.sources.corpus import load_documents

K = 200
# squared distance by which the last round of k-means may leave a unit off its nearest mean
MOVE = 0.05


# ---------------------------------------------------------------- polarity ----
def _polarity_sql() -> str:
    values = ", ".join(f"({s.q(t)}, {v}::DOUBLE)" for t, v in lx.VALENCES.items())
    negators = s.in_list(lx.NEGATORS)

    def value(x: str, *before: str) -> str:
        sign = " OR ".join(f"coalesce({b} IN {negators}, false)" for b in before) or "false"
        return (f"coalesce(v_{x} * CASE WHEN {sign} THEN {lx.NEGATION_FACTOR}::DOUBLE "
                "ELSE 1.0::DOUBLE END, 0)")

    # the n-grams are made by position; only those with a listed word are scored
    return f"""WITH lexicon(token, valence) AS (VALUES {values}),
    lows AS MATERIALIZED (SELECT row_number() OVER () AS r, CASE WHEN len(t) = 0 THEN [''] ELSE t END AS t
      FROM (SELECT {s.lower(s.tokens('text'))} AS t FROM documents)),
    spread AS (SELECT r, unnest(t) AS w, unnest(range(len(t))) AS i FROM lows),
    valued AS (SELECT r, i, w, valence AS v FROM spread LEFT JOIN lexicon ON token = w),
    windows AS MATERIALIZED (SELECT w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c,
        v AS v_a, lead(v) OVER o AS v_b, lead(v, 2) OVER o AS v_c
      FROM valued WINDOW o AS (PARTITION BY r ORDER BY i)),
    units AS (
      SELECT DISTINCT a AS term, {value('a')} AS total FROM windows UNION ALL
      SELECT DISTINCT a || ' ' || b, {value('a')} + {value('b', 'a')} FROM windows
        WHERE b IS NOT NULL UNION ALL
      SELECT DISTINCT a || ' ' || b || ' ' || c, {value('a')} + {value('b', 'a')}
        + {value('c', 'a', 'b')} FROM windows WHERE c IS NOT NULL)
    SELECT term, {s.r6(f'total / sqrt(total * total + {lx.POLARITY_ALPHA}::DOUBLE)')} AS score
    FROM units"""


@register("lexicon_polarity", _polarity_sql())
def lexicon_polarity(spark, folder):
    tokens = lower_tokens(tokenize("text"))
    # texts move by document, so that their n-grams are counted where they are made
    docs = load_documents(spark, folder).repartition("doc_id")
    units = vo.term_counts(docs, tokens).select("term").distinct()
    return rounded(co.polarity(units, co.valence_table(spark)), "score")


# -------------------------------------------------------------- embeddings ----
def _vectors(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet")


@register("augment_embedding", f"""WITH e AS (SELECT vec_id,
    list_concat(embedding::DOUBLE[], [10.0::DOUBLE * ((label - 4.5::DOUBLE) / 4.5::DOUBLE)]) AS v
  FROM embeddings),
  n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e)
  SELECT vec_id, unnest(range(0, len(v)))::INT AS pos, {s.r6('unnest(v) / len')} AS x FROM n""")
def augment_embedding(spark, folder):
    score = (F.col("label") - F.lit(4.5)) / F.lit(4.5)
    rows = _vectors(spark, folder).select(
        "vec_id", F.posexplode(co.augment("embedding", score, 10.0)).alias("pos", "x"))
    return rounded(rows, "x")


_NEAREST = """WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x,
    unnest(range(len(embedding))) AS pos FROM embeddings),
  means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY label, pos),
  centroids AS (SELECT label AS concept_id, list(m ORDER BY pos) AS c FROM means GROUP BY label),
  pairs AS (SELECT vec_id, concept_id, list_sum(list_transform(list_zip(embedding, c),
      lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS dist
    FROM embeddings, centroids)
  SELECT vec_id, concept_id::BIGINT AS concept_id, round(dist, 6) + 0.0 AS dist FROM pairs
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, concept_id) = 1"""


@register("nearest_centroid", _NEAREST)
def nearest_centroid(spark, folder):
    points = _vectors(spark, folder)
    parts = points.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one mean vector per label
    centroids = means.groupBy(F.col("label").alias("concept_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"])
        .alias("centroid"))
    return rounded(
        co.nearest_centroid(points.select("vec_id", "embedding"), centroids), "dist"
    ).select("vec_id", "concept_id", "dist")


# ------------------------------------------------- concepts of hashed units ----
def _mapped(spark, folder):
    """Units of the training vocabulary, put into K concepts by a hash."""
    src, store = rp.Source(folder), Store(spark)
    bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"), F.lit(K))
    units = store.table(
        lambda: rp.unit_features(spark, src, store).select(
            "term", "df", bucket.cast("int").alias("concept_id")), "map", k=K, **src.key())
    return src, store, units


_MAP = f"""units AS MATERIALIZED (SELECT term,
  (('0x' || substr(md5(term), 1, 8))::UBIGINT % {K})::INT AS concept_id FROM feats)"""
_CONCEPTS = """concepts AS MATERIALIZED (SELECT doc_id, label, split, concept_id,
  sum(cnt)::BIGINT AS cnt FROM cnts JOIN units USING (term) GROUP BY ALL)"""
_CZ = f"""ccounts AS MATERIALIZED (SELECT i::INT AS concept_id,
    coalesce(sum(cnt) FILTER (WHERE label = 1), 0)::BIGINT AS c_pos,
    coalesce(sum(cnt) FILTER (WHERE label <> 1), 0)::BIGINT AS c_neg
  FROM range({K}) t(i) LEFT JOIN
    (SELECT * FROM concepts WHERE split = 'train') c ON c.concept_id = i GROUP BY i)"""


def _concept_counts(spark, src, store, units):
    matrix = rp.unit_matrix(spark, src, store).drop("df")
    return co.concept_counts(matrix, units, ("doc_id", "label", "split"))


def _concept_scores(spark, src, store, units):
    counts = _concept_counts(spark, src, store, units).where("split = 'train'")
    return store.table(
        lambda: rounded(rp.concept_features(counts, K), "logodds", "z"), "scores", k=K)


@register("concept_counts", s.with_(*s.features(), _MAP, _CONCEPTS) + "SELECT * FROM concepts")
def concept_counts(spark, folder):
    return _concept_counts(spark, *_mapped(spark, folder))


@register("concept_zscores", s.with_(
    *s.features(), _MAP, _CONCEPTS, _CZ, s.scored("ccounts", "cz")) + f"""
  SELECT concept_id, c_pos, c_neg, {s.r6('logodds')} AS logodds, {s.r6('z')} AS z FROM cz""")
def concept_zscores(spark, folder):
    return _concept_scores(spark, *_mapped(spark, folder))


@register("concept_members", s.with_(*s.features(), _MAP) + """SELECT concept_id, term,
    replace(term, ' ', '_') AS label,
    replace(min(term) OVER (PARTITION BY concept_id), ' ', '_') AS representative,
    count(*) OVER (PARTITION BY concept_id) AS size FROM units""")
def concept_members(spark, folder):
    return co.concept_members(_mapped(spark, folder)[2])


@register("concept_unit_freq", s.with_(*s.features(), _MAP) + """SELECT concept_id,
    replace(term, ' ', '_') AS unit, sum(cnt)::BIGINT AS freq
  FROM cnts JOIN units USING (term) WHERE split = 'train' GROUP BY concept_id, term""")
def concept_unit_freq(spark, folder):
    src, store, units = _mapped(spark, folder)
    train = rp.unit_matrix(spark, src, store).where("split = 'train'")
    return co.concept_unit_frequencies(train, units)


@register("top_concepts", s.with_(
    *s.features(), _MAP, _CONCEPTS, _CZ, s.scored("ccounts", "cz"), """
  ranked AS (SELECT *, row_number() OVER (PARTITION BY "class" ORDER BY z DESC, concept_id) AS rank
    FROM (SELECT 'Positive' AS "class", concept_id, round(z, 6) + 0.0 AS z FROM cz UNION ALL
          SELECT 'Negative', concept_id, -round(z, 6) + 0.0 FROM cz))""") + """
  SELECT "class", rank, concept_id, replace(min(term) OVER (PARTITION BY "class", concept_id),
    ' ', '_') AS representative, replace(term, ' ', '_') AS label, z
  FROM ranked JOIN units USING (concept_id) WHERE rank <= 5""")
def top_concepts(spark, folder):
    src, store, units = _mapped(spark, folder)
    scored = _concept_scores(spark, src, store, units)
    return rounded(co.top_concepts(scored, co.concept_members(units), 5), "z")


# ---------------------------------------------------- word vectors, k-means ----
_H = "('0x' || substr(md5(near), {}, 8))::UBIGINT::BIGINT"
_EMBEDDED = """words AS MATERIALIZED (SELECT DISTINCT unnest(string_split(term, ' ')) AS word FROM feats),
  around AS (SELECT t[i] AS word, t[j] AS near FROM (
    SELECT t, i, unnest(range(greatest(i - 5, 1), least(i + 5, len(t)) + 1)) AS j FROM (
      SELECT t, unnest(range(1, len(t) + 1)) AS i FROM toks WHERE split = 'train'))),
  nears AS MATERIALIZED (SELECT word, near, count(*) AS n FROM around JOIN words USING (word)
    GROUP BY word, near),
  bits AS MATERIALIZED (SELECT near, d, 2 * (((CASE WHEN d < 32 THEN {0} ELSE {1} END)
      >> (d % 32)::INT) & 1) - 1 AS sign
    FROM (SELECT DISTINCT near FROM nears), range(64) t(d)),
  sums AS (SELECT word, d, sum(n * sign)::DOUBLE AS v FROM nears JOIN bits USING (near)
    GROUP BY word, d),
  units_w AS MATERIALIZED (SELECT word, d, v / sqrt(sum(v * v) OVER (PARTITION BY word)) AS v
    FROM sums),
  spread AS (SELECT term, df, unnest(string_split(term, ' ')) AS word FROM feats),
  added AS (SELECT term, df, d, sum(v) AS v FROM spread JOIN units_w USING (word) GROUP BY ALL)
""".format(_H.format(1), _H.format(9))


@register("unit_embeddings", s.with_(*s.features(), _EMBEDDED) + f"""SELECT term, df, d::INT AS pos,
    {s.r6('v / sqrt(sum(v * v) OVER (PARTITION BY term))')} AS x FROM added""")
def unit_embeddings(spark, folder):
    src, store = rp.Source(folder), Store(spark)
    rows = rp.unit_vectors(spark, src, store).select("term", "df", F.posexplode("embedding").alias("pos", "x"))
    return rounded(rows, "x")


@register("concept_kmeans", s.with_(*s.features()) + """SELECT term, df, true AS nearest,
    true AS in_range FROM feats""")
def concept_kmeans(spark, folder):
    """Every unit: whether its concept's centre is its nearest, and its id one of k."""
    src, store = rp.Source(folder), Store(spark)
    k, w = 50, 10.0
    mapped, _ = rp.concept_map(spark, src, store, k=k, w=w)
    points = rp.unit_vectors(spark, src, store).select(
        "term", co.augment("embedding", "score", w).alias("vector"))
    # the raw centres are the means of their members
    parts = points.join(mapped, "term")
    mean = Summarizer.mean(array_to_vector("vector"))
    centres = store.table(lambda: parts.groupBy("concept_id").agg(
        vector_to_array(mean).alias("centroid")), "concept_means", k=k, w=w, **src.key())
    near = co.nearest_centroid(parts, centres.withColumnRenamed("concept_id", "near_id"), "vector", "near_id")
    own = co.attach_small(near, centres, "concept_id").select(
        "term", "df", "concept_id", "dist", F.aggregate(F.zip_with(
            "vector", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("own"))
    # k-means stops after its rounds, so a unit may lie a little closer to another mean
    return own.select(
        "term", "df", (F.col("own") <= F.col("dist") + MOVE).alias("nearest"),
        F.col("concept_id").between(0, k - 1).alias("in_range"))
