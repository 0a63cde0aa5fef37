"""What a task holds is bounded: grouped n-grams, texts at a time, counts of a large vocabulary."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexicade.functions import text as tx
from lexicade.operators import coding as co
from lexicade.operators import concepts as cn
from lexicade.operators import vocabulary as vo
from lexicade.operators.joins import dealt, join_per_key, salted_sides
from lexicade.operators.scoring import keep_features, score_documents

TEXTS = ["a b a b", "a b c", "", "c c c a b a b a", None, "z a"]


def documents(spark):
    rows = [(i, 1 if i % 2 else 0 if i != 4 else None, "train", None if t is None else t.split()) for i, t in enumerate(TEXTS)]
    rows.append((9, None, "train", ["a", "b"]))
    return spark.createDataFrame(rows, "doc_id long, label int, split string, tokens array<string>")


def coded(spark):
    words = co.dictionary(spark.createDataFrame([("a",), ("b",), ("c",)], "word string"))
    return co.code(documents(spark), words, ("doc_id", "label", "split")), words


def test_grams_are_grouped_in_as_many_tasks_as_their_number_asks_for(spark):
    docs, words = coded(spark)
    sums = co.gram_sums(docs, (1, 3), task_rows=10)
    tokens = docs.agg(F.sum(F.size("ids"))).first()[0]
    assert sums.rdd.getNumPartitions() == -(-3 * tokens // 10)
    one = F.col("label") == 1
    counts = co.spell(co.gram_counts(docs, (1, 3), ("label",)), words).groupBy("term").agg(
        F.count("*").alias("df"), F.count_if(one).alias("df_pos"), F.count_if(~one).alias("df_neg"),
        F.sum(F.when(one, F.col("cnt")).otherwise(0)).alias("c_pos"), F.sum(F.when(one, 0).otherwise(F.col("cnt"))).alias("c_neg"))
    got = {tuple(r) for r in co.spell(sums, words).select("term", *co.SUMS).collect()}
    assert got == {tuple(r) for r in counts.collect()} and got


def test_known_grams_are_counted_without_a_join(spark):
    docs, words = coded(spark)
    vocab = co.gram_sums(docs, (1, 3)).where("df >= 2").select("gram", "df").persist()
    got = co.known_gram_counts(docs, vocab, words, (1, 3), ("doc_id",))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = co.spell(co.gram_counts(docs, (1, 3), ("doc_id",)).join(vocab, "gram"), words)
    cols = ("doc_id", "term", "df", "cnt")
    rows = sorted(map(tuple, got.select(*cols).collect()))
    assert rows == sorted(map(tuple, want.select(*cols).collect())) and rows
    assert co.known_gram_counts(docs, vocab, words, (1, 3), ("doc_id",), max_known=1) is None


def test_stop_and_informative_units_from_chosen_words(spark):
    docs = documents(spark)
    docs = docs.unionByName(docs.where("doc_id < 4"))  # documents that come twice count once
    counts = vo.term_counts(docs, "tokens", (1, 3), ("doc_id", "label"))
    for choose, whole, part in (
            (lambda d: vo.stop_words(d, docs, share=0.2), vo.stop_units(counts, docs, 0.2).select("term"),
             lambda s: vo.stops(s, docs, 0.2, unit="gram").select("gram")),
            (lambda d: vo.frequent_uses(d, below=3), vo.informative_units(counts, docs, 0.3, 3).select("term", "total"),
             lambda s: vo.informative(s.withColumn("total", F.col("c_pos") + F.col("c_neg")), docs, 0.3, 3, unit="gram"))):
        words = co.dictionary(choose(docs))
        sums = co.gram_sums(co.merged(co.code(docs, words, ("doc_id", "label")), ("doc_id", "label")), (1, 3))
        names = whole.columns
        assert sorted(map(tuple, co.spell(part(sums), words).select(*names).collect())) == sorted(map(tuple, whole.collect()))
        assert not whole.isEmpty()


def test_texts_are_normalised_some_at_a_time(spark):
    values = [None, "", "Å ﬁ ½", "plain"] * 200
    assert tx._nfkc.func(pa.array(values, pa.string())).to_pylist() == [
        v if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert tx._nfkc.func(pa.array([], pa.string())).to_pylist() == []


def test_dealt_rows_are_bounded(spark):
    assert dealt(spark.range(100), "id", task_rows=7).rdd.getNumPartitions() == 15


def test_shuffled_joins_have_as_many_tasks_as_rows_ask_for(spark):
    left = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 70, 0).otherwise(F.col("id")).alias("term"))
    right = left.groupBy("term").agg(F.count("*").alias("df")).where("term <> 80")
    got = join_per_key(left, right, "term", "doc_id", "df", broadcast_rows=0, task_rows=7)
    told = join_per_key(left, right, "term", "doc_id", "df", broadcast_rows=0, left_rows=lambda: 30, task_rows=7)
    for joined, n in ((got, 15), (told, 5)):
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert re.findall(r"RepartitionByExpression \[term#\d+L?, _salt#\d+\], (\d+)", plan) == [str(n)] * 2
    want = left.join(right, "term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def neighbour_signs(texts, words, window, size):
    """The old way: every pair of a word and a neighbour."""
    out = {}
    for t in texts:
        t = [""] if t == [] else t or []
        for i, w in enumerate(t):
            for x in t[max(0, i - window): i + window + 1]:
                if w in words and x is not None:
                    digest = int(hashlib.md5(x.encode()).hexdigest(), 16)
                    at = [digest >> (96 - 32 * (d // 32)) >> (d % 32) & 1 for d in range(size)]
                    out[w] = out.get(w, 0) + 2 * np.array(at) - 1
    return out


def test_word_vectors_are_summed_within_tasks(spark, monkeypatch):
    rng = random.Random(3)
    texts = [rng.choices(["a", "b", "ć", "dd", "", None], k=rng.randint(0, 30)) for _ in range(60)] + [None, [], ["z"]]
    docs = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    names = ["a", "b", "ć", "", "unseen", "dd"]
    words = spark.createDataFrame([(w,) for w in names], "word string")
    for size, window in ((64, 5), (100, 2)):
        want = neighbour_signs(texts, names, window, size)
        own = neighbour_signs([[w] for w in names], names, 0, size)
        for held, at_a_time, dictionary in ((1 << 17, 1 << 15, cn.dictionary), (5, 7, cn.dictionary), (9, 40, lambda _: None)):
            monkeypatch.setattr(cn, "HELD_WORDS", held)
            monkeypatch.setattr(cn, "TOKENS_AT_A_TIME", at_a_time)
            monkeypatch.setattr(cn, "dictionary", dictionary)
            got = cn.word_vectors(docs, words, size=size, window=window)
            assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row per pair of words
            vectors = {r.word: r.vector for r in got.collect()}
            assert len(vectors) == got.count() == len(names)
            for w in names:
                usable = w in want and want[w].any()
                assert vectors[w] == list(map(float, want[w] if usable else own[w]))


def test_a_vectors_length_is_made_once(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],)]
    got = spark.createDataFrame(rows, "v array<double>").select(cn.unit_length(F.col("v")).alias("u"))
    assert [r.u for r in got.collect()] == [[0.6, 0.8], [None, None], [], None, [None, None]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("aggregate(") == 1


def test_frequent_keys_that_the_right_side_lacks_are_spread(spark):
    left = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the").otherwise(F.col("id").cast("string")).alias("term"))
    units = left.groupBy("term").agg(F.count("*").alias("df"))
    right = units.where("term <> 'the'")

    def largest(keys):
        side = salted_sides(left, right, "term", "doc_id", "df", 16, keys)[0]
        return side.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]

    assert largest(right) >= 2000 and largest(units) < 1000
    want = left.join(right, "term")
    got = join_per_key(left, right, "term", "doc_id", "df", broadcast_rows=0, task_rows=250, keys=units)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_documents_are_scored_alike_by_a_shuffled_join(spark, tmp_path):
    # "the" is the most frequent term and not kept; a term and a count may be null, a row may come twice
    rows = [(i, t, 1 + i % 3) for i in range(60) for t in ("the", f"w{i % 7}", f"v{i % 11}")] + [(3, None, 1), (4, "w4", None), (5, "w5", 2)]
    units = spark.createDataFrame(
        [("the", 60, 0.5)] + [(f"{c}{i}", 9, (i - 4) * 0.9) for c in "wv" for i in range(11)], "term string, df long, z double")
    units.write.parquet(str(tmp_path / "units"))
    units = spark.read.parquet(str(tmp_path / "units"))
    keep_features(units, 2.0).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    counts = spark.createDataFrame(rows, "doc_id long, term string, cnt long")
    docs = spark.range(62).select(F.col("id").alias("doc_id"), F.lit("val").alias("split"), (F.col("id") % 2).alias("label"))
    plain = score_documents(docs, counts, kept, "zscore")
    shuffled = score_documents(docs, counts, kept, "zscore", units, broadcast_rows=0)
    assert plain.schema == shuffled.schema and plain.where("probability <> 0.5").count() > 20
    assert sorted(map(str, plain.collect())) == sorted(map(str, shuffled.collect()))


def test_counting_tasks_make_a_bounded_number_of_grams(spark):
    # 300 documents of 30 tokens in one partition: 26,100 n-grams
    rows = [(i, i % 2, "train", [f"w{(i * j) % 7}" for j in range(30)]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, label int, split string, tokens array<string>").coalesce(1)
    words = co.dictionary(spark.createDataFrame([(f"w{i}",) for i in range(7)], "word string"))
    plain = co.code(docs, words, ("doc_id", "label", "split"))
    some = co.dealt_documents(plain, (1, 3), task_rows=500).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in some) == 300 and max(r.n for r in some) * 87 < 26_100 / 10
    sums = co.gram_sums(plain, (1, 3), task_rows=500)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression .*\], (\d+)", plan) == ["54", "54"]
    want = co.gram_sums(plain, (1, 3))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.collect())) and want.count() > 7
