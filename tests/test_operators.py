"""Operators against brute force and invariants on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicade.functions import stats
from lexicade.operators import cascade as ca
from lexicade.operators import concepts as co
from lexicade.operators import corpus as oc
from lexicade.operators import evaluate as ev
from lexicade.operators import scoring as sc
from lexicade.operators import vocabulary as vo
from lexicade.operators.joins import join_per_key
from lexicade.operators.ranking import sorted_index
from lexicade.operators.weighting import inverse_frequency, tfidf

RNG = random.Random(7)
WORDS = ["a", "b", "bad", "cat", "dog", "é", "good", "the", "the cat"[:3], "z"]


@pytest.fixture(scope="module")
def docs(spark):
    # a third of the rows hold the same text
    rows = []
    for i in range(400):
        label = int(RNG.random() < 0.7)
        words = RNG.choices(WORDS, k=RNG.randint(1, 12)) + (["good"] if label else ["bad"])
        rows.append((i, " ".join(words) if i % 3 else "copy of one text", label))
    return spark.createDataFrame(rows, "doc_id long, text string, label int").persist()


@pytest.fixture(scope="module")
def tokens(docs):
    return docs.select("doc_id", "label", F.split("text", " ").alias("tokens"))


def local_counts(rows, upto=3):
    out = Counter()
    for r in rows:
        t = r.tokens
        for n in range(1, upto + 1):
            for i in range(len(t) - n + 1):
                out[(r.doc_id, r.label, " ".join(t[i:i + n]))] += 1
    return out


def test_duplicates_keep_first(docs):
    got = {r.doc_id for r in oc.drop_duplicate_texts(docs).collect()}
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    assert got == set(first.values())
    report = oc.duplicate_report(docs).first()
    assert report.rows_in == 400 and report.rows_kept == len(first)


@pytest.mark.parametrize("ends, names", [((50, 85), oc.SPLITS), ((80,), ("train", "val")),
                                         ((20, 40, 60, 80), tuple("01234"))])
def test_split_is_exact_per_label(docs, ends, names):
    got = oc.stratified_split(docs, ends=ends, names=names).groupBy("label", "split").count()
    sizes = Counter(r.label for r in docs.collect())
    for label, n in sizes.items():
        cuts = [0, *[n * e // 100 for e in ends], n]
        want = {s: cuts[i + 1] - cuts[i] for i, s in enumerate(names)}
        assert {r.split: r["count"] for r in got.collect() if r.label == label} == want
    again = oc.stratified_split(docs.repartition(3), ends=ends, names=names)
    pairs = oc.stratified_split(docs, ends=ends, names=names).select("doc_id", "split")
    assert pairs.exceptAll(again.select("doc_id", "split")).isEmpty()


def test_split_of_tiny_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    assert oc.stratified_split(df).count() == 3


def test_sorted_index(spark):
    keys = sorted({"".join(RNG.choices("abé ñz", k=RNG.randint(0, 9))) for _ in range(500)},
                  key=lambda k: k.encode())
    df = spark.createDataFrame([(k,) for k in keys], "term string")
    got = {r.term: r.idx for r in sorted_index(df, "term").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_salted_join_equals_broadcast(spark, tokens, tmp_path):
    counts = vo.term_counts(tokens, keep=("doc_id", "label"))
    vo.vocabulary(counts, F.lit(400), 2, 1.0).write.parquet(str(tmp_path / "v"))
    vocab = spark.read.parquet(str(tmp_path / "v"))
    plain = join_per_key(counts, vocab, "term", "doc_id", "df")
    salted = join_per_key(counts, vocab, "term", "doc_id", "df", broadcast_rows=0)
    assert plain.count() > 0 and plain.columns == salted.columns
    assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()
    keep = ("doc_id", "label")
    early = vo.known_term_counts(tokens, vocab, keep=keep)
    late = vo.known_term_counts(tokens, vocab, keep=keep, broadcast_rows=0)
    assert early.exceptAll(late).isEmpty() and early.count() == late.count() == plain.count()


def test_counts_and_scores(tokens):
    counts = vo.term_counts(tokens, keep=("doc_id", "label"))
    want = local_counts(tokens.collect())
    got = {(r.doc_id, r.label, r.term): r.cnt for r in counts.collect()}
    assert got == dict(want)

    df, pos, neg = Counter(), Counter(), Counter()
    for (_, label, term), n in want.items():
        df[term] += 1
        (pos if label else neg)[term] += n
    kept = [t for t in df if 10 <= df[t] <= 0.5 * 400]
    n1, n0, v = sum(pos[t] for t in kept), sum(neg[t] for t in kept), len(kept)
    scored = sc.z_scores(sc.class_counts(counts, F.lit(400), 10, 0.5))
    rows = {r.term: r.z for r in scored.collect()}
    assert set(rows) == set(kept)
    for t in kept:
        p1, p0 = (pos[t] + .01) / (n1 + .01 * v), (neg[t] + .01) / (n0 + .01 * v)
        z = math.log(p1 / p0) / math.sqrt(1 / (pos[t] + .01) + 1 / (neg[t] + .01))
        assert rows[t] == pytest.approx(z, rel=1e-9)

    swapped = counts.withColumn("label", 1 - F.col("label"))
    other = {r.term: r.z for r in
             sc.z_scores(sc.class_counts(swapped, F.lit(400), 10, 0.5)).collect()}
    assert all(other[t] == pytest.approx(-rows[t]) for t in rows)
    both = {r.term for r in sc.keep_either_class(scored, 2.0).collect()}
    assert both == {r.term for r in sc.keep_features(scored, 2.0).collect()}


def test_empty_document_is_one_empty_token(spark):
    df = spark.createDataFrame([(1, []), (2, ["x"])], "doc_id long, tokens array<string>")
    assert {(r.doc_id, r.term) for r in vo.term_counts(df).collect()} == {(1, ""), (2, "x")}


def test_tfidf_rows_have_unit_length(tokens):
    counts = vo.term_counts(tokens, keep=("doc_id",))
    vocab = vo.vocabulary(counts, F.lit(400), 5, 0.9)
    rows = tfidf(inverse_frequency(counts.join(vocab, "term"), F.lit(400)))
    lengths = rows.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert lengths and all(r.s == pytest.approx(1.0) for r in lengths)


@pytest.fixture(scope="module")
def preds(spark):
    edges = [0.0, 0.254, 0.5, 0.746, 1.0, ca.thresholds()[57], 1 - ca.thresholds()[57]]
    rows = []
    for model in ("m1", "m2", "spec"):
        for i in range(300):
            p = edges[i] if i < len(edges) else RNG.random()
            rows.append(("e", model, i, i % 2, p))
    schema = "experiment string, model string, doc_id long, true_label int, probability double"
    return spark.createDataFrame(rows, schema).persist()


def test_sweep_equals_testing_every_threshold(preds):
    spec = preds.where("model = 'spec'")
    got = {(r.model, r.certainty_threshold): r for r in
           ca.cascade_sweep(preds.where("model <> 'spec'"), spec).collect()}
    cs = np.linspace(0.5, 1.0, 200)
    assert ca.thresholds() == cs.tolist()
    s = {r.doc_id: (r.probability > 0.5) == (r.true_label == 1) for r in spec.collect()}
    for model in ("m1", "m2"):
        rows = preds.where(F.col("model") == model).collect()
        for c in cs.tolist():
            sure = [r for r in rows if c < 1 and (r.probability >= c or r.probability <= 1 - c)]
            ok = sum((r.probability > 0.5) == (r.true_label == 1) for r in sure)
            ids = {r.doc_id for r in sure}
            rest = sum(s[r.doc_id] for r in rows if r.doc_id not in ids)
            g = got[(model, c)]
            assert g.coverage == pytest.approx(len(sure) / len(rows))
            assert g.local_accuracy == pytest.approx(ok / len(sure) if sure else 1.0)
            assert g.hybrid_accuracy == pytest.approx((ok + rest) / len(rows))
        assert got[(model, 1.0)].coverage == 0


def test_edge_row_is_kept_in_the_sweep_but_delegated_when_applied(spark):
    t = 0.254
    schema = "experiment string, model string, doc_id long, true_label int, probability double"
    base = spark.createDataFrame([("e", "b", 1, 1, t), ("e", "b", 2, 1, 0.2)], schema)
    spec = spark.createDataFrame([("e", "s", 1, 1, 0.9), ("e", "s", 2, 1, 0.9)], schema)
    merged = {r.doc_id: (r.probability, r.delegated)
              for r in ca.cascade_merge(base, spec, t).collect()}
    assert merged == {1: (0.9, True), 2: (0.2, False)}
    got = base.select("doc_id", ca.certain_steps(F.col("probability"), [0.5, 1 - t, 0.99, 1.0])
                      .alias("k")).collect()
    assert {r.doc_id: r.k for r in got} == {1: 2, 2: 2}


def test_incomplete_models_are_left_out(preds):
    some = preds.where("model <> 'm2' OR doc_id < 100")
    base = preds.where("model = 'spec'")
    assert {r.model for r in ev.align(some, base).collect()} == {"m1", "spec"}
    assert {r.model for r in ev.mcnemar(some, base, "spec").collect()} == {"m1"}
    assert {r.model for r in ca.cascade_sweep(some, base).collect()} == {"m1", "spec"}


def test_mcnemar_cells_and_p(preds):
    rows = ev.mcnemar(preds, preds.where("model = 'spec'"), "spec").collect()
    for r in rows:
        assert r.both_correct + r.base_only + r.comp_only + r.both_wrong == 300
        chi2 = (abs(r.base_only - r.comp_only) - 1) ** 2 / (r.base_only + r.comp_only)
        assert r.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), rel=1e-6)
    same = preds.where("model = 'm1'")
    twin = same.withColumn("model", F.lit("twin"))
    assert ev.mcnemar(twin, same, "m1").first().p_value is None


def test_chi2_tail(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0.5, 3.8414588, 30)], "x double")
    for r in df.select("x", stats.chi2_survival(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=2e-7)


def test_report_has_zero_for_empty_ratios(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.2), ("m", 2, 1, 0.9)],
                               "model string, doc_id long, true_label int, probability double")
    got = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert (got["0"].precision, got["0"].recall, got["0"].support) == (0.0, 0.0, 0.0)
    assert got["1"].recall == 0.5 and got["accuracy"].support == 0.5


def test_histogram_puts_one_in_the_last_bin(preds):
    rows = ev.certainty_histogram(preds).collect()
    assert sum(r.n for r in rows) == 900 and {r.bin for r in rows} <= set(range(1, 51))


@pytest.mark.parametrize("numbers", [4_000_000, 12])
def test_nearest_centroid_in_blocks(spark, numbers, monkeypatch):
    monkeypatch.setattr(co, "BLOCK_NUMBERS", numbers)
    gen = np.random.default_rng(3)
    points, cents = gen.normal(size=(50, 4)), gen.normal(size=(11, 4))
    pdf = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)],
                                "vec_id long, embedding array<double>")
    cdf = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cents)],
                                "concept_id long, centroid array<double>")
    got = {r.vec_id: r.concept_id for r in co.nearest_centroid(pdf, cdf).collect()}
    want = ((points[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert got == dict(enumerate(want.tolist()))


def test_polarity(spark):
    units = spark.createDataFrame([("good",), ("not good",), ("not a very good",), ("the",),
                                   ("not x y z good",)], "term string")
    got = {r.term: r.score for r in co.polarity(units, co.valence_table(spark)).collect()}

    def score(s):
        return s / math.sqrt(s * s + 15)

    assert got["good"] == got["not x y z good"] == pytest.approx(score(1.9))
    assert got["not good"] == got["not a very good"] == pytest.approx(score(1.9 * -0.74))
    assert got["the"] == 0.0


def test_concepts_keep_all_ids(spark):
    counts = spark.createDataFrame([(1, 1, 0, 4), (2, 0, 2, 3)],
                                   "doc_id long, label int, concept_id int, cnt long")
    got = {r.concept_id: (r.c_pos, r.c_neg) for r in co.concept_class_counts(counts, 4).collect()}
    assert got == {0: (4, 0), 1: (0, 0), 2: (0, 3), 3: (0, 0)}


def _signs_of(word):
    import hashlib

    raw = hashlib.md5(word.encode()).hexdigest()
    return [2 * ((int(raw[8 * (d // 32): 8 * (d // 32) + 8], 16) >> (d % 32)) & 1) - 1 for d in range(64)]


def test_embeddings_keep_every_unit_at_any_core_count(spark):
    docs = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), ([],), (["z"],)], "tokens array<string>")
    units = spark.createDataFrame([("a",), ("a b",), ("z",), ("",), ("nowhere",), ("b b",), ("b",)], "term string")
    got = {r.term: r.embedding for r in co.embed_words(docs, units).collect()}
    assert len(got) == 7 and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())
    again = {r.term: r.embedding for r in co.embed_words(docs.repartition(7), units.repartition(3)).collect()}
    assert again == got
    # z is only ever near itself
    assert got["z"] == pytest.approx([x / 8 for x in _signs_of("z")]) and got["b b"] == pytest.approx(got["b"])


def test_word2vec_fails_loudly_without_a_vector(spark):
    docs = spark.createDataFrame([(["a", "b"],)] * 3, "tokens array<string>")
    units = spark.createDataFrame([("a",), ("unknown",)], "term string")
    with pytest.raises(Exception, match="no vector for unit unknown"):
        co.embed_word2vec(docs, units, size=4).collect()


def test_concept_tables_depend_on_encoder_seed_and_lexicon(spark):
    from lexicade.plans import representation as rp
    from lexicade.sources.artifacts import Store

    src, store = rp.Source("/root/testdata/sf0.001", min_df=8, n_range=(1, 1)), Store(spark)

    def turned(n):
        def embed(units, train):
            made = co.embed_words(train, units)
            return made.withColumn("embedding", F.transform("embedding", lambda x, i: x * F.pmod(i, F.lit(n))))
        return embed

    def maps(**options):
        mapped, _ = rp.concept_map(spark, src, store, 5, 1.0, **options)
        return {r.term: r.concept_id for r in mapped.collect()}

    first, second = maps(embed=turned(2), encoder="two"), maps(embed=turned(3), encoder="three")
    assert first.keys() == second.keys() and first != second
    assert maps(embed=turned(3), encoder="two") == first  # the name is the key
    with pytest.raises(ValueError, match="name the encoder"):
        rp.concept_map(spark, src, store, 5, 1.0, embed=turned(2))
    assert len({str(rp.concept_key(src, 5, 1.0, None, seed, None)) for seed in (1, 2)}) == 2


@pytest.mark.parametrize("n_range, min_df", [((1, 3), 3), ((2, 2), 2), ((1, 1), 5)])
def test_frequent_words_lose_no_frequent_ngram(spark, n_range, min_df):
    rows = [(i, [RNG.choice(WORDS) for _ in range(RNG.randrange(0, 9))]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    words = vo.frequent_words(docs, "tokens", min_df)

    def kept(counts):
        per = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("cnt").alias("n"))
        return {(r.term, r.df, r.n) for r in per.where(F.col("df") >= min_df).collect()}

    assert kept(vo.frequent_term_counts(docs, words, "tokens", n_range)) == kept(
        vo.term_counts(docs, "tokens", n_range))


def test_only_ngrams_of_frequent_words_are_counted(spark):
    docs = spark.createDataFrame([(i, ["a", f"rare{i}", "a"]) for i in range(50)], "doc_id long, tokens array<string>")
    counts = vo.frequent_term_counts(docs, vo.frequent_words(docs, "tokens", 10), "tokens", (1, 3))
    assert {r.term for r in counts.select("term").distinct().collect()} == {"a"}


def test_uneven_thresholds_and_models_of_two_experiments(spark):
    ps = (0.5, 0.52, 0.58, 0.7, 0.97, 0.03, 1.0, 0.0, 0.45, 0.61)
    rows = [(e, "m", i, i % 2, p) for e in ("x", "y") for i, p in enumerate(ps)]
    preds = spark.createDataFrame(
        rows, "experiment string, model string, doc_id long, true_label int, probability double")
    spec = preds.where("experiment = 'x'").select("doc_id", "true_label", "probability")
    cs = [0.5, 0.52, 0.55, 0.6, 0.9, 1.0]
    curve = ca.cascade_sweep(preds, spec, cs).collect()
    assert len(curve) == 2 * len(cs)
    for r in curve:
        c = r.certainty_threshold
        assert r.coverage == pytest.approx(sum(c < 1 and (p >= c or p <= 1 - c) for p in ps) / 10)
    assert ev.align(preds, spec).count() == 20


def test_every_cascade_has_its_documented_name(spark):
    from lexicade.functions import naming

    names = spark.createDataFrame([(n,) for n in ("SVM_Specialist", "BERT_Basic", "BERT_Specialist")], "m string")
    made = names.select(naming.display_name(naming.cascade_name("m"), naming.CASCADE_DISPLAY).alias("d"))
    assert {r.d for r in made.collect()} == {"Base + Spec. SVM", "Base + Basic BERT", "Base + Spec. BERT"}
