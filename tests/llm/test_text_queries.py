"""Toxicity, decontamination, repeated spans, fingerprints, shards and code lengths."""

import base64
import bisect
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexicade.llm import ctw, ctw_tree, decontaminate, hashtree, spans, spotsigs, toxicity
from lexicade.llm.stage import Stage
from tests.llm.conftest import WORDS

LOW = {i: i + 32 for i in range(65, 91)}


# ---------------------------------------------------------------- toxicity ----
def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        bad = f"you {'1d10t' if i % 8 else 'Idiоt'} and vequ{'abcdefgh'[i % 8]} too" if toxic else "you nice friend"
        rows.append((i, f"{WORDS} {bad} number{i} {WORDS}"))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, label int"))


def test_learns_words_and_beginnings_from_folded_texts(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels.where("doc_id < 300"))
    assert " idiot " in model.weights and " vequ" in model.weights
    cases = [(1, "such an IDIOT"), (2, "a vequzz"), (3, "good morning"), (4, ""), (5, None),
             (6, WORDS * 3000), (7, "lndiot idiotic")]
    got = {r.doc_id: r.toxicity for r in toxicity.scores(
        spark.createDataFrame(cases, "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and max(got[3], got[4], got[5], got[6]) < 0.5
    held = toxicity.scores(docs.where("doc_id >= 300"), model).collect()
    assert all((r.toxicity >= 0.5) == (r.doc_id % 4 == 0) for r in held)


def test_exceptions_repeats_and_length():
    model = toxicity.Model({" trash ": 3.0, " tras": 1.0}, ("trash can",), (0, 1, 1))
    auto = model.automaton()
    assert toxicity.matched("Put it in the TRASH-can.", auto) == (0.0, 6)
    assert toxicity.matched("tr4sh, trash; trashy", auto) == (4.0, 3)
    assert toxicity.matched("", auto) == (0.0, 0)
    assert toxicity.features(3, 10)[1] > toxicity.features(3, 1000)[1]


def test_toxicity_without_labels(spark, corpus, empty):
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, label int")
    model = toxicity.learn(corpus, none)
    assert not model.weights
    out = toxicity.scores(corpus.select("doc_id", "text"), model)
    assert {r.toxicity for r in out.collect()} == {0.5}
    assert toxicity.scores(empty, model).count() == 0


def test_sample_bounds_rows_without_regard_to_labels(spark):
    docs, labels = labelled(spark)
    # one id with many texts that are not toxic, all different
    hot = spark.range(600).select(F.lit(1).cast("long").alias("doc_id"),
                                  F.concat(F.lit(f"{WORDS} you nice friend number"), "id", F.lit(f" {WORDS}")).alias("text"))
    whole, few = (toxicity.learn(docs.union(hot), labels, sample=n) for n in (2000, 450))
    assert " idiot " in few.weights
    cases = spark.createDataFrame([(1, f"{WORDS} you idiot and vequa too {WORDS}"), (2, WORDS)], "doc_id long, text string")
    for model in (whole, few):
        got = {r.doc_id: r.toxicity for r in toxicity.scores(cases, model).collect()}
        assert got[1] > 0.5 > got[2]


def test_curve_has_the_least_loss():
    rng = np.random.default_rng(3)
    for n, k in ((400, 40), (1000, 100), (50, 1), (30, 0), (0, 0)):
        y = np.r_[np.ones(k), np.zeros(n - k)]
        x = np.array([toxicity.features(8 * v * rng.random(), 36) for v in y]).reshape(-1, 2)
        w = np.array(toxicity.fit_curve(x, y))

        def loss(w):
            t = np.r_[x @ w[1:] + w[0], w[0], w[0]]
            h = np.r_[np.ones(n), 0.5, 0.5]
            return h @ (np.logaddexp(0, t) - np.r_[y, 0, 1] * t) + 0.025 * (w[1:] @ w[1:])

        for d in rng.normal(size=(200, 3)) * 0.05:
            moved = np.r_[(w + d)[0], np.maximum((w + d)[1:], 0)]
            assert loss(moved) >= loss(w) - 1e-9
        if k == 0:
            assert abs(1 / (1 + math.exp(-w[0])) - 0.5 / (n + 1)) < 1e-9


def test_every_significant_entry_is_kept(spark):
    bad = [f"zz{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(97)]
    rows = [(i, " ".join(bad[(i // 4 + k) % 97] for k in range(60)) if i % 4 == 0 else f"{WORDS} n{i}")
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("label")))
    assert {f" {w} " for w in bad} <= set(model.weights)


# --------------------------------------------------------- decontamination ----
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


ITEMS = [(1, WORDS), (2, "one two"), (3, None), (4, "..."), (5, "é日本 ß́ 𝒳 A"), (11, "One, TWO!")]


def test_windows_and_hits(spark, corpus, rows, stage):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    extra = [(1_000_001, "x " + WORDS[4:60] + " y one two z one two"), (1_000_002, "ONE-two"), (1_000_003, "onetwo")]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = decontaminate.contamination(docs, bench, stage).collect()
    windows = {}
    for i, t in ITEMS:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k: k + 10]), set()).add(str(i))
    want = []
    for i, t in rows + extra:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k: k + n])]
        want.append((str(i), len(w), len(hit), tuple(sorted(items))))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(want)


def test_removal_of_documents_and_spans(spark, corpus, rows, stage):
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    kept = decontaminate.without_documents(corpus, bench, stage)
    assert kept.columns == corpus.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 900_005 not in ids and 900_001 in ids and 900_009 in ids
    docs = spark.createDataFrame(
        [(1, "Start, one TWO; end.", "k"), (2, "clean", "k"), (3, None, "k"), (3, None, "k")], "doc_id long, text string, row string")
    cut = decontaminate.without_spans(docs, bench, Stage(spark)).collect()
    assert sorted((r.doc_id, r.text, r.row) for r in cut if r.text) == [(1, "Start; end.", "k"), (2, "clean", "k")]
    assert len(cut) == 4


def test_large_windows_are_joined_by_a_shuffle(spark, monkeypatch, corpus):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")

    def hits():
        out = decontaminate.contamination(corpus, bench, Stage(spark))
        return sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect())

    want = hits()
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 0)
    monkeypatch.setattr(decontaminate, "ANCHOR_BYTES", 0)
    monkeypatch.setattr(decontaminate.F, "broadcast", None)
    assert hits() == want


def test_no_benchmark_and_no_documents(spark, corpus, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(corpus, none, Stage(spark)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, none, Stage(spark)).count() == 0


# ---------------------------------------------------------- repeated spans ----
SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?!\s|\Z))+(?:[.!?\n]\s*)?|[.!?\n]\s*")


def needed(w):
    """Whether a run of sentences with these numbers of words is a span, by its definition alone."""
    if len(w) < 3:
        return sum(w) >= (40, 25)[len(w) - 1]
    return sum(w) >= 10 and (len(w) == 3 or sum(w[1:]) < 10 or sum(w[:-1]) < 10)


def without_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        s = SENTENCE.findall(t or "")
        n = [" ".join(x.lower().split()) for x in s]
        w = [len(x.split(" ")) for x in n]
        cut = set()
        for k in range(len(s)):
            # a run of more than ten sentences has ten words without its first
            for m in range(1, min(len(s) - k, 10) + 1):
                if needed(w[k: k + m]):
                    run = tuple(n[k: k + m])
                    if run in seen:
                        cut |= set(range(k, k + m))
                    seen.add(run)
        out[i] = (None if t is None else "".join(x for k, x in enumerate(s) if k not in cut), len(cut))
    return out


def test_spans_equal_brute_force_on_mixed_passages(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(f"s{k}x{j}" for j in range(n)) + rng.choice([". ", "! ", "\n"])
             for k, n in enumerate(rng.choice([1, 1, 2, 3, 4, 9, 12, 26, 41], 60))]
    blocks = ["".join(lines[a: a + n]) for a, n in zip(rng.integers(0, 50, 25), rng.integers(1, 14, 25))]
    plain = [(i, "".join(blocks[b] for b in rng.integers(0, 25, rng.integers(0, 5)))) for i in range(120)]
    plain += [(200, None), (201, blocks[0] * 2_000)]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.without_repeats(df, Stage(spark)).collect()}
    want = without_repeats(plain)
    assert got == want and sum(n for _, n in want.values()) > 100


def test_only_first_occurrences_stay(spark, corpus, rows):
    passage = "This is the first sentence of it. The second one follows here! And a third, is it not? "
    more = [(1_000_001, "Head line one.\n" + passage + "Tail."), (1_000_002, passage + passage + "Own end of it all."),
            (1_000_003, "No repeats in here. None."), (1_000_004, " ".join(["long"] * 50) + ". A."),
            (1_000_005, "B. " + " ".join(["long"] * 50) + ".")]
    plain = [(i, t) for i, t in rows if i is not None and i != 900_006] + more
    df = spark.createDataFrame(plain, "doc_id long, text string").withColumn("_cut", F.lit("clash"))
    out = spans.without_repeats(df, Stage(spark))
    assert out.columns == [*df.columns, "n_sentences", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in out.collect()} == without_repeats(plain)


def test_spans_on_repeated_rows_and_empty_tables(spark, corpus, rows, empty):
    out = spans.without_repeats(corpus, Stage(spark)).collect()
    assert len(out) == len(rows)
    twice = [r.text for r in out if r.doc_id == 900_006]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert spans.without_repeats(empty, Stage(spark)).count() == 0


def _removed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.text, r.n_removed) for r in spans.without_repeats(df, Stage(spark)).collect()}


def sized(tag, *words):
    return "".join(" ".join(f"{tag}{k}_{j}" for j in range(n)) + ". " for k, n in enumerate(words))


@pytest.mark.parametrize("words", [(38, 9, 4), (45, 3), (3,) * 20, (1,) * 12, (9, *(1,) * 6), (2, 1, 1, 9, 1, 1)])
def test_repeated_passages_go_to_their_last_sentence(spark, words):
    passage, n = sized("p", *words), len(words)
    texts = [sized("a", 6) + passage + sized("b", 5), sized("c", 1) + passage + sized("d", 30, 4), passage]
    assert _removed(spark, texts) == {
        0: (texts[0], 0), 1: (sized("c", 1) + sized("d", 30, 4), n), 2: ("", n)}


def test_short_lines_and_passages_below_the_bounds(spark):
    verse = "".join(f"line {i}\n" for i in range(30))
    unspaced = "".join(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}\n" for i in range(12))
    small = "only four words here. and five more of them.\n"
    got = _removed(spark, ["x. " + verse + unspaced, "y! " + verse + "z. " + unspaced, small + "e", small + "f"])
    assert got[1] == ("y! z. ", 42) and got[2] == (small + "e", 0) and got[3] == (small + "f", 0)


# ------------------------------------------------------------ fingerprints ----
def signature_set(text):
    w = [x.translate(LOW) for x in re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", text)]
    content = [i for i, x in enumerate(w) if x not in set(spotsigs.ANCHORS)]
    out = set()
    for i, x in enumerate(w):
        k = bisect.bisect_right(content, i)
        if x in spotsigs.ANCHORS and k + spotsigs.CHAIN <= len(content):
            out.add((x, *(w[j] for j in content[k: k + spotsigs.CHAIN])))
    return out or {tuple(w) or text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("part_bytes", [1 << 24, 40_000])
def test_fingerprints_and_edits(corpus, rows, part_bytes):
    got = spotsigs.fingerprints(corpus, part_bytes=part_bytes).collect()
    assert len(got) == len(rows)
    unique = sorted((i, t or "") for i, t in rows if i is not None)
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append(r)
    for (i, t), (_, following) in zip(unique[:-1], unique[1:]):
        if i == 900_006:
            continue
        r, half = mine[i][0], len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        a, b = signature_set(t), signature_set(changed)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(a, b)) < 1e-9 and abs(
            r.near_next - jaccard(a, signature_set(following))) < 1e-9
        assert len(base64.b64decode(r.fingerprint)) == 4 * len(a)
    by_text = {}
    for i, t in unique:
        by_text.setdefault(t, set()).add(mine[i][0].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_pruned_similarity_and_small_tables(spark, empty):
    a, b = np.arange(10, dtype=np.uint32), np.arange(9, 12, dtype=np.uint32)
    of = [np.zeros(10, int), np.zeros(3, int)]
    assert spotsigs.jaccard(a, of[0], b, of[1], 1)[0] == pytest.approx(1 / 12)
    assert spotsigs.jaccard(a, of[0], b, of[1], 1, least=0.8)[0] == 0
    one = spark.createDataFrame([(1, "the quick brown fox")], "doc_id long, text string")
    r = spotsigs.fingerprints(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert spotsigs.fingerprints(empty).count() == 0


# ------------------------------------------------------------------ shards ----
def shard_of(doc_id, weights, seed=1):
    def draw(i, w):
        h = 42
        for raw in (np.int32(seed), np.int32(i)):
            h = xxhash.xxh64_intdigest(raw.tobytes(), seed=h)
        h = xxhash.xxh64_intdigest(np.int32(doc_id is None).tobytes(), seed=h)
        h = xxhash.xxh64_intdigest(np.int64(doc_id or 0).tobytes(), seed=h)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / w
    return min(range(len(weights)), key=lambda i: draw(i, weights[i]))


def test_shards_slots_and_growth(corpus, rows, stage):
    tree = hashtree.Tree((((1.0, 2.0), (1.0,)), ((3.0,), (1.0, 1.0))))
    got = hashtree.assign(corpus, stage, tree, per_bucket=1).collect()
    assert len(got) == len(rows)
    leaves = tree.leaves()
    place = {0: (0, 0), 1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (1, 1), 5: (1, 1)}
    for r in got:
        assert r.shard == shard_of(r.doc_id, leaves) and (r.region, r.rack) == place[r.shard]
        assert r.grown_shard == shard_of(r.doc_id, [*leaves, 1.0]) and r.grown_shard in (r.shard, 6)
    for s in set(r.shard for r in got):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want


def test_shares_follow_weights(spark, stage, empty):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'t' AS text")
    tree = hashtree.Tree((((1.0, 3.0),), ((2.0, 2.0),)))
    n = Counter(r.shard for r in hashtree.assign(docs, stage, tree).select("shard").collect())
    for i, w in enumerate(tree.leaves()):
        assert abs(n[i] / 40_000 - w / 8) < 0.015
    assert hashtree.assign(empty, Stage(docs.sparkSession), tree).count() == 0


# ------------------------------------------------------------ code lengths ----
def test_code_lengths_match_one_tree(corpus, rows):
    depth = 4
    token = re.compile(rb"[^\x20\x09-\x0D]+")
    texts = [(i, [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w)
                  for w in token.findall((t or "").encode())]) for i, t in rows]
    held = [zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _ in texts]
    counts, grams, asked, keys = Counter(), Counter(), set(), []
    for (i, w), out in zip(texts, held):
        s = b"\n" * depth + b" ".join(w) + b"\n"
        k = [int.from_bytes(bytes([s[j - d] for d in range(1, depth + 1)] + [s[j]]), "big")
             for j in range(depth, len(s))]
        keys.append(k)
        asked.update(k)
        if not out:
            counts.update(w)
            counts["end"] += 1
            grams.update(k)
    n, v = sum(counts.values()), len(counts)
    key = np.array(sorted(asked), dtype=np.uint64)
    levels, logs = ctw_tree.block_weights(key, np.array([grams[int(k)] for k in key], float), depth, 0)
    value = dict(zip(key.tolist(), ctw_tree.log_probability(ctw_tree.path(levels, logs, depth, 0)).tolist()))
    got = ctw.score(corpus, Stage(corpus.sparkSession), depth=depth, chunk_bytes=60_000).collect()
    want = []
    for (i, w), out, k in zip(texts, held, keys):
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, "end"])
        want.append((str(i), out, len(w) + 1, sum(counts[x] > 0 for x in [*w, "end"]), base, sum(value[x] for x in k)))
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert len(mine) == len(want) and {r.train_tokens for r in got} == {n}
    for a, b in zip(mine, sorted(want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5, abs=1e-5)


def test_block_probability_is_that_of_the_sequence():
    """The product of sequential estimates over two binary contexts, mixed by hand."""
    def kt(a, b):
        p = 1.0
        for x in range(a):
            p *= (x + 0.5) / (x + 1)
        for x in range(b):
            p *= (x + 0.5) / (a + x + 1)
        return p
    assert np.exp(ctw_tree.log_kt(np.array([3.0]), np.array([2.0])))[0] == pytest.approx(kt(3, 2))
    # contexts 1 and 2 of one byte; bytes 0 and 128 differ in their first bit
    key = np.array([(1 << 8) | 0, (1 << 8) | 128, (2 << 8) | 128], dtype=np.uint64)
    _, logs = ctw_tree.block_weights(key, np.array([3, 1, 4]), 1, 0)
    assert np.exp(logs[0][0][0]) == pytest.approx(0.5 * kt(3, 5) + 0.5 * kt(3, 1) * kt(0, 4))


def test_probabilities_of_the_next_byte_sum_to_one():
    rng = np.random.default_rng(4)
    seen = np.unique(rng.integers(0, 4, (60, 3)).astype(np.uint64) @ np.array([1 << 16, 1 << 8, 1], np.uint64))
    ask = np.unique(np.concatenate([seen, (np.uint64(2) << np.uint64(16)) | (np.uint64(1) << np.uint64(8)) | np.arange(
        256, dtype=np.uint64)]))
    n = np.where(np.isin(ask, seen), 3, 0)
    levels, logs = ctw_tree.block_weights(ask, n, 2, 0)
    p = 10.0 ** ctw_tree.log_probability(ctw_tree.path(levels, logs, 2, 0))
    assert p[(ask >> np.uint64(8)) == np.uint64((2 << 8) | 1)].sum() == pytest.approx(1)


def test_contexts_reach_across_tokens(spark, stage):
    """Words in a fixed cycle: the token counts cannot see the order, the model can."""
    cycle = "ab cd ef gh ij kl mn op".split()
    docs = [(i, " ".join(cycle[(i + k) % 8] for k in range(60))) for i in range(100)]
    got = ctw.score(spark.createDataFrame(docs, "doc_id long, text string"), stage)
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.b < r.s / 5 < 0


def test_code_lengths_of_an_empty_table(empty, stage):
    assert ctw.score(empty, stage).count() == 0


def test_rows_of_two_equal_bytes_spread_over_shards():
    """What follows one pair of bytes goes to many shards; three equal bytes decide."""
    third = np.arange(256, dtype=np.uint64)
    for depth in (4, 6):
        key = (np.uint64(0x6572) << np.uint64(8 * depth - 8)) | (third << np.uint64(8 * depth - 16))
        shard = ctw._shard_of(key, depth, 64)
        assert len(set(shard.tolist())) > 32
        assert (shard == ctw._shard_of(key | np.uint64(0xFFFF), depth, 64)).all()
