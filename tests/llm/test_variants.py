"""Spelling variants against words compared pair by pair."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexicade.llm import variants as va
from lexicade.llm.stage import Stage
from tests.llm.conftest import CLASHING, SCHEMA

LOW = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def near(words):
    """Near words of every word, found over what is left without one code point."""
    cut = {}
    for w in words:
        for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            cut.setdefault(x, set()).add(w)
    out = {w: set() for w in words}
    for group in cut.values():
        if len(group) > 1:
            for a in group:
                out[a] |= {b for b in group if one_edit(a, b)}
    return out


def wanted(rows, least=7, count=2, ratio=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: m for w, m in n.items() if len(w) >= least and m >= count}
    beside, form = near(n), {}
    for w in n:
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w, m in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, m, len(beside[w]), n.get(form.get(w))))
    return sorted(out, key=repr)


def found(df, spark, **how):
    got = va.variants(df, Stage(spark), **how)
    return sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()], key=repr)


@pytest.mark.parametrize("most", [va.MOST, 3])
def test_given_and_odd_texts(spark, corpus, rows, most):
    got = found(corpus, spark, most=most)
    assert got == wanted(rows)
    assert sum(r[4] > 0 for r in got) > 100


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_few_letters_and_chains(spark, most):
    """Two letters, so that nearly all words are near others, and forms that follow each other."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(120)})
    texts = [" ".join(w for w in words for _ in range(rng.choice((1, 2, 3, 30)))) for _ in range(3)]
    chain = [w for x in "klmnop" for w in [f"chain{x}abc"] * 2 + [f"chain{x}abcd"] * 25 + [f"chain{x}abzd"] * 260]
    rows = [(i, t) for i, t in enumerate([*texts, " ".join(chain)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df, spark, most=most)
    assert got == wanted(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a root beyond the form


def test_prefix_that_all_words_share_is_split(spark):
    rows = [(1, " ".join(f"{'same' * 6}{a}{b}{'tail' * 3}" for a in "abcdefgh" for b in "abcdefgh" for _ in range(2)))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), spark, most=5) == wanted(rows)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=7, max_size=11), min_size=1, max_size=40))
def test_machine_lists_each_pair_once(words):
    ordered = sorted(words)
    got = [tuple(sorted(p)) for p in va.Acceptor(ordered).one_edit()]
    assert len(got) == len(set(got))
    assert set(got) == {tuple(sorted((a, b))) for a in words for b in words if a < b and one_edit(a, b)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", max_size=9), max_size=60))
def test_acceptor_is_minimal_and_exact(words):
    machine = va.Acceptor(sorted(words))
    language, todo = set(), [(0, "")]
    while todo:
        state, read = todo.pop()
        if machine.final[state]:
            language.add(read)
        todo += [(s, read + c) for c, s in machine.arcs[state].items()]
    assert language == words
    right = {}
    for state in range(len(machine.arcs)):
        own = frozenset(machine.common(state, state))
        assert right.setdefault(own, state) == state or state == 0


def test_long_words_and_empty_table(spark, empty):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long}c {long} {long}c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, spark) == [(long, None, long, 2, 1, None), (long + "c", None, long + "c", 2, 1, None)]
    assert found(empty.withColumns({c: F.lit("x") for c in CLASHING}), spark) == []
    assert found(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), spark) == []


def test_letters_outside_ascii_keep_their_case(spark):
    rows = [(1, "ÀÉÎÕÜÿß ÀÉÎÕÜÿß àéîõüÿß àéîõüÿß STRASSENß strassenß")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, spark) == wanted(rows)
