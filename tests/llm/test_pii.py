"""Personal data against the plain expressions, and contexts that give identifiers away."""

import re

import pytest
from pyspark.sql import functions as F

from lexicade.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def expected(text):
    found = [(m.start(), r, k, m.end()) for r, (k, p) in enumerate(PLAIN.items())
             for m in re.finditer(p, text or "") if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(found))


HARD = [
    "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4539 1488 0343 6467 4539148803436468",
    "+1 (974) 555-3436 and +49.30.1234567 +1 ", "a" * 50_000 + "@b.cc", "1.1.1", "@.@.a@b.c.", "é@b.cc 𝒳 a@b.cc",
    "x@" + "a" * 50_000, "4" * 19 + " 4" * 19, "1-1-1-1-1-1-1-1-1-1-1-1-1-6", "+1+2+3 +12345678901234567",
]


def test_base_spans_are_the_plain_matches(spark, corpus, rows, stage):
    texts = [t for _, t in rows] + HARD
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.i: r.s for r in df.select(F.col("doc_id").alias("i"), pii.joined(
        pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()}
    # digits alone would take the plain expression very long
    for i, t in enumerate(texts):
        if t is None or len(t) < 20_000:
            assert got[i] == expected(t), (i, t)


def _bootstrap(spark, stage, rounds=pii.ROUNDS):
    rows = [(i, f"number {i} my card no 4539148803436467 please keep it") for i in range(3)]
    rows += [(10 + i, f"my mail is user{i}@mail.example thanks a lot") for i in range(5)]
    rows += [(20, "my mail is user9atmail7 thanks a lot"), (21, "my mail is hidden thanks a lot"),
             (22, "room 404 is closed today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.s for r in pii.extract(df, stage, ["doc_id"], rounds).select(
        "doc.doc_id", pii.joined(F.col("spans")).alias("s")).collect()}


def test_contexts_of_seeds_find_other_identifiers(spark, stage):
    got = _bootstrap(spark, stage)
    assert got[20] == "email:11:23"  # no address by itself
    assert got[21] == "" and got[22] == ""
    # one card in three texts is one instance: no pattern has enough support
    assert got[0].count(":") == 2


def _found(spark, stage, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.s for r in pii.extract(df, stage, ["doc_id"]).select(
        "doc.doc_id", pii.joined(F.col("spans")).alias("s")).collect()}


def test_patterns_without_seeds_are_learnt_over_many_rounds(spark, stage):
    """Each context is reached through the identifiers that the one before gave away."""
    texts = [f"{a} mail is user{i}{end}" for a in ("my", "her") for end, n in (("@mail.example", 480), ("x0", 48))
             for i in range(n)]
    for k, c in enumerate("abcd"):
        texts += [f"{c}{c} {a}{c} user{i}x{j}" for a in ("login", "name") for j, n in ((k, 48 >> k), (k + 1, 24 >> k))
                  for i in range(n)]
    got = _found(spark, stage, texts)
    assert all(got[i] == f"email:{t.index('user')}:{len(t)}" for i, t in enumerate(texts))


def test_found_identifiers_are_found_in_any_context(spark, stage):
    texts = [f"my mail is user{i}@mail.example thanks" for i in range(20)] + [
        "my mail is user9x7 thanks", "nothing tells of user9x7.", "nor of (user9x7) or user9x70"]
    got = _found(spark, stage, texts)
    assert got[20] == "email:11:18" and got[21] == "email:17:25" and got[22] == "email:8:15"


def test_numbers_in_groups_are_found_whole(spark, stage):
    numbers = ["(523) 555-1055", "0171 555 1234", "4539 1488 0343 6468", "0171.555.1234", "(0171) (555) 12-34."]
    texts = [f"call me at +1 (974) 555-{i} now please" for i in range(3000, 3040)] + [
        f"call me at {n} now please" for n in numbers]
    got = _found(spark, stage, texts)
    for i, n in enumerate(numbers):
        assert got[40 + i] == f"phone:11:{11 + len(n)}", n


def test_open_instances_keep_every_token_outside_seeds(spark):
    tokens = re.compile(r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z0-9@._%+-]*[0-9@])[A-Za-z0-9@._%+-]+")
    texts = [t for t in HARD if len(t) < 20_000] + [
        "a1 22 33b 44-55 (6) 7", "4539148803436467 12 555", "12 34-a 5", "x@y 1\n2", "-1- 2 .. 3", "((1) 2)"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn(
        "base", pii.base_spans(F.col("t")))
    for r in df.withColumn("open", pii.spans(pii._without(F.col("t"), F.col("base")), "open")).collect():
        covered = {k for x in [*r.base, *r.open] for k in range(x.start, x.end)}
        assert all(set(range(*m.span())) <= covered for m in tokens.finditer(r.t)
                   if not any(b.start < m.end() and m.start() < b.end for b in r.base)), r.t


def test_masking_keeps_rows_and_columns(corpus, rows, stage):
    out = pii.mask(corpus, stage)
    assert out.columns == corpus.columns
    got = out.collect()
    assert len(got) == len(rows) and {r.row for r in got} == {"clash"}
    assert sorted((str(r.doc_id), r.text is None) for r in got) == sorted((str(i), t is None) for i, t in rows)
    assert all(expected(r.text).count("email") == 0 for r in got if r.text and len(r.text) < 20_000)


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([("abcdefgh",)], "t string")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(0).alias("rank"), F.lit(k).alias("kind"),
                               F.lit(e).alias("end")) for a, k, e in ((1, "ip", 4), (3, "card", 6))])
    assert df.select(pii.masked(F.col("t"), spans)).first()[0] == "a<IP>gh"


def test_empty_table(empty, stage):
    assert pii.extract(empty, stage, ["doc_id"]).count() == 0


def _plain_occurrences(text):
    """(instance, kind, patterns) of seeds and open instances, with Python's expressions."""
    seeds = [(int(a), int(b), k, text[int(a):int(b)]) for k, a, b in (x.split(":") for x in expected(text).split(",") if x)]
    rest = list(text)
    for a, b, *_ in seeds:
        rest[a:b] = "\n" * (b - a)
    every = seeds + [(m.start(), m.end(), None, m.group().strip(".-")) for m in re.finditer(pii.OPEN, "".join(rest))]
    for a, b, kind, instance in every:
        before = re.sub(r"\s+", " ", text[max(0, a - 64): a]).lower().strip(" ").split(" ")
        after = re.sub(r"\s+", " ", text[b: b + 64]).lower().strip(" ").split(" ")
        two = ([""] + before)[-2:]
        next_ = (after + [""])[:2]
        patterns = (f"{two[0]} {two[1]} _", f"{two[1]} _ {next_[0]}", f"_ {next_[0]} {next_[1]}")
        yield instance, kind, tuple(p for p in patterns if len(p) > 3)


def _plausible(i, kind):
    digits = sum(c in "0123456789" for c in i)
    if kind == "email":
        return "@" in i or (len(i) >= 6 and re.search("[A-Za-z]", i) is not None)
    return len(i) >= 6 and digits >= 3 if kind == "ip" else digits >= 6


def _plain_graph(texts):
    """Open instances with their kind where they are found, straight from the definitions."""
    contexts = {(i, k, p) for t in texts for i, k, p in _plain_occurrences(t)}
    members = {}
    for i, _, patterns in contexts:
        for p in patterns:
            members.setdefault(p, set()).add(i)
    told = {p for p, m in members.items() if len(m) >= pii.SUPPORT}
    seeds = {(p, i, k) for i, k, patterns in contexts if k for p in patterns if p in told}
    of = {}
    for i, k, patterns in contexts:
        if k is None and told & set(patterns):
            of.setdefault(i, set()).add(patterns)
    conf, counts, r = {}, None, 0

    def best(c, k):
        return max([conf.get((p, k), 0.0) for p in c])

    def confidence(i, k, without=None):
        miss = 1.0
        for c in of[i]:
            if without is None or without not in c:
                miss *= 1 - min(best(c, k), 0.99)
        return 1 - miss if _plausible(i, k) else 0.0

    while True:
        new = {}
        for p in told:
            for k in pii.KINDS:
                w = sum((p, i, k) in seeds for i in members[p])
                w += sum(confidence(i, k, p) for i in members[p] if any(p in c for c in of.get(i, ())))
                if w >= pii.SUPPORT - 1e-9 and w / len(members[p]) >= 0.5 - 1e-9:
                    new[p, k] = w / len(members[p])
        conf, r = new, r + 1
        now = len(conf), sum(c >= pii.CONFIDENT for c in conf.values())
        if r >= pii.ROUNDS and now == counts:
            break
        counts = now
    found = []
    for t in texts:
        for i, k, c in _plain_occurrences(t):
            if k is not None or i not in of:
                continue
            ways = [(min(confidence(i, k), sum(best(x, k) for x in of[i]) / len(of[i])), k) for k in pii.KINDS]
            ways += [(best(c, k) if _plausible(i, k) else 0.0, k) for k in pii.KINDS if c in of[i]]
            if max(ways)[0] >= pii.CONFIDENT - 1e-9:
                found.append((i, max(ways)[1]))
    return sorted(found)


PHONES = [f"call me at +1 (974) 555-30{i:02d} now please" for i in range(40)]
MAILS = [f"my mail is {n}@site{j}.org and that is all" for j, n in enumerate(("ann", "bob", "cem", "dan"))]
ROOMS = [f"my mail is {r} and that is all" for r in ("room404", "item7", "box2200", "v2")]
UNRELATED = ["I have 5 cats and 5 dogs", "in 2019 there were 5 houses", "see room404 and v2 of the manual",
             "the part 1234567 is sold", "a box2200 of 1234567 parts"]
CHAIN = [*[f"my mail is u{i}ser@a{i}.org and that is all" for i in range(40)],
         *[f"my mail is user{i}x7 and that is all" for i in range(8)],
         *[f"the login name user{i}x7 works for {i} days" for i in range(9)],
         *[f"write to user{i}x7 if need be" for i in range(4, 12)]]


@pytest.mark.parametrize("texts", [PHONES + ["call me at 5 now please"] + UNRELATED, MAILS + ROOMS + UNRELATED, CHAIN + UNRELATED,
                                   PHONES + ["call me at 1234567 now please"] * 2 + UNRELATED * 2])
def test_graph_is_the_plain_one(spark, stage, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for r in pii.extract(df, stage, ["doc_id"]).collect():
        base = {(x.start, x.end) for x in r.base}
        for x in r.spans:
            if (x.start, x.end) not in base:
                got.append((texts[r.doc.doc_id][x.start:x.end].strip(".-"), x.kind))
    assert sorted(got) == _plain_graph(texts)
    assert not {"5", "2019", "room404", "v2", "item7", "box2200"} & {i for i, _ in got}
    if texts[0] == CHAIN[0]:
        assert {(f"user{i}x7", "email") for i in range(9)} <= set(got)
