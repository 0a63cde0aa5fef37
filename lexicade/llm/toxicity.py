"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding lowers a text, maps look-alike letters of other scripts, digits and the signs @ and $
inside words to the letters they stand for, and every punctuation mark to a space. The
lexicon holds whole words and word beginnings, each with a weight: the log ratio of its
document frequencies among toxic and other labelled texts, kept where it is ``LEAST_Z``
standard errors above zero. One automaton finds all entries and all exception phrases in one pass; a
match inside an exception phrase does not count, of the matches that begin at one word
the heaviest does, and a word that is repeated counts once. The matched weight, also normalised by the text's length, goes
through a logistic curve.

Entries and curve are learnt from at most ``sample`` labelled ids, those of least hash, and
where such ids repeat with other texts at most ``sample`` of their rows, those of least hash of
id and text (a documented bound; the same rows at any partitioning). Every entry that is
significant in them is kept. The curve is fitted on scores that each half of the sample gets
from a lexicon of the other half alone. Only the texts of labelled rows are learnt from;
scores depend on nothing but the text.

Defined cases: a null or empty text has no match and the least score; several labels of one
id count as toxic if any is; null labels and ids are not learnt from; without any labelled
row, or with one class only, the lexicon is empty and every score is the (smoothed) share of
toxic labels; repeated rows are scored alike; other columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicade.llm.textbytes import release

SAMPLE = 20_000
BEGINNINGS = (4, 5, 6)
LEAST_DOCS = 3
LEAST_Z = 3.0
# phrases in which a word of abuse is none
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "circus clown",
              "sore loser rule", "pond scum", "soap scum", "worthless currency")
# letters that look like a Latin one, and digits and signs that stand for one
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнαορνικτυεгп" "013457@$",
                      "aeopcyxijsdhlkmtbhaopviktuerп" "oieast" "as"))
_JOINED = re.compile(r"[@$](?!\w)")
_SPACES = "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~\n\r\t\x0b\x0c«»“”„‘’…–—¿¡·"
_TABLE = {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(c): " " for c in _SPACES}


def fold(text: str) -> str:
    text = text.lower()
    if "@" in text or "$" in text:
        text = _JOINED.sub(" ", text)
    return text.translate(_TABLE)


def some(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The strings of a column, a few at a time."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def terms(text: str) -> set[str]:
    """Words as " word ", beginnings of longer words as " begin"."""
    found = set()
    for w in set(fold(text).split()):
        found.add(f" {w} ")
        found.update(f" {w[:n]}" for n in BEGINNINGS if len(w) > n)
    return found


@dataclass(frozen=True)
class Model:
    """weights by entry; exception phrases; bias and slopes of the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {fold(phrase)} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def matched(text: str, automaton) -> tuple[float, int]:
    """Summed weight of the different words that match, and the number of words."""
    folded = f" {' '.join(fold(text).split())} "
    n = folded.count(" ") - 1 if len(folded) > 2 else 0
    best: dict[int, float] = {}
    safe = []
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                safe.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    by_word: dict[str, float] = {}
    for s, w in best.items():
        if not any(a <= s < b for a, b in safe):
            by_word[folded[s + 1: folded.index(" ", s + 1)]] = w
    return sum(by_word.values()), n


def features(total: float, n: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100.0 * total / (n + 20.0))


def _weights(positive: np.ndarray, negative: np.ndarray, n_pos: int, n_neg: int):
    """Log ratio of the smoothed frequencies, and how many standard errors that is."""
    rate = np.log((positive + 0.5) / (n_pos + 1.0)) - np.log((negative + 0.5) / (n_neg + 1.0))
    error = np.sqrt(1 / (positive + 0.5) + 1 / (negative + 0.5))
    return rate, np.where(positive >= LEAST_DOCS, rate / error, 0.0)


def lexicon(names: list[str], positive, negative, n_pos: int, n_neg: int) -> dict[str, float]:
    """The significant entries of positive weight."""
    if not n_pos or not n_neg or not names:
        return {}
    rate, z = _weights(np.asarray(positive, float), np.asarray(negative, float), n_pos, n_neg)
    return {names[i]: float(rate[i]) for i in np.flatnonzero((z >= LEAST_Z) & (rate > 1.0))}


def _significant(p: Column, q: Column, n_pos: int, n_neg: int) -> Column:
    """Whether counts may pass ``lexicon``; a little wider, so that no rounding decides here."""
    rate = F.log((p + 0.5) / (n_pos + 1)) - F.log((q + 0.5) / (n_neg + 1))
    z = rate / F.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    return (p >= LEAST_DOCS) & (z >= LEAST_Z - 1e-6)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression with slopes at or above zero, by Newton steps that never raise the loss.

    Half a row of each label without any match is added, so that one class or none has the
    smoothed share of toxic labels as its score.
    """
    x = np.column_stack([np.ones(len(x) + 2), np.vstack([x.reshape(-1, 2), np.zeros((2, 2))])])
    y = np.r_[y, 0.0, 1.0]
    weight = np.r_[np.ones(len(y) - 2), 0.5, 0.5]
    shrink = np.array([0.0, ridge, ridge])

    def loss(w: np.ndarray) -> float:
        t = x @ w
        return float(weight @ (np.logaddexp(0, t) - y * t) + shrink @ (w * w) / 2)

    share = float(weight @ y / weight.sum())
    w = np.array([math.log(share / (1 - share)), 0.0, 0.0])
    value = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + shrink * w
        free = np.array([True, w[1] > 0 or gradient[1] < 0, w[2] > 0 or gradient[2] < 0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.zeros(3)
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        scale = 1.0
        while scale > 1e-10:
            new = w - scale * step
            new[1:] = np.maximum(new[1:], 0)
            if loss(new) < value:
                break
            scale /= 2
        else:
            break
        moved = np.abs(new - w).max()
        w, value = new, loss(new)
        if moved < 1e-9:
            break
    return tuple(float(v) for v in w)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: of every term, in how many texts of each half and label it is."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        rows = zip(some(batch.column("text")), batch.column("half").to_pylist(),
                   batch.column("label").to_pylist())
        for text, half, label in rows:
            for t in terms(text or ""):
                counts.setdefault(t, Counter())[2 * half + label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string())]
            + [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4)],
            names=["term", "n0", "p0", "n1", "p1"])


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """Fit on the texts of ``docs`` that ``labels`` (doc_id, label 0/1) names."""
    known = (
        labels.where("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int"))
    )
    # at most ``sample`` rows of three numbers
    known = docs.sparkSession.createDataFrame(known.collect(), "doc_id long, label int, half int")
    named = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "doc_id", "text", "label", "half").dropDuplicates(["doc_id", "text"])

    def counted() -> dict[tuple[int, int], int]:
        return {(r.half, r.label): r.n for r in
                named.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}

    sizes = counted()
    if sum(sizes.values()) > sample:
        own = F.xxhash64("doc_id", "text", F.lit(13))
        last = named.select(own.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        named = named.where(own <= last)
        sizes = counted()
    n = {(h, y): sizes.get((h, y), 0) for h in (0, 1) for y in (0, 1)}
    sums = named.select("text", "label", "half").mapInArrow(
        _count_terms, "term string, n0 long, p0 long, n1 long, p1 long"
    ).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")])
    p, q = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
    n_pos, n_neg = n[0, 1] + n[1, 1], n[0, 0] + n[1, 0]
    # the entries of the three lexicons, bounded by the sampled texts
    rows = sums.where(
        _significant(p, q, n_pos, n_neg)
        | _significant(F.col("p0"), F.col("n0"), n[0, 1], n[0, 0])
        | _significant(F.col("p1"), F.col("n1"), n[1, 1], n[1, 0])).orderBy("term").collect()
    names = [r.term for r in rows]
    c = {k: np.array([r[k] for r in rows], float) for k in ("n0", "p0", "n1", "p1")}
    half = [Model(lexicon(names, c[f"p{h}"], c[f"n{h}"], n[h, 1], n[h, 0]), exceptions, (0, 0, 0))
            for h in (0, 1)]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [m.automaton() for m in half]
        for batch in batches:
            found = [matched(t or "", own[1 - h]) for t, h in
                     zip(some(batch.column("text")), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.int64())], names=["label", "total", "n"])

    # at most ``sample`` rows of three numbers
    scored = named.select("text", "label", "half").mapInArrow(cross, "label int, total double, n long")
    scored = scored.orderBy("label", "total", "n").collect()
    x = np.array([features(r.total, r.n) for r in scored]).reshape(-1, 2)
    y = np.array([r.label for r in scored], float)
    weights = lexicon(names, c["p0"] + c["p1"], c["n0"] + c["n1"], n_pos, n_neg)
    return Model(weights, exceptions, fit_curve(x, y))


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with one more column: ``toxicity`` of their ``text``, from 0 to 1."""
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.automaton()
        a, b, c = model.curve
        for texts in batches:
            out = np.zeros(len(texts))
            for i, t in enumerate(some(texts)):
                u, v = features(*matched(t or "", own))
                out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * u + c * v))))
            yield pa.array(out)
        release()

    return rows.select("*", scored(F.col("text")).alias("toxicity"))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows that are not held out."""
    return labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
