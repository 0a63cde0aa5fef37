"""Spelling variants: pairs of words within one edit, by composing finite-state machines.

The vocabulary is a minimal acceptor A. With a transducer T that copies symbols and makes one
edit, the composition A o T o A accepts exactly the pairs of words one edit apart. Before the
edit both sides are in the same state of A; the edit takes different arcs (a replacement) or
one arc more on one side; afterwards both sides must read the same rest, so what remains is
the intersection of the right languages of two states.

The composed machine is enumerated in parts, one per initial state. A pair whose longer word
has L code points shares its first L // 2 of them or, read backwards, its last L - L // 2: a
word therefore starts in four parts, (forwards or backwards, L or L + 1, the symbols read so far).
A part with more than ``most`` words is split at its initial state as the machine itself goes on
from there: copy one more symbol (a longer prefix), or edit here, after which the rest must be equal,
so that the rest belongs to the key. Both together hold every pair, each exactly once, and parts
in which the edit is made are no larger than the alphabet. Parts are streamed through tasks, one at a
time, and leave per word the number of its near words and the best of them, never a list.

Defined cases: null texts have no word; a null id is an empty string before the colon; rows that
repeat count again; words of any length take part; an empty table gives no row; other columns
are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicade.llm.sql import CRC_TABLE, UPPER, crc32_sql
from lexicade.llm.stage import Stage

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
DELETE_EVERY = 31
MOST = 20_000  # words of a part
PER_TASK = 40_000  # words of the parts that one task goes through
HELD = 200_000  # distinct words counted in a task before they are handed on
LONG = 1 << 20  # code points; a longer text is not listed whole
PARTS = ("back", "size", "depth", "exact", "key")

# near words meet in what is left of them without one code point: of both, or of the longer alone
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(run, '{UPPER}', '{UPPER.lower()}') AS run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{{LEAST_LENGTH},}}')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM runs, crc_table),
edited AS (SELECT n, CASE WHEN h % {DELETE_EVERY} = 0
    THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, left(word, i::BIGINT) || substr(word, i::BIGINT + 2) AS rest
  FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= {RATIO} * words.n THEN near END AS form,
    CASE WHEN near_n >= {RATIO} * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT chain.word, chain.next, forms.form FROM chain JOIN forms ON forms.word = chain.next)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE next IS NULL"""


# --- words ---------------------------------------------------------------------------------


def _runs(text: str, run: re.Pattern) -> Counter:
    if len(text) <= LONG:
        return Counter(run.findall(text))
    return Counter(m.group() for m in run.finditer(text))


def _count(least: int, every: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run can only lose one code point, so shorter ones are no words
        run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)
        lower = {c: c + 32 for c in range(65, 91)}
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in _runs(text, run).items():
                    word = word.lower() if word.isascii() else word.translate(lower)
                    h = zlib.crc32(word.encode(), begun)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()
    return words


def vocabulary(
    docs: DataFrame, stage: Stage, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, every: int = DELETE_EVERY,
) -> DataFrame:
    """Stored (word, n) of the words with at least ``least`` code points and ``count`` occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(_count(least, every), "word string, n long")
    total = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)
    return stage.keep(total, "words")


# --- machines ------------------------------------------------------------------------------


class Acceptor:
    """Minimal acyclic acceptor of words that come in ascending order.

    A state is a number; ``arcs[state]`` maps a symbol to the next state. States that accept the
    same right language are merged as soon as no later word can change them.
    """

    def __init__(self, words: Iterable[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # arcs of the last word that may still change
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            self._settle(path, same)
            state = path[-1][2] if path else 0
            for symbol in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[state][symbol] = len(self.arcs) - 1
                path.append((state, symbol, len(self.arcs) - 1))
                state = len(self.arcs) - 1
            self.final[state] = True
            before = word
        self._settle(path, 0)

    def _settle(self, path: list[tuple[int, str, int]], keep: int) -> None:
        while len(path) > keep:
            parent, symbol, state = path.pop()
            language = (self.final[state], *sorted(self.arcs[state].items()))
            known = self._known.setdefault(language, state)
            if known != state:
                self.arcs[parent][symbol] = known
                if state == len(self.arcs) - 1:  # the newest number can be given out again
                    self.arcs.pop()
                    self.final.pop()

    def common(self, x: int, y: int, without: str | None = None) -> Iterator[str]:
        """The strings accepted from both states, but those that begin with ``without``."""
        todo = [(x, y, "")]
        while todo:
            x, y, read = todo.pop()
            if self.final[x] and self.final[y]:
                yield read
            fewer, other = sorted((self.arcs[x], self.arcs[y]), key=len)
            for symbol in fewer:
                if symbol in other and not (symbol == without and not read):
                    todo.append((self.arcs[x][symbol], self.arcs[y][symbol], read + symbol))

    def one_edit(self, here_only: bool = False) -> Iterator[tuple[str, str]]:
        """All pairs of words one edit apart, each once: of equal length, or the longer first.

        The edit is made at the first place where the words differ; ``here_only`` makes it at the start.
        """
        read: list[str] = []
        todo: list[tuple[int, int, str]] = [(0, 0, "")]
        while todo:
            depth, state, symbol = todo.pop()
            del read[max(0, depth - 1):]
            if depth:
                read.append(symbol)
            arcs = self.arcs[state]
            for c, d in combinations(arcs, 2):
                for rest in self.common(arcs[c], arcs[d]):
                    begin = "".join(read)
                    yield begin + c + rest, begin + d + rest
            for c, after in arcs.items():
                for rest in self.common(after, state, without=c):
                    begin = "".join(read)
                    yield begin + c + rest, begin + rest
            if not here_only:
                todo.extend((depth + 1, after, c) for c, after in arcs.items())


def near_in_part(words: list[str], back: bool, size: int, depth: int, exact: bool) -> Iterator[tuple[str, str]]:
    """Pairs (longer or equal, other) of one part; ``words`` ascend and share ``depth`` symbols.

    The longer word has ``size`` code points. Pairs read backwards count where their beginnings differ.
    """
    begin, half = words[0][:depth], size // 2
    for u, v in Acceptor(w[depth:] for w in words).one_edit(exact):
        u, v = begin + u, begin + v
        if len(u) != size:
            continue
        if back:
            u, v = u[::-1], v[::-1]
            if u[:half] == v[:half]:
                continue  # found forwards
        yield u, v


# --- parts ---------------------------------------------------------------------------------


def parts_of(words: DataFrame) -> DataFrame:
    """Every word in its four first parts: (back, size, depth, exact, key, word as read, n)."""
    def part(back: bool, more: int):
        size = F.char_length("word") + more
        half = F.floor(size / 2).cast("int")
        read = F.reverse("word") if back else F.col("word")
        depth = size - half if back else half
        return F.struct(F.lit(back).alias("back"), size.alias("size"), depth.alias("depth"), F.lit(False).alias("exact"),
                        F.substring(read, F.lit(1), depth).alias("key"), read.alias("word"))

    four = F.array(*[part(b, m) for b in (False, True) for m in (0, 1)])
    return words.select(F.explode(four).alias("p"), "n").select("p.*", "n")


def split_part(rows: DataFrame) -> DataFrame:
    """The same words one state further: one more symbol read, or the edit made and the rest in the key."""
    length, depth = F.char_length("word"), F.col("depth")
    longer = length > depth
    skip = F.when(length == F.col("size"), 2).otherwise(1)
    rest = F.substring(F.col("word"), depth + skip, length)
    further = F.struct((depth + 1).alias("depth"), F.lit(False).alias("exact"),
                       F.substring(F.col("word"), F.lit(1), depth + 1).alias("key"))
    edited = F.struct(depth.alias("depth"), F.lit(True).alias("exact"),
                      F.concat("key", F.lit("\u0000"), rest).alias("key"))
    ways = F.when(longer, F.array(further, edited)).otherwise(F.array(edited))
    return rows.select("back", "size", F.explode(ways).alias("w"), "word", "n").select(
        "back", "size", "w.depth", "w.exact", "w.key", "word", "n")


def bounded_parts(words: DataFrame, stage: Stage, most: int) -> DataFrame:
    """Stored parts, none with more than ``most`` words unless its edit is already made."""
    rows, done, k = stage.keep(parts_of(words), "parts-0"), [], 0
    while True:
        heavy = stage.keep(rows.where("not exact").groupBy(*PARTS).count().where(F.col("count") > most).drop("count"),
                           f"heavy-{k}")
        if heavy.isEmpty():
            return _all(done, rows)
        done.append(rows.join(heavy, list(PARTS), "left_anti"))
        k += 1
        rows = stage.keep(split_part(rows.join(heavy, list(PARTS), "left_semi")), f"parts-{k}")


def _all(done: list[DataFrame], last: DataFrame) -> DataFrame:
    for rows in done:
        last = last.union(rows)
    return last


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part and word: its near words in that part and the best of them."""
    out: list[tuple[str, int, int, str]] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
            names=["word", "n_near", "n", "best"])

    def near(part: tuple, words: list[str], counts: list[int]) -> None:
        back, size, depth, exact, _ = part
        n = dict(zip((w[::-1] for w in words) if back else words, counts))
        found: dict[str, list] = {}
        for pair in near_in_part(words, back, size, depth, exact):
            for word, other in (pair, pair[::-1]):
                best = found.setdefault(word, [0, (0, "")])
                best[0] += 1
                best[1] = min(best[1], (-n[other], other))
        out.extend((word, m, -best[0], best[1]) for word, (m, best) in found.items())

    here, words, counts = None, [], []
    for table in batches:
        columns = [table.column(c).to_pylist() for c in (*PARTS, "word", "n")]
        for *part, word, n in zip(*columns):
            if part != here:
                if len(words) > 1:
                    near(here, words, counts)
                here, words, counts = part, [], []
                if len(out) >= 50_000:
                    yield batch()
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        near(here, words, counts)
    yield batch()


def near_words(words: DataFrame, stage: Stage, most: int = MOST) -> DataFrame:
    """Stored (word, n_near, best, best_n) of the words that have near ones.

    The best is the most frequent one, of equally frequent ones the first in code-point order.
    """
    rows = bounded_parts(words, stage, most)
    tasks = max(1, -(-rows.count() // PER_TASK))
    dealt = rows.repartition(tasks, *PARTS).sortWithinPartitions(*PARTS, "word")
    found = dealt.mapInArrow(_enumerate, "word string, n_near long, n long, best string")
    first = F.min(F.struct((-F.col("n")).alias("m"), F.col("best").alias("best")))
    return stage.keep(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("near")).select(
        "word", "n_near", F.col("near.best").alias("best"), (-F.col("near.m")).alias("best_n")), "near")


def roots(links: DataFrame, stage: Stage) -> DataFrame:
    """(word, root): the end of the forms from every word of ``links`` (word, form).

    Every round doubles the distance; counts grow along a chain, so it has no cycle.
    """
    here, k = stage.keep(links.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        ahead = here.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = here.join(ahead, "root", "left")
        moved = joined.where("next is not null").limit(1)
        if moved.isEmpty():
            return here
        k += 1
        here = stage.keep(joined.select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}")


def variants(
    docs: DataFrame, stage: Stage, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO,
    every: int = DELETE_EVERY, most: int = MOST,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    A word's form is its most frequent near word, if that has ``ratio`` times its occurrences.
    """
    words = vocabulary(docs, stage, least, count, every)
    near = near_words(words, stage, most)
    chosen = F.col("best_n") >= ratio * F.col("n")
    rows = stage.keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"), stage)
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
