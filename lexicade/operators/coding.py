"""Dictionary-coded tokens: n-grams counted as packed numbers, words again only at the end.

A word of the dictionary is a number from 1 on, any other token is 0. An n-gram of up to three
dictionary words is one 64-bit number, 21 bits a word. Tokens are coded once per column; every
later step reads arrays of integers. The dictionary goes to all tasks and is
therefore only made where it is measured to have at most MAX_WORDS words and DICT_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 21
MAX_WORDS = (1 << BITS) - 1
DICT_BYTES = 64 << 20
TOKENS_AT_A_TIME = 1 << 18
ROWS_AT_A_TIME = 512  # documents coded at a time
MAX_KNOWN = 1 << 23  # n-grams that go to all tasks, 16 bytes each
TASK_ROWS = 2_000_000  # counts that one task groups


def dictionary(frequent: DataFrame, max_words: int = MAX_WORDS, max_bytes: int = DICT_BYTES) -> Broadcast | None:
    """The words of a stored table, ascending, for all tasks; None where they are too many or too long."""
    n, size = frequent.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n > max_words or size > max_bytes:
        return None
    words = frequent.select("word").toArrow()["word"].combine_chunks().cast(pa.string())
    words = words.take(pc.array_sort_indices(words))
    return frequent.sparkSession.sparkContext.broadcast(words)


def _coded(words: Broadcast, keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in (b.slice(lo, ROWS_AT_A_TIME) for b in batches for lo in range(0, b.num_rows, ROWS_AT_A_TIME)):
            lists = batch.column("tokens")
            # an empty list counts as one empty token, a null has none
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            sizes = np.where(np.isnan(sizes), 0, sizes).astype(np.int64)
            ids = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=known), -1).to_numpy() + 1
            empty = (sizes == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            if empty.any():
                none = pc.index_in(pa.array([""]), value_set=known)[0].as_py()
                ids = np.insert(ids, np.cumsum(sizes)[empty], 0 if none is None else none + 1)
                sizes = sizes + empty
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            coded = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], coded], names=[*keep, "ids"])
    return run


def code(docs: DataFrame, words: Broadcast, keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., ids) from rows with ``tokens``."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ids array<int>"
    return docs.select(*keep, "tokens").mapInArrow(_coded(words, keep), schema)


def packed_grams(ids: np.ndarray, doc: np.ndarray, n_range: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of all n-grams without an unknown word."""
    docs, grams = [], []
    for n in range(n_range[0], n_range[1] + 1):
        m = len(ids) - n + 1
        if m <= 0:
            continue
        gram, whole = np.zeros(m, dtype=np.int64), doc[:m] == doc[n - 1:]
        for i in range(n):
            gram = gram << BITS | ids[i: i + m]
            whole &= ids[i: i + m] > 0
        docs.append(doc[:m][whole])
        grams.append(gram[whole])
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(docs), np.concatenate(grams)


def _counted(batch: pa.RecordBatch, n_range: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, n-gram, count), some documents at a time; each n-gram once per document."""
    lists = batch.column("ids")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
    block = (ends - 1) // TOKENS_AT_A_TIME if len(ends) else ends
    edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(sizes)] if len(sizes) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        first = ends[a] - sizes[a]
        doc, gram = packed_grams(ids[first: ends[b - 1]].astype(np.int64), np.repeat(np.arange(a, b), sizes[a:b]), n_range)
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        at = np.flatnonzero(new)
        yield doc[at], gram[at], np.diff(np.append(at, len(doc)))


def _counts(n_range: tuple[int, int], keep: Sequence[str], known: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, gram, cnt in _counted(batch, n_range):
                if known is not None:
                    some = known.value
                    place = np.minimum(np.searchsorted(some, gram), max(0, len(some) - 1))
                    found = some[place] == gram if len(some) else np.zeros(len(gram), dtype=bool)
                    doc, gram, cnt = doc[found], gram[found], cnt[found]
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(at) for c in keep], pa.array(gram), pa.array(cnt.astype(np.int64))],
                    names=[*keep, "gram", "cnt"])
    return run


def gram_counts(coded: DataFrame, n_range: tuple[int, int], keep: Sequence[str], known: Broadcast | None = None) -> DataFrame:
    """Rows (keep..., gram, cnt) of every document's n-grams, of those in ``known`` (ascending) if given.

    A document's counts are made within its row: nothing is sorted or shuffled.
    """
    types = {f.name: f.dataType.simpleString() for f in coded.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", gram long, cnt long"
    return coded.select(*keep, "ids").mapInArrow(_counts(n_range, keep, known), schema)


def _sums(n_range: tuple[int, int], label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(label)
            one = pc.fill_null(pc.equal(labels, 1), False).to_numpy(zero_copy_only=False)
            known = labels.is_valid().to_numpy(zero_copy_only=False)
            for doc, gram, cnt in _counted(batch, n_range):
                order = np.argsort(gram, kind="stable")
                doc, gram, cnt = doc[order], gram[order], cnt[order]
                at = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, dtype=np.int64)
                pos = one[doc]
                values = (np.ones(len(doc)), pos, known[doc] & ~pos, cnt * pos, cnt * ~pos)
                sums = [np.add.reduceat(v.astype(np.int64), at) if len(at) else at for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(gram[at]), *map(pa.array, sums)], names=["gram", *SUMS])
    return run


SUMS = ("df", "df_pos", "df_neg", "c_pos", "c_neg")


def grams_at_most(coded: DataFrame, n_range: tuple[int, int]) -> int:
    """A number that the n-grams of all documents do not exceed."""
    tokens = coded.agg(F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0))).first()[0]
    return tokens * (n_range[1] - n_range[0] + 1)


def dealt_documents(coded: DataFrame, n_range: tuple[int, int], task_rows: int = TASK_ROWS) -> DataFrame:
    """The documents in so many partitions that a task makes at most about ``task_rows`` n-grams of its own.

    A task that sends its n-grams to more than 200 partitions holds them all to sort them, so they
    must not be as many as a part of the stored table happens to give.
    """
    parts = max(-(-grams_at_most(coded, n_range) // task_rows), coded.sparkSession.sparkContext.defaultParallelism)
    return coded.repartition(parts, *coded.columns)


def gram_sums(coded: DataFrame, n_range: tuple[int, int], label: str = "label", task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows (gram, df, df_pos, df_neg, c_pos, c_neg): documents and uses of every n-gram, in all and by label.

    Sums are made within some documents in Python, then in so many partitions, by n-gram, that each
    groups at most about ``task_rows`` of them, however large the input's partitions are. Without a label
    a document counts for ``df`` and ``c_neg`` only.
    """
    parts = max(1, -(-grams_at_most(coded, n_range) // task_rows))
    schema = "gram long, " + ", ".join(f"{c} long" for c in SUMS)
    some = dealt_documents(coded, n_range, task_rows).select(label, "ids").mapInArrow(_sums(n_range, label), schema)
    return some.repartition(parts, "gram").groupBy("gram").agg(*[F.sum(c).alias(c) for c in SUMS])


def merged(coded: DataFrame, keep: Sequence[str], task_tokens: int = 8 << 20) -> DataFrame:
    """One row for rows of one document (the same ``keep``); no n-gram reaches from one to another."""
    tokens = coded.agg(F.coalesce(F.sum(F.size("ids").cast("long") + 1), F.lit(0))).first()[0]
    parts = coded.repartition(max(1, -(-tokens // task_tokens)), *keep)
    lists = parts.groupBy(*keep).agg(F.collect_list(F.concat("ids", F.array(F.lit(0)))).alias("_l"))
    return lists.select(*keep, F.flatten("_l").alias("ids"))


def _known(n_range: tuple[int, int], keep: Sequence[str], known: Broadcast, words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, dfs = known.value
        for batch in _counts(n_range, keep, None)(batches):
            gram = batch.column("gram").to_numpy()
            place = np.minimum(np.searchsorted(grams, gram), max(0, len(grams) - 1))
            found = grams[place] == gram if len(grams) else np.zeros(len(gram), dtype=bool)
            some, place = batch.filter(pa.array(found)), place[found]
            yield pa.RecordBatch.from_arrays(
                [*[some.column(c) for c in keep], _terms(words.value, gram[found]), pa.array(dfs[place] if len(dfs) else dfs),
                 some.column("cnt")], names=[*keep, "term", "df", "cnt"])
    return run


def known_gram_counts(
    coded: DataFrame, vocab: DataFrame, words: Broadcast, n_range: tuple[int, int], keep: Sequence[str],
    max_known: int = MAX_KNOWN,
) -> DataFrame | None:
    """Rows (keep..., term, df, cnt) of the n-grams of a stored (gram, df), without a sort, a shuffle or a join.

    None where they are too many to go to all tasks.
    """
    if vocab.limit(max_known + 1).count() > max_known:
        return None
    table = vocab.select("gram", "df").toArrow()
    order = np.argsort(table["gram"].to_numpy())
    known = coded.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("gram", "df")))
    types = {f.name: f.dataType.simpleString() for f in coded.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", term string, df long, cnt long"
    return coded.select(*keep, "ids").mapInArrow(_known(n_range, keep, known, words), schema)


def _terms(words: pa.Array, gram: np.ndarray) -> pa.Array:
    """The words of packed n-grams."""
    parts = []
    for i in (2, 1, 0):
        one = gram >> (BITS * i) & MAX_WORDS
        parts.append(words.take(pa.array(one - 1, mask=one == 0)))
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _spelled(words: Broadcast, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            gram = batch.column("gram").to_numpy(zero_copy_only=False)
            term = _terms(known, gram)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], term], names=[*names, "term"])
    return run


def spell(rows: DataFrame, words: Broadcast) -> DataFrame:
    """Add ``term``, the words of ``gram``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_spelled(words, rows.columns), f"{fields}, term string")
