"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the multiset of its runs of five words (letters, digits and everything outside
ASCII; A-Z lowered), a shorter text the one run of all its words. A run that occurs x times
owns the region [0, x) of a weight axis. Darts fall on every run's axis in order of rank, as
a Poisson process that only the run's hash decides; each lands at a weight and at one of k
coordinates. A text's signature keeps the dart of least rank per coordinate within its
regions, so two texts agree at a coordinate with probability sum(min)/sum(max), their
weighted Jaccard similarity. Ranks are only generated up to where about ``k (ln k + 4)`` darts
fall, whatever the text's length; texts with an empty coordinate go on to twice that rank.

The signature is cut into bands. Texts that share a band are compared exactly, without
listing all pairs: first each with the least of its band, then, where the texts of a band
still lie in several components, those of different components in blocks of bounded size.
So the components are those of all pairs of a band that reach the similarity.

Defined cases: a null text is empty; texts with the same word sequence are one class, texts
without any word one class per equal text; rows repeated exactly are rows of one class; a
null doc_id is a row like any other; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicade.llm.components import components
from lexicade.llm.stage import NO_ID, Stage, keyed
from lexicade.llm.textbytes import (
    LOWER, WORD, U, WordHash, blocks, mix, release, sequence_keys, shingles, word_spans,
)

BANDS, ROWS = 25, 5
BLOCK = 1000  # texts of one band that are compared in one task
_STEP = U(0xD1342543DE82EF95)


def _times(n: int, step: int = 0xD1342543DE82EF95) -> np.uint64:
    return U(n * step % (1 << 64))


def weighted_elements(h: np.ndarray, doc: np.ndarray):
    """Distinct (element, text) with their counts, by text."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return h[first], doc[first], np.diff(np.r_[first, len(h)])


def expanded(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: the n-th occurrence of an element is an element of its own."""
    e, d, n = weighted_elements(h, doc)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(e, n) + nth.astype(U) * _STEP), np.repeat(d, n)


def _darts(h, doc, weight, limit, k):
    """(text, coordinate, rank, dart) of all darts below each text's rank limit."""
    out = []
    cell = 0
    while len(h):
        low, width = (0.0, 1.0) if cell == 0 else (2.0 ** (cell - 1), 2.0 ** (cell - 1))
        a_h, a_d, a_x = mix(h + _times(cell + 1)), doc, weight
        rank = np.zeros(len(h))
        n = 0
        while len(a_h):
            n += 1
            dart = mix(a_h + _times(n, 0x9E3779B97F4A7C15))
            rank = rank - np.log(((dart >> U(11)).astype(np.float64) + 1) * 2.0**-53) / width
            on = rank < limit[a_d]
            a_h, a_d, a_x, rank, dart = a_h[on], a_d[on], a_x[on], rank[on], dart[on]
            spot = mix(dart ^ U(0xA0761D6478BD642F))
            at = low + width * ((spot & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            hit = at < a_x
            out.append((a_d[hit], ((spot >> U(32)) % U(k)).astype(np.int64)[hit], rank[hit], dart[hit]))
        cell += 1
        more = weight > 2.0 ** (cell - 1)
        h, doc, weight = h[more], doc[more], weight[more]
    return [np.concatenate(x) for x in zip(*out)]


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """k dart ids for each text that has elements; zeros for one that has none."""
    e, d, n = weighted_elements(h, doc)
    total = np.bincount(d, weights=n, minlength=n_docs)
    signature = np.zeros((n_docs, k), dtype=U)
    limit = k * (math.log(k) + 4) / np.maximum(total, 1)
    open_ = total > 0
    while open_.any():
        mine = open_[d]
        t, c, rank, dart = _darts(e[mine], d[mine], n[mine], limit, k)
        order = np.argsort(-rank, kind="stable")
        at = (t * k + c)[order]
        flat = np.zeros(n_docs * k, dtype=U)
        flat[at] = dart[order]  # the least rank is written last
        got = np.zeros(n_docs * k, dtype=bool)
        got[at] = True
        full = got.reshape(n_docs, k).all(axis=1) & open_
        signature[full] = flat.reshape(n_docs, k)[full]
        open_ &= ~full
        limit = limit * 2
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), dtype=U)
    for r in range(rows):
        keys = mix(keys + signature[:, r::rows][:, :bands] + _times(r + 1))
    return mix(keys + np.arange(1, bands + 1, dtype=U) * _STEP)


def _binary16(high: np.ndarray, low: np.ndarray) -> pa.Array:
    both = np.stack([high, low], axis=1).astype(">u8")
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(high), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def _shingled(batch: pa.RecordBatch, size: int):
    """Per block of texts: rows, node ids, shingles and their texts, and which have words."""
    hasher = WordHash()
    column = batch.column("text")
    for a, b, data, offsets in blocks(column):
        data = LOWER[data]
        starts, ends, doc = word_spans(data, offsets, WORD)
        words = hasher(data, starts, ends)
        n = b - a
        one, two = (sequence_keys(words, doc, n, seed) for seed in (11, 12))
        some = np.bincount(doc, minlength=n) > 0
        for i in np.flatnonzero(~some):
            raw = column[a + int(i)].as_py() or ""
            both = hashlib.blake2b(raw.encode(), digest_size=16, person=b"wordless").digest()
            one[i], two[i] = np.frombuffer(both, dtype=">u8")
        h, d = shingles(words, doc, n, size)
        yield a, b, one, two, h, d, some


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, one, two, h, d, some in _shingled(batch, size):
                keys = band_keys(signatures(h, d, b - a, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a),
                     _binary16(one, two), _lists(keys[some].ravel(), np.where(some, bands, 0))],
                    names=["doc_id", "text_hash", "node", "bands"])
        release()
    return run


def _elements(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, one, two, h, d, _ in _shingled(batch, size):
                e, of = expanded(h, d)
                yield pa.RecordBatch.from_arrays(
                    [_binary16(one, two), _lists(e, np.bincount(of, minlength=b - a))],
                    names=["node", "elements"])
        release()
    return run


def _compare(similarity: float):
    """Links between texts of different components in one pair of blocks of a band."""
    def run(table: pa.Table) -> pa.Table:
        nodes, roots = table["node"].to_pylist(), table["root"].to_pylist()
        block = table["block"].to_numpy()
        lists = table["elements"].combine_chunks()
        flat = lists.flatten().to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        m = len(nodes)
        of = np.repeat(np.arange(m), sizes)
        _, ids = np.unique(flat, return_inverse=True)
        order = np.argsort(ids, kind="stable")
        posting, edge = of[order], np.r_[0, np.cumsum(np.bincount(ids))]
        begin = np.r_[0, np.cumsum(sizes)]
        _, group = np.unique(np.array(roots, dtype=object), return_inverse=True)
        group = group.copy()
        both = len(np.unique(block)) > 1
        a_out, b_out = [], []
        for x in range(m):
            if (group == group[0]).all():
                break
            mine = ids[begin[x]: begin[x + 1]]
            hits = np.concatenate([posting[edge[i]: edge[i + 1]] for i in mine]) if len(mine) else of[:0]
            shared = np.bincount(hits, minlength=m)
            close = shared >= similarity * (sizes + sizes[x] - shared) - 1e-9
            close &= group != group[x]
            if both:
                close &= block != block[x]
            for y in np.flatnonzero(close):
                if group[y] != group[x]:
                    a_out.append(nodes[x])
                    b_out.append(nodes[y])
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})
    return run


def near_duplicates(
    docs: DataFrame, stage: Stage, similarity: float = 0.8, words: int = 5,
    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, text_hash, class_id, n_class, keep) for every row of ``docs``.

    class_id is the least doc_id of the class. ``keep`` is true for one document of it;
    rows that repeat that document exactly carry true as well.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = stage.keep(docs.mapInArrow(
        _sign(words, bands, rows),
        "doc_id long, text_hash long, node binary, bands array<long>"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = stage.keep(
        signed.groupBy("node").agg(F.min(order).alias("rep"), F.count("*").alias("n")), "nodes")

    keys = signed.select("node", F.explode("bands").alias("key")).distinct()
    keys = stage.keep(keys, "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("first")).where("m > 1")
    bucket = stage.keep(keys.join(shared, "key"), "buckets")

    # the shingles of the texts that share a band with another
    wanted = bucket.select("node").distinct().join(nodes, "node").select(
        "node", F.coalesce("rep.doc_id", F.lit(NO_ID)).alias("i"), F.col("rep.text_hash").alias("text_hash"))
    found = (
        docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), "text_hash", "text")
        .join(wanted.select("i", "text_hash").hint("merge"), ["i", "text_hash"], "left_semi")
    )
    sets = stage.keep(
        found.mapInArrow(_elements(words), "node binary, elements array<long>")
        .dropDuplicates(["node"]), "sets")

    pairs = bucket.where("node != first").select(
        F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - F.lit(1e-9)
    star = stage.keep(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
        .where(alike).select("a", "b"), "star")
    first = stage.keep(components(star, stage, "first"), "first")

    # bands whose texts are not one component yet; two texts have been compared already
    labelled = (
        bucket.where("m > 2").join(first, "node", "left")
        .select("key", "node", "m", F.coalesce("root", "node").alias("root"))
    )
    labelled = stage.keep(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key")
    n_blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    rest = (
        labelled.join(mixed, "key", "left_semi")
        .withColumn("g", n_blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "node", "root")
        .join(sets, "node")
    )
    more = rest.groupBy("key", "i", "j").applyInArrow(_compare(similarity), "a binary, b binary")
    links = stage.keep(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "links")
    final = components(links, stage, "final")

    joined = stage.keep(
        nodes.join(final, "node", "left").select("node", "rep", "n", F.coalesce("root", "node").alias("root")),
        "rooted")
    classes = joined.groupBy("root").agg(F.min("rep").alias("best"), F.sum("n").alias("n_class"))
    table = stage.keep(joined.join(classes, "root").select("node", "best", "n_class"), "classes")
    same = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash"))
    return signed.select("doc_id", "text_hash", "node").join(table, "node").select(
        "doc_id", "text_hash", F.col("best.doc_id").alias("class_id"), "n_class", same.alias("keep"))


def one_of_each(docs: DataFrame, stage: Stage, **options) -> DataFrame:
    """The rows of ``docs`` with one document of every class, all columns as they were."""
    keep = stage.keep(near_duplicates(docs, stage, **options), "decided").where("keep")
    keys = stage.keep(
        keep.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("text_hash").alias("h"))
        .agg(F.count("*").alias("n")), "kept")
    found = keyed(docs).join(keys.select("i", "h").hint("merge"), ["i", "h"], "left_semi")
    if keys.where("n > 1").limit(1).count():  # rows that repeat exactly: one of them
        found = found.dropDuplicates(["i", "h"])
    return found.select("doc.*")
