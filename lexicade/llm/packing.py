"""Documents packed into sequences of bounded length by the sum-of-squares rule.

A document is its token ids with an end id; a longer one than a sequence is cut into whole
sequences, after a first piece with what is left over. The pieces are dealt evenly to shards
of about ``per_shard`` documents, which are packed apart (what a shard wastes is about one
sequence in a thousand). In a shard, longest piece first, a piece goes into the open sequence
for which the sum over all residual gaps of (number of open sequences with that gap) squared
becomes least; of equal choices the tightest gap wins, and a sequence is opened when no open
one has room. A full piece is a sequence of its own.

Defined cases: a null or empty text is a document of the end id alone; rows that repeat are
documents of their own; a null doc_id is kept; an empty table gives no piece; other columns
are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage
from lexicade.llm.textbytes import release
from lexicade.llm.tokens import encoded

CAPACITY = 1024
PER_SHARD = 50_000


def cut(counts: np.ndarray, capacity: int):
    """(document, piece, start, length) of every piece of documents of these lengths."""
    over = counts % capacity
    pieces = counts // capacity + (over > 0)
    doc = np.repeat(np.arange(len(counts)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.where(over > 0, over, np.minimum(counts, capacity))[doc]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first, capacity)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces shorter than ``capacity``, placed in the given order."""
    n = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        # a sequence of gap g becomes one of gap g - s: change of the sum, for g = s, s + 1, ...
        change = 2 * (n[: capacity + 1 - s] - n[s:]) + 2
        change[0] = 1 - 2 * n[s]  # filled up, so no longer counted
        gap = s + int(np.where(n[s:] > 0, change, 1 << 60).argmin())
        if n[gap]:
            n[gap] -= 1
            here = held[gap].pop()
        else:
            gap, here = capacity, opened
            opened += 1
        sequence[i], offset[i] = here, capacity - gap
        if gap > s:
            n[gap - s] += 1
            held[gap - s].append(here)
    return sequence, offset


def _pieces(path: str, end: int, capacity: int, shards: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dealt = TaskContext.get().partitionId()
        for batch in batches:
            for a, b, ids, counts in encoded(batch, path, end):
                doc, piece, start, length = cut(counts, capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = [ids[x: x + n].astype("<u4").tobytes() for x, n in zip(at.tolist(), length.tolist())]
                shard = (dealt + np.arange(b - a)) % shards
                dealt += b - a
                rows = batch.column("doc_id").slice(a, b - a).take(pa.array(doc))
                columns = [rows, pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                           pa.array(shard[doc].astype(np.int32))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            release()
    return run


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        # a fixed order: longest first, then by the piece itself
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy(), -lengths))
        sequence, offset = (np.empty(len(order), dtype=np.int64) for _ in range(2))
        sequence[order], offset[order] = sum_of_squares(lengths[order], capacity)
        sequence += table["shard"].to_numpy().astype(np.int64) << 32
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    return run


def pack(
    docs: DataFrame, stage: Stage, tokenizer: str, end: int = 2, capacity: int = CAPACITY,
    per_shard: int = PER_SHARD, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    ids are little-endian unsigned 32-bit integers.
    """
    shards = max(1, -(-docs.count() // per_shard))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int"
    schema += ", ids binary" if with_ids else ""
    pieces = stage.keep(docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer, end, capacity, shards, with_ids), schema), "pieces")
    full = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = pieces.where(F.col("length") < capacity).groupBy("shard").applyInArrow(
        _pack(capacity), f"{schema}, sequence_id long, offset long")
    return full.union(packed).drop("shard")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, doc_ids, ids) from packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
