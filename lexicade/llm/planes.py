"""Token ids on disk as shuffled planes.

The file format is a Parquet table; a row is a chunk, a run of whole documents with about
``chunk`` ids. Its ids are cut into blocks of ``block``; a block is transposed into byte planes
(the i-th byte of every id) or bit planes (the i-th bit of every id), and every plane is
compressed with zstandard. Planes above the widest id of a chunk are left out. Beside
its planes a chunk holds its index: part, chunk, ids of the part before it, number of ids,
and the documents with their numbers of ids. Parts follow each other in ascending doc_id, and
chunks within them, so a reader of any range needs only the index columns to find its rows,
and a chunk is decoded on its own.

Defined cases: a null or empty text is a document of the end id alone; null doc_ids come first;
rows of one doc_id follow the hash of their text; an empty table gives an empty file;
a document longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage, partitions_for
from lexicade.llm.tokens import encoded

BLOCK = 1 << 14
CHUNK = 1 << 18
PART_BYTES = 64 << 20  # of text
SCHEMA = ("part int, chunk int, first long, n_ids long, width int, block int, kind string, "
          "doc_ids array<long>, counts array<long>, planes array<binary>")


def to_planes(ids: np.ndarray, kind: str, width: int) -> list[bytes]:
    """The planes of one block, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(width)]
    bits = np.unpackbits(raw[:, : -(-width // 8)], axis=1, bitorder="little")[:, :width]
    return [row.tobytes() for row in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], kind: str, n: int) -> np.ndarray:
    if kind == "byte":
        raw = np.zeros((n, 4), dtype=np.uint8)
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, dtype=np.uint8)
        return raw.view("<u4").ravel()
    bits = np.zeros((n, 32), dtype=np.uint8)
    for i, p in enumerate(planes):
        bits[:, i] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), bitorder="little", count=n)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def _width(ids: np.ndarray, kind: str) -> int:
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    return bits if kind == "bit" else -(-bits // 8)


def _write(path: str, end: int, kind: str, block: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=1)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        kept: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def row() -> pa.RecordBatch:
            nonlocal number, first
            ids = np.concatenate(kept)
            width = _width(ids, kind)
            planes = [press.compress(p) for a in range(0, len(ids), block)
                      for p in to_planes(ids[a: a + block], kind, width)]
            values = [part, number, first, len(ids), width, block, kind, list(names), list(sizes), planes]
            number, first = number + 1, first + len(ids)
            kept.clear(), names.clear(), sizes.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(),
                     pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            heads = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)], names=heads)

        for batch in batches:
            for a, b, ids, counts in encoded(batch, path, end):
                own = batch.column("doc_id").slice(a, b - a).to_pylist()
                run_ = np.cumsum(counts)
                at = 0
                while at < b - a:  # documents up to the one that completes the chunk
                    begin = run_[at - 1] if at else 0
                    need = chunk - sum(sizes)
                    to = min(int(np.searchsorted(run_, begin + need)) + 1, b - a)
                    kept.append(ids[begin: run_[to - 1]])
                    names += own[at:to]
                    sizes += counts[at:to].tolist()
                    at = to
                    if sum(sizes) >= chunk:
                        yield row()
        if sizes:
            yield row()
    return run


def write(
    docs: DataFrame, stage: Stage, tokenizer: str, end: int = 2, kind: str = "byte",
    block: int = BLOCK, chunk: int = CHUNK, part_bytes: int = PART_BYTES, name: str = "ids",
) -> DataFrame:
    """Encode all texts in ascending doc_id and write them; returns the file as a table."""
    text = F.coalesce("text", F.lit(""))
    parts = partitions_for(docs, F.octet_length(text) + 16, part_bytes)
    rows = docs.select("doc_id", text.alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("*", *[c.alias(f"o{i}") for i, c in enumerate(order[1:])])
    keys = ["doc_id", "o0", "o1"]
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return stage.keep(rows.mapInArrow(_write(tokenizer, end, kind, block, chunk), SCHEMA), name)


def decode(n_ids: int, width: int, block: int, kind: str, planes: list[bytes]) -> np.ndarray:
    """The ids of one chunk."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    out = []
    for i, a in enumerate(range(0, n_ids, block)):
        own = [press.decompress(p) for p in planes[i * width: (i + 1) * width]]
        out.append(from_planes(own, kind, min(block, n_ids - a)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # a chunk at a time
                x = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids = decode(x["n_ids"], x["width"], x["block"], x["kind"], x["planes"])
                counts = np.array(x["counts"], dtype=np.int64)
                edges = np.r_[0, np.cumsum(counts)]
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                columns = [pa.array([x["part"]] * len(counts), pa.int32()),
                           pa.array(x["doc_ids"], pa.int64()), pa.array(x["first"] + edges[:-1]),
                           pa.array(counts), pa.array([zlib.crc32(b) for b in raw], pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def read(file: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32[, ids], from the written table."""
    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = file.mapInArrow(_read(with_ids), schema)
    totals = file.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("n"))
    # one row per part: as many as there were writing tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))
    return out
