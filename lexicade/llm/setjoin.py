"""Pairs of sets of numbers with a Jaccard similarity of at least ``least``, without listing them.

A set's numbers are put in one order, rare ones first; two similar sets share one of the first
``n - ceil(least * n) + 1`` of each, the head. Sizes are cut into classes so that similar sets
lie in the same class or in neighbouring ones. Sets meet per (number of the head, class):
those of the class with each other and with those of the class below. A pair is counted where
it first meets, that is at its first common number, and only after an exact comparison. Sets of
one root are joined already and not compared.
Numbers are ordered by counts in 2**18 slots, whose number does not grow with the corpus;
collisions only change the order, which must be one order and nothing more.

Many small meetings share a task; one whose sets are larger than ``elements`` numbers is dealt
into blocks, and pairs of blocks are tasks of their own. So no task holds an unbounded
group. Pairs are counted where they are found; only the links of a spanning forest per task
leave it. Work grows with the pairs that share a rare number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage
from lexicade.llm.textbytes import U, mix

SLOTS = 1 << 18
ELEMENTS = 1 << 20


def lists_of(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and lengths of a column of lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _slot(s: np.ndarray) -> np.ndarray:
    return (mix(s.astype(U)) % U(SLOTS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        n += np.bincount(_slot(_flat(batch.column("signs"))[0]), minlength=SLOTS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])


def size_bounds(least: float, most: int = 1 << 31) -> list[int]:
    """First sizes of the classes: sets of sizes two classes apart are never similar."""
    out = [1]
    while out[-1] < most:
        out.append(int(out[-1] / least + 1e-9) + 1)
    return out


def _rank(weight: np.ndarray, least: float):
    bounds = np.array(size_bounds(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = _flat(batch.column("signs"))
            of = np.repeat(np.arange(len(n)), n)
            ranked = s[np.lexsort((s, weight[_slot(s)], of))]
            head = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("root"), pa.array(n, pa.int32()), pa.array(head, pa.int32()),
                 pa.array(np.searchsorted(bounds, n, side="right"), pa.int32()), lists_of(ranked, n)],
                names=["node", "root", "n", "head", "size_class", "ranked"])
    return run


def _met(e: int, flat: np.ndarray, sizes: np.ndarray, own: np.ndarray, block: np.ndarray, group: np.ndarray,
         least: float, split: bool):
    """(x, ys) of the similar pairs x < y that have signature ``e`` as their first common one."""
    m = len(sizes)
    begin = np.r_[0, np.cumsum(sizes)]
    place = np.flatnonzero(flat == e) - begin[:-1]
    of = np.repeat(np.arange(m), sizes)
    early = np.arange(len(flat)) - np.repeat(begin[:-1], sizes) < np.repeat(place, sizes)
    ids = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    first = order[early[order]]
    lists = []
    for some in (order, first):
        lists.append((of[some], np.r_[0, np.cumsum(np.bincount(ids[some], minlength=len(flat)))]))

    def common(which: int, mine: np.ndarray) -> np.ndarray:
        posting, edge = lists[which]
        hits = [posting[edge[i]: edge[i + 1]] for i in mine]
        return np.bincount(np.concatenate(hits), minlength=m) if hits else np.zeros(m, np.int64)

    at = np.arange(m)
    for x in range(m - 1):
        mine = ids[begin[x]: begin[x + 1]]
        may = at > x
        may &= np.minimum(sizes, sizes[x]) >= least * np.maximum(sizes, sizes[x]) - 1e-9
        may &= (own | own[x]) & (group != group[x])
        if split:
            may &= block != block[x]
        if not may.any():
            continue
        may &= common(1, mine[: place[x]]) == 0
        if not may.any():
            continue
        shared = common(0, mine)
        may &= shared >= least * (sizes + sizes[x] - shared) - 1e-9
        if may.any():
            yield x, np.flatnonzero(may)


def _compare(least: float):
    """Links per node, and links that join the components of the task: (a, b or null, links)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("e", "ascending"), ("met", "ascending"), ("node", "ascending")])
        e, met = table["e"].to_numpy(), table["met"].to_numpy()
        split = bool(table["i"][0].as_py() != table["j"][0].as_py())
        own, block = (table[c].to_numpy() for c in ("own", "block"))
        keys, node = np.unique(np.array(table["node"].to_pylist(), dtype=object), return_inverse=True)
        group = np.unique(np.array(table["root"].to_pylist(), dtype=object), return_inverse=True)[1]
        flat, sizes = _flat(table["ranked"])
        begin = np.r_[0, np.cumsum(sizes)]
        links = np.zeros(len(keys), dtype=np.int64)
        root = list(range(len(keys)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a_out, b_out = [], []
        edges = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (met[1:] != met[:-1]), True])
        for u, v in zip(edges[:-1], edges[1:]):
            if v - u < 2:
                continue
            met_here = _met(e[u], flat[begin[u]: begin[v]], sizes[u:v], own[u:v] == 1, block[u:v], group[u:v],
                            least, split)
            for x, ys in met_here:
                links[node[u + x]] += len(ys)
                links[node[u + ys]] += 1
                for y in ys:
                    p, q = find(int(node[u + x])), find(int(node[u + y]))
                    if p != q:
                        root[q] = p
                        a_out.append(keys[node[u + x]])
                        b_out.append(keys[node[u + y]])
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array([keys[i] for i in some] + a_out, pa.binary()),
            "b": pa.array([None] * len(some) + b_out, pa.binary()),
            "links": pa.array(links[some].tolist() + [0] * len(a_out), pa.int64())})
    return run


def similar_sets(
    sets: DataFrame, stage: Stage, name: str, least: float = 0.8, elements: int = ELEMENTS,
) -> DataFrame:
    """(a, b, links) from ``sets`` (node, root, signs): a set and how many similar sets of another
    root a task found (b null), or a link (links 0). The links join all that is similar; a set's
    rows of the first kind add up to all its similar sets of other roots.
    """
    kind = sets.schema["signs"].dataType.simpleString()
    weight = np.zeros(SLOTS, dtype=np.int64)
    for r in sets.mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        weight[r.slot] = r.n
    ranked = stage.keep(sets.mapInArrow(
        _rank(weight, least), f"node binary, root binary, n int, head int, size_class int, ranked {kind}"),
        f"{name}-ranked")

    # numbers of heads that another root has in a head too, by class
    heads = ranked.select("node", "root", "n", "size_class", F.explode(F.slice("ranked", 1, F.col("head"))).alias("e"))
    again = heads.groupBy("e").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("e")
    near = stage.keep(heads.join(again, "e"), f"{name}-near")
    near = near.select("e", "node", "root", "n", "size_class", F.explode(
        F.array(F.col("size_class"), F.col("size_class") + 1)).alias("met"))
    near = near.withColumn("own", (F.col("met") == F.col("size_class")).cast("int"))
    groups = stage.keep(
        near.groupBy("e", "met").agg(
            F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("n").alias("total"), F.max("own").alias("own"))
        .where("r0 != r1 and own = 1")
        .select("e", "met", "total", F.ceil(F.col("total") / F.lit(elements)).cast("int").alias("n_blocks")),
        f"{name}-groups")
    whole = groups.select(F.sum("total")).first()[0] or 0
    tasks = max(1, -(-int(whole) // elements))
    hot = F.col("n_blocks") > 1
    rest = (
        near.join(groups.select("e", "met", "n_blocks"), ["e", "met"])
        .withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("e", "met", "node", "root", "own", "block",
                F.when(hot, F.col("e").cast("long")).otherwise(F.pmod(F.xxhash64("e", "met"), F.lit(tasks))).alias("at"),
                F.when(hot, F.col("met")).otherwise(-1).alias("alone"),
                F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(ranked.select("node", "ranked"), "node")
    )
    return stage.keep(rest.groupBy("at", "alone", "i", "j").applyInArrow(
        _compare(least), "a binary, b binary, links long"), f"{name}-found")
