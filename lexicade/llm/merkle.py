"""Merkle manifest of a table by time-forward processing, with a proof for every row.

A row is a leaf. Per group (``lang``) the leaves ascend by id and every run of ``arity``
nodes becomes a node until one is left, the subroot; the subroots, in order of their groups,
become the root in the same way.

Nodes are labelled by the time at which all they need is known: (last leaf below, level). The
forward pass meets the leaves in order, sends every digest to its parent's label through a
priority queue, and makes the nodes that are due. The queue is external: inside a block of
``arity ** LEVELS`` leaves it never holds more than arity messages a level, across blocks the messages
are rows that Spark's sorted shuffle delivers to the next round, where the blocks' tops are
the leaves. The reversed sweep goes through the same labels downwards: a node takes the proof
suffix that waits at its label and sends each child that suffix behind the child's siblings. A
proof is never stored for a leaf, only taken up into its digests.

Leaves are numbered by ranges of (group, id) with a bounded number of rows, so no group is
ever in one task; a block is at most 4,096 leaves.

Defined cases: a null column enters a leaf as ``-``; the null group comes first; null ids come first in their
group, rows of one id follow their digests, equal rows each have a place; a null id is not tampered with;
a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicade.llm.sql import CRC_TABLE, UPPER, crc32_sql
from lexicade.llm.stage import Stage

ARITY = 8
LEVELS = 4
PER_PART = 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "g string, n long, block long, level int, idx long, last long, digest string, children array<string>"
LEAVES = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
PATHS = "g string, idx long, path array<string>"
BATCH = 2000


def _leaf_sql(text: str) -> str:
    """The leaf digest in SQL, with ``text`` in place of the column."""
    values = [text if c == "text" else f"{c}::VARCHAR" for c in COLUMNS]
    parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(octet_length(encode({v})), ':', {v}) END" for v in values]
    return f"sha256(concat({', '.join(parts)}))"


# all levels from the leaves up, then the proofs from the roots down; the second tree in the same way
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0
      THEN {_leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS changed
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (SELECT lang, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL SELECT lang, level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx))
    FROM up WHERE n > 1 GROUP BY lang, level, idx // {ARITY}, n),
subroots AS (SELECT lang, level, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx,
    count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL SELECT level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx))
    FROM up2 WHERE n > 1 GROUP BY level, idx // {ARITY}, n),
beside AS (SELECT a.lang, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM up a JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.idx // {ARITY} = b.idx // {ARITY}
  WHERE a.n > 1 GROUP BY ALL),
beside2 AS (SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM up2 a JOIN up2 b ON a.level = b.level AND a.idx // {ARITY} = b.idx // {ARITY} WHERE a.n > 1 GROUP BY ALL),
walk AS (SELECT doc_id, lang, idx AS start, 0 AS level, idx, '' AS proof, coalesce(changed, leaf) AS folded FROM placed
  UNION ALL SELECT w.doc_id, w.lang, w.start, w.level + 1, w.idx // {ARITY}, proof || l || r, sha256(l || folded || r)
    FROM walk w JOIN beside b ON w.lang IS NOT DISTINCT FROM b.lang AND w.level = b.level AND w.idx = b.idx),
walk2 AS (SELECT w.doc_id, w.lang, w.start, 0 AS level, s.idx, proof, folded
    FROM walk w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang AND w.level = s.level
  UNION ALL SELECT w.doc_id, w.lang, w.start, w.level + 1, w.idx // {ARITY}, proof || l || r, sha256(l || folded || r)
    FROM walk2 w JOIN beside2 b ON w.level = b.level AND w.idx = b.idx),
top AS (SELECT digest AS root, level FROM up2 WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = root AS verified
FROM walk2 w JOIN top ON w.level = top.level
  JOIN placed p ON p.lang IS NOT DISTINCT FROM w.lang AND p.idx = w.start
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang"""


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """H of the columns, each with its length, a null as ``-``; ``columns`` replaces some."""
    def part(name: str) -> Column:
        value = (columns or {}).get(name, F.col(f"`{name}`")).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in COLUMNS]).cast("binary"), 256)


def lower_latin(text: Column) -> Column:
    """A-Z lower-cased; the quick way where that is all there is to lower."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def tampered_digest(leaf: Column) -> Column:
    """The leaf where the text of every third id (by its checksum) is lower-cased."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf_digest({"text": lower_latin(F.col("text"))})).otherwise(leaf)


def group_key(column: str) -> Column:
    """A key that orders as the column does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.col(column)), F.lit("0"))


@dataclass(frozen=True)
class Shape:
    """Runs of ``arity``, blocks of ``arity ** levels``."""

    arity: int = ARITY
    levels: int = LEVELS

    @property
    def span(self) -> int:
        return self.arity**self.levels

    def top(self, n: int) -> int:
        """Level of a block's highest node, in a group of n leaves."""
        level = 0
        while n > 1 and level < self.levels:
            n, level = -(-n // self.arity), level + 1
        return level

    def last(self, n: int, level: int, idx: int) -> int:
        """The last leaf below a node."""
        return min(n, (idx + 1) * self.arity**level) - 1


def ranked(rows: DataFrame, stage: Stage, name: str, order: list[str], per_part: int) -> DataFrame:
    """Add idx, the place within ``g`` in the given order from 0, and n, the size of ``g``."""
    parts = max(1, -(-rows.count() // per_part))
    dealt = stage.keep(rows.repartitionByRange(parts, "g", *order).withColumn(
        "part", F.spark_partition_id()), f"{name}-ranges")
    sizes = dealt.groupBy("g", "part").agg(F.count("*").alias("m"))
    # a group has at most as many rows here as there are ranges
    by = Window.partitionBy("g")
    before = F.sum("m").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("g", "part", F.coalesce(before, F.lit(0)).alias("first"), F.sum("m").over(by).alias("n"))
    nth = F.row_number().over(Window.partitionBy("part", "g").orderBy(*order))
    placed = dealt.withColumn("nth", nth).join(starts, ["part", "g"])
    return stage.keep(placed.withColumn("idx", F.col("first") + F.col("nth") - 1).drop("part", "first", "nth"), name)


def _by_block(rows: DataFrame, span: int, parts: int, *order: str | Column) -> DataFrame:
    return rows.repartition(parts, "g", "block").sortWithinPartitions("g", "block", *order)


class _Rows:
    """Rows collected into record batches."""

    def __init__(self, schema: str, types: list[pa.DataType]) -> None:
        self.names, self.types = [c.split()[0] for c in schema.split(", ")], types
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], names=self.names)


def _forward(shape: Shape):
    """Nodes above the leaves of whole blocks, which come in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(NODES, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(),
                            pa.list_(pa.string())])
        queue: list[tuple[int, int, int, str]] = []
        tops: dict[int, int] = {}

        def send(n: int, level: int, idx: int, digest: str) -> None:
            if n not in tops:
                tops.clear()
                tops[n] = shape.top(n)
            if level < tops[n]:
                label = shape.last(n, level + 1, idx // shape.arity)
                heapq.heappush(queue, (label, level + 1, idx, digest))

        for batch in batches:
            for g, n, block, now, leaf in zip(*[batch.column(c).to_pylist() for c in ("g", "n", "block", "idx", "digest")]):
                send(n, 0, now, leaf)
                while queue and queue[0][0] <= now:
                    last, level, idx, first = heapq.heappop(queue)
                    children = [first]
                    while queue and queue[0][:2] == (last, level):
                        children.append(heapq.heappop(queue)[3])
                    digest = digest_of("".join(children))
                    out.rows.append((g, n, block, level, idx // shape.arity, last, digest, children))
                    send(n, level, idx // shape.arity, digest)
                if len(out.rows) >= BATCH:
                    yield out.batch()
        yield out.batch()
    return run


def _backward(shape: Shape, paths: bool):
    """Proofs of the leaves of whole blocks; tops, nodes and leaves come from the last label down."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = (_Rows(PATHS, [pa.string(), pa.int64(), pa.list_(pa.string())]) if paths
               else _Rows(LEAVES, [pa.int64()] + [pa.string()] * 4))
        queue: list[tuple[int, int, int, list[str]]] = []
        subroot = None
        for batch in batches:
            names = ("g", "kind", "n", "level", "idx", "last", "children", "path", "subroot", "doc_id", "leaf", "tampered")
            for g, kind, n, level, idx, last, children, path, top, doc_id, leaf, tampered in zip(
                    *[batch.column(c).to_pylist() for c in names]):
                if kind == 0:  # what waits for the highest node of the block
                    subroot = top
                    heapq.heappush(queue, (-last, -level, idx, path))
                    continue
                path = heapq.heappop(queue)[3]
                if level > 0:
                    for i, _ in enumerate(children):
                        child = idx * shape.arity + i
                        beside = ["".join(children[:i]), "".join(children[i + 1:])]
                        heapq.heappush(queue, (-shape.last(n, level - 1, child), 1 - level, child, beside + path))
                elif paths:
                    out.rows.append((g, idx, path))
                else:
                    folded = tampered
                    for left, right in zip(path[::2], path[1::2]):
                        folded = digest_of(left + folded + right)
                    out.rows.append((doc_id, leaf, subroot, digest_of("".join(path)), folded))
                if len(out.rows) >= BATCH:
                    yield out.batch()
        yield out.batch()
    return run


@dataclass
class Forest:
    """Per round: the leaves (g, n, idx, digest) and the nodes above them; then (g, digest) of every group's root."""

    rounds: list[tuple[DataFrame, DataFrame]]
    roots: DataFrame


def grow(leaves: DataFrame, stage: Stage, name: str, shape: Shape, per_part: int) -> Forest:
    """All trees over stored leaves (g, n, idx, digest)."""
    rounds, roots, here = [], [], leaves
    while True:
        rows = here.select("g", "n", "idx", "digest", F.floor(F.col("idx") / shape.span).alias("block"))
        parts = max(1, -(-here.count() // per_part))
        nodes = stage.keep(_by_block(rows, shape.span, parts, "idx").mapInArrow(_forward(shape), NODES),
                           f"{name}-nodes-{len(rounds)}")
        rounds.append((here, nodes))
        alone = F.col("n") <= F.pow(F.lit(float(shape.arity)), F.col("level"))
        roots.append(nodes.where(alone).select("g", "digest"))
        if not rounds[1:]:
            roots.append(here.where("n = 1").select("g", "digest"))
        above = nodes.where((F.col("level") == shape.levels) & ~alone).select(
            "g", F.ceil(F.col("n") / shape.span).alias("n"), "idx", "digest")
        if above.isEmpty():
            break
        here = stage.keep(above, f"{name}-tops-{len(rounds)}")
    found = roots[0]
    for more in roots[1:]:
        found = found.union(more)
    return Forest(rounds, stage.keep(found, f"{name}-roots"))


def sweep(forest: Forest, tops: DataFrame, stage: Stage, name: str, shape: Shape, per_part: int,
          paths: bool) -> DataFrame:
    """Proofs down all trees from ``tops`` (g, path, subroot), what lies behind each group's root.

    With ``paths`` the result is (g, idx, path), else the rows of ``LEAVES``; the
    leaves of the first round then carry doc_id, leaf and tampered.
    """
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (
        ("children", "array<string>"), ("path", "array<string>"), ("subroot", "string"), ("doc_id", "long"),
        ("leaf", "string"), ("tampered", "string"))]
    fields = ("g", "block", "kind", "n", "level", "idx", "last", "children", "path", "subroot", "doc_id", "leaf", "tampered")
    behind = None
    for k in reversed(range(len(forest.rounds))):
        leaves, nodes = forest.rounds[k]
        final = k == 0 and not paths
        size, block = F.lit(shape.span), F.floor(F.col("idx") / shape.span)
        level = F.lit(0)
        for i in range(shape.levels):
            level = F.when(F.col("n") > shape.arity**i, i + 1).otherwise(level)
        heads = leaves.withColumn("block", block).groupBy("g", "block", "n").agg(F.max("idx").alias("last"))
        # groups that end in this round get their suffix from the caller, the others from the round above
        ends = heads.where(F.col("n") <= shape.span).join(tops, "g")
        wait = ends if behind is None else ends.unionByName(
            heads.where(F.col("n") > shape.span).join(
                behind.withColumnRenamed("idx", "block"), ["g", "block"]).join(tops.select("g", "subroot"), "g"))
        rows = wait.select(
            "g", "block", F.lit(0).alias("kind"), "n", level.alias("level"),
            F.floor(F.col("last") / F.pow(F.lit(float(shape.arity)), level)).alias("idx"), "last",
            nothing[0], "path", "subroot", *nothing[3:])
        rows = rows.union(nodes.select(
            "g", "block", F.lit(1), "n", "level", "idx", "last", "children", *nothing[1:]))
        own = ["doc_id", "leaf", "tampered"] if final else nothing[3:]
        rows = rows.union(leaves.select(
            "g", block, F.lit(1), "n", F.lit(0), "idx", "idx", *nothing[:3], *own))
        parts = max(1, -(-leaves.count() // per_part))
        sorted_rows = _by_block(rows.select(*fields), size, parts, "kind", F.desc("last"), F.desc("level"))
        behind = sorted_rows.mapInArrow(_backward(shape, not final), LEAVES if final else PATHS)
        behind = stage.keep(behind, f"{name}-sweep-{k}")
    return behind


def manifest(docs: DataFrame, stage: Stage, shape: Shape = Shape(), per_part: int = PER_PART) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    leaf = leaf_digest()
    digests = stage.keep(docs.select(
        "doc_id", group_key("lang").alias("g"), leaf.alias("leaf"), tampered_digest(leaf).alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    leaves = ranked(digests, stage, "ranked", ["doc_id", "leaf", "row"], per_part).withColumn("digest", F.col("leaf"))
    trees = grow(leaves, stage, "trees", shape, per_part)
    groups = trees.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    subroots = ranked(groups, stage, "subroots", ["name"], per_part)
    above = grow(subroots, stage, "above", shape, per_part)
    first = above.roots.first()
    start = above.roots.select("g", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"))
    paths = sweep(above, start, stage, "above", shape, per_part, paths=True)
    tops = stage.keep(subroots.select("idx", F.col("name").alias("g"), F.col("digest").alias("subroot")).join(
        paths.select("idx", "path"), "idx").drop("idx"), "tops")
    proofs = sweep(trees, tops, stage, "trees", shape, per_part, paths=False)
    root = F.lit(first.digest if first else None)
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"))
