"""SpotSigs: fingerprints from the content words that follow common words.

Words are runs of digits, letters and everything outside ASCII, A-Z lowered. At every common
word (an anchor, a fixed list in four languages) begins a signature: the anchor and the chain
of the next ``chain`` words that are not common. A text's fingerprint is the set of its
signatures, as sorted 32-bit numbers; a text without any has one signature of all its words,
one without words one of its bytes. Two fingerprints compare by Jaccard similarity. ``jaccard``
can leave out pairs whose set sizes alone keep them below a bound; the query sets none, and
compares a text with its edit and its neighbour only: there is no search for similar texts.

Defined cases: a null text is empty; equal texts have equal fingerprints; rows of one doc_id
follow the hash of their text, null doc_ids come first; the document after the last is the
first, so a single document is its own next; an empty table gives no row; other columns
are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicade.llm.stage import partitions_for
from lexicade.llm.textbytes import (
    LOWER, WORD, U, WordHash, blocks, mix, release, sequence_keys, word_spans,
)

# fixed values: common words of English, German, French and Spanish
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or "
    "she that the their there they this to was were which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine er es für im ist mit nach nicht "
    "sich sie sind so um und von vor war wie zu "
    "au aux avec ce ces dans de des du elle en est et il je la le les mais ne ou par pas pour que "
    "qui sa se son sur un une "
    "al como con del el ella ellos es eso está esta este la las lo los más muy no para pero por su "
    "sus también una y ya"
).split()
CHAIN = 3
PART_BYTES = 24 << 20


def _anchor_hashes(hasher: WordHash) -> np.ndarray:
    raw = [w.encode() for w in sorted(set(ANCHORS))]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(hasher(np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, ends[:-1]], ends))


def signatures(texts: pa.Array, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures and their texts, by text and number."""
    hasher = WordHash()
    common = _anchor_hashes(hasher)
    found = []
    for a, b, data, offsets in blocks(texts):
        data = LOWER[data]
        starts, ends, doc = word_spans(data, offsets, WORD)
        h = hasher(data, starts, ends)
        anchor = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        content = np.flatnonzero(~anchor)
        at = np.flatnonzero(anchor)
        first = np.searchsorted(content, at)
        ok = first + chain <= len(content)
        at, first = at[ok], first[ok]
        if len(at):
            ok = doc[content[first + chain - 1]] == doc[at]
            at, first = at[ok], first[ok]
        s = mix(h[at])
        for j in range(chain):
            s = mix(s + h[content[first + j]] * U(2 * j + 3))
        d = doc[at]
        n = b - a
        bare = np.flatnonzero(np.bincount(d, minlength=n) == 0)
        whole = sequence_keys(h, doc, n, 21)
        none = np.bincount(doc, minlength=n) == 0
        for i in bare[none[bare]]:
            raw = (texts[a + int(i)].as_py() or "").encode()
            whole[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")
        d, s = np.r_[d, bare], np.r_[s, whole[bare]]
        both = np.unique((d.astype(U) << U(32)) | (s >> U(32)))
        found.append(both + (U(a) << U(32)))
    both = np.concatenate(found) if found else np.zeros(0, dtype=U)
    return (both & U(0xFFFFFFFF)).astype(np.uint32), (both >> U(32)).astype(np.int64)


def jaccard(x, x_of, y, y_of, n: int, least: float = 0.0) -> np.ndarray:
    """Similarity of the i-th set of x and of y; 0 where the sizes alone keep it below ``least``."""
    a, b = np.bincount(x_of, minlength=n), np.bincount(y_of, minlength=n)
    may = np.minimum(a, b) >= least * np.maximum(a, b)
    left, right = may[x_of], may[y_of]
    both = np.concatenate([(x_of[left].astype(U) << U(32)) | x[left], (y_of[right].astype(U) << U(32)) | y[right]])
    both.sort()
    same = both[1:][both[1:] == both[:-1]] >> U(32)
    common = np.bincount(same.astype(np.int64), minlength=n)
    return np.where(may, common / np.maximum(a + b - common, 1), 0.0)


def _strings(s: np.ndarray, of: np.ndarray, n: int) -> list[str]:
    raw = s.astype("<u4").tobytes()
    edges = (np.searchsorted(of, np.arange(n + 1)) * 4).tolist()
    return [base64.b64encode(raw[a:b]).decode() for a, b in zip(edges[:-1], edges[1:])]


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which only follows."""
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
    own, own_of = signatures(pa.array(texts, pa.large_string()))
    new, new_of = signatures(pa.array(changed, pa.large_string()))
    names = _strings(own, own_of, n + 1)
    first, after = own_of < n, own_of > 0
    own_n, own_n_of = own[first], own_of[first]
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        pa.array(names[:n], pa.string()), pa.array(_strings(new, new_of, n), pa.string()),
        pa.array(jaccard(own_n, own_n_of, new, new_of, n), pa.float64()),
        pa.array(jaccard(own_n, own_n_of, own[after], own_of[after] - 1, n), pa.float64())],
        names=[c.split()[0] for c in OUT.split(", ")])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a sorted part but its last."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > 1 << 21 and len(texts) > 1:
                yield _compared(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield _compared(ids, texts)
    release()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first text and the last row of a sorted part."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column("text")[0].as_py() if first is None else first
            last = (batch.column("doc_id")[-1].as_py(), batch.column("text")[-1].as_py())
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.string()),
             pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.string())],
            names=["part", "first", "doc_id", "text"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            yield _compared([i, None], [t, f])


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness.

    The texts move once, into parts in order of doc_id. The pairs that lie across two parts
    (two texts of every part) are compared apart.
    """
    text = F.coalesce("text", F.lit(""))
    parts = partitions_for(docs, F.octet_length(text) + 16, part_bytes)
    keys = ["doc_id", "o0", "o1"]
    rows = docs.select("doc_id", text.alias("text")).select(
        "*", F.xxhash64("text").alias("o0"), F.monotonically_increasing_id().alias("o1"))
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    inner = rows.mapInArrow(_run, OUT)
    edge = rows.mapInArrow(_edges, "part int, first string, doc_id long, text string")
    return inner.union(_across(edge).mapInArrow(_pairs, OUT))


def _across(edge: DataFrame) -> DataFrame:
    """(doc_id, text, following): the last row of every part with the first text of the next.

    A part's last row and the next part's first text meet in one slot. The very last row, and
    rows before an empty part, find none there; only those are put in one window.
    """
    none = F.lit(None)
    ends = F.array(
        F.struct(F.col("part").alias("slot"), F.lit(True).alias("last"), "doc_id", "text",
                 none.cast("string").alias("following")),
        F.struct((F.col("part") - 1).alias("slot"), F.lit(False).alias("last"), none.cast("long").alias("doc_id"),
                 none.cast("string").alias("text"), F.col("first").alias("following")))
    slots = edge.select(F.explode(ends).alias("x")).select("x.*").groupBy("slot").agg(
        *[F.max(c).alias(c) for c in ("last", "doc_id", "text", "following")])
    met = F.when(F.col("last") & F.col("following").isNotNull(), F.col("slot"))
    around = Window.partitionBy(met).orderBy("slot")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce("following", F.lead("following").over(around),
                           F.first("following", ignorenulls=True).over(whole))
    return slots.select("doc_id", "text", "last", following.alias("following")).where("last")
