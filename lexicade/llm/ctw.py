"""Code lengths of texts under a byte model by context-tree weighting.

A text is modelled as its tokens (runs without white space; A-Z lowered), a space between two
and a line feed after the last. What is learnt is, for every byte, the ``depth`` bytes before
it; the tree over them (see ``ctw_tree``) mixes Krichevsky-Trofimov estimates of all context
lengths from 0 to ``depth``.

Texts are dealt to chunks of about ``chunk_bytes``. A chunk lists its distinct (context, byte)
rows and distinct tokens with their counts in training texts, packed by shard: contexts by a
hash of their three nearest bytes, tokens by their own. A shard sums the counts of all chunks
and answers each chunk for its own rows. The nodes of two bytes are summed over the shards by
Spark, and each shard gets those of its own contexts; the levels below, which all shards share,
are one small table (at most 1 + 256 contexts of 255 nodes). A chunk's task holds its texts and
its own rows, a shard's task its share of the rows, and the shards grow in number with the
chunks; but the rows that agree in three nearest bytes are in one shard, and texts that
repeat under one doc_id in one chunk, however many they are.

Defined cases: a null or empty text is the line feed alone, one token; rows that repeat are
scored alike and learnt from as often as they occur; a null doc_id counts as the text "null";
without training texts every bit has probability one half; an empty table gives no row;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicade.llm.ctw_tree import HALF, block_weights, log_kt, log_probability, path
from lexicade.llm.stage import Stage, partitions_for
from lexicade.llm.textbytes import DARK, LOWER, U, WordHash, mix, release, text_bytes, word_spans

DEPTH = 6
CHUNK_BYTES = 16 << 20
MOST_SHARDS = 16_384
TOP = 3  # shards are dealt by so many nearest bytes; their trees begin there
_SLICE = 1 << 22


def sequence(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the modelled sequences, where each begins and the last ends, tokens per text)."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets, DARK)
    # every token takes one byte more: a space, or the text's closing line feed
    size = ends - starts + 1
    count = np.bincount(doc, minlength=n)
    total = np.bincount(doc, weights=size, minlength=n).astype(np.int64) + (count == 0)
    begin = np.r_[0, np.cumsum(total)]
    out = np.full(begin[-1], 32, dtype=np.uint8)
    out[begin[1:] - 1] = 10
    # the bytes of tokens, in order, go to all places but those behind tokens
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    here = np.ones(len(out), dtype=bool)
    here[begin[1:] - 1] = False
    empty_before = np.cumsum(count == 0)[doc]
    here[np.cumsum(size) - 1 + empty_before] = False
    out[here] = data[inside]
    return out, begin, count + 1


def tokens(out: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All tokens, each with a space behind it, and the places behind them; a text without has a space."""
    ends = np.flatnonzero((out == 32) | (out == 10)) + 1
    flat = np.where(out == 10, np.uint8(32), out)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(flat)]), ends


def text_of(begin: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(begin, places, side="right") - 1


def keys(out: np.ndarray, begin: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their texts) slice by slice: contexts nearest byte first, then the byte."""
    for a in range(0, len(out), _SLICE):
        b = min(a + _SLICE, len(out))
        first, last = text_of(begin, np.array([a, b - 1]))
        edges = np.clip(begin[first: last + 2], a, b)
        text = np.repeat(np.arange(first, last + 1), np.diff(edges))
        low = max(0, a - depth)
        window = np.concatenate([np.full(depth - (a - low), 10, dtype=np.uint8), out[low:b]])
        # before a text's first byte the context is line feeds
        heads = (begin[first: last + 1, None] + np.arange(depth)).ravel()
        since = np.tile(np.arange(depth), last + 1 - first)
        ok = (heads >= a) & (heads < b) & (heads < np.repeat(begin[first + 1: last + 2], depth))
        heads, since = heads[ok] - a, since[ok]
        key = out[a:b].astype(U)
        for d in range(1, depth + 1):
            near = window[depth - d: depth - d + b - a].astype(U)
            near[heads[since < d]] = 10
            key |= near << U(8 * (depth - d + 1))
        yield key, text


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[first], (np.add.reduceat(n, first) if len(first) else n)


def context_rows(out, begin, train, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of some texts and how often they occur in training texts."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for key, text in keys(out, begin, depth):
        learnt = train[text]
        k, n = np.unique(key[learnt], return_counts=True)
        o = np.unique(key[~learnt])
        parts += [(k, n.astype(np.int64)), (o, np.zeros(len(o), dtype=np.int64))]
        if len(parts) > 16:
            parts = [_merged(parts)]
    return _merged(parts) if parts else (np.zeros(0, U), np.zeros(0, np.int64))


def token_counts(out, begin, train) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens but the closing one, sorted, and their counts in training texts."""
    words, ends = tokens(out)
    words = words.dictionary_encode()
    text = text_of(begin, ends - 1)
    code = words.indices.to_numpy()
    n = np.bincount(code[train[text]], minlength=len(words.dictionary))
    names = words.dictionary
    real = np.asarray(pc.binary_length(names)) > 1  # a text without tokens gives an empty one
    names, n = names.filter(pa.array(real)), n[real]
    order = pc.sort_indices(names).to_numpy()
    return names.take(pa.array(order)), n[order]


def _press(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(x)


def _unpress(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _numbers(x: np.ndarray) -> bytes:
    """Ascending whole numbers: their steps, byte by byte, pressed."""
    steps = np.diff(x.astype(np.int64), prepend=np.int64(0)).astype("<i8")
    return _press(_by_byte(steps))


def _from_numbers(x: bytes) -> np.ndarray:
    return np.cumsum(_from_plain(x, "<i8"))


def _plain(x: np.ndarray, kind: str) -> bytes:
    return _press(_by_byte(x.astype(kind)))


def _by_byte(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_plain(x: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(_unpress(x), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _shard_of(context: np.ndarray, depth: int, shards: int) -> np.ndarray:
    near = context >> U(8 * (depth - TOP) + 8)  # the nearest bytes
    return (mix(near + U(1)) % U(shards)).astype(np.int64)


def _collect(depth: int, shards: int):
    """A chunk's rows and tokens, packed by shard."""
    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        train = ~np.asarray(table["held_out"].to_numpy(zero_copy_only=False), dtype=bool)
        out, begin, _ = sequence(table["text"])
        rows = []
        key, n = context_rows(out, begin, train, depth)
        shard = _shard_of(key, depth, shards)
        for s in np.unique(shard).tolist():
            mine = shard == s
            rows.append(("context", s, int(mine.sum()), _numbers(key[mine]), _plain(n[mine], "<i8")))
        names, n = token_counts(out, begin, train)
        shard = (mix(_token_hash(names)) % U(shards)).astype(np.int64) if len(names) else np.zeros(0, int)
        for s in np.unique(shard).tolist():
            mine = shard == s
            own = names.filter(pa.array(mine))
            rows.append(("token", s, len(own), _press(b"".join(own.to_pylist())), _plain(n[mine], "<i8")))
        closing = int(train.sum())
        rows.append(("closing", 0, closing, b"", b""))
        kind, s, m, key, n = (list(x) for x in zip(*rows))
        release()
        return pa.table({
            "kind": pa.array(kind), "shard": pa.array(s, pa.int32()),
            "chunk": pa.array([chunk] * len(rows), pa.int32()), "m": pa.array(m, pa.int64()),
            "keys": pa.array(key, pa.binary()), "counts": pa.array(n, pa.binary())})
    return run


def _token_hash(names: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset: names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], dtype=np.uint8)[offsets[0]: offsets[-1]]
    return WordHash()(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _shard_rows(table: pa.Table):
    """All chunks' rows of a shard: distinct keys, their summed counts, and each chunk's own keys."""
    own = [_from_numbers(k).astype(U) for k in table["keys"].to_pylist()]
    counts = [_from_plain(c, "<i8") for c in table["counts"].to_pylist()]
    key, n = _merged(list(zip(own, counts)))
    return key, n, own


def _levels(depth: int):
    """Per shard: the nodes of two bytes, with the sums of the shard's own nodes of three below them."""
    def run(table: pa.Table) -> pa.Table:
        key, n, _ = _shard_rows(table)
        levels, logs = block_weights(key, n, depth, TOP)
        pair = key >> U(8 * (depth - TOP + 1) + 8)
        rows = []
        for step in range(8):
            node, _, a, b = levels[TOP].steps[step]
            first = np.unique(node, return_index=True)[1]
            # nodes that training has not seen stay, as they ask for the one above
            above, at = np.unique((pair[first] << U(8)) | ((key[first] & U(255)) >> U(8 - step)), return_inverse=True)
            rows.append((np.full(len(above), step), above >> U(8), above & U(255),
                         *[np.bincount(at, weights=x, minlength=len(above)) for x in (a, b, logs[TOP][step])]))
        step, context, prefix, a, b, log = (np.concatenate(x) for x in zip(*rows))
        return pa.table({
            "shard": pa.array(np.full(len(step), table["shard"][0].as_py(), dtype=np.int32)),
            "step": pa.array(step.astype(np.int32)), "context": pa.array(context.astype(np.int32)),
            "prefix": pa.array(prefix.astype(np.int32)), "a": a, "b": b, "log": log})
    return run


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the sums of those below: their weighted probability, P(one) and weight of staying."""
    for batch in batches:
        a, b, below = (batch.column(c).to_numpy() for c in ("a", "b", "log"))
        kt = log_kt(a, b)
        log = np.logaddexp(HALF + kt, HALF + below)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("step", "context", "prefix", "a", "b")],
             *map(pa.array, (log, (b + 0.5) / (a + b + 1), np.exp(HALF + kt - log)))],
            names=["step", "context", "prefix", "a", "b", "log", "q", "stay"])


def _top(nodes: DataFrame) -> dict[tuple[int, int, int, int], tuple[float, float]]:
    """{(context length, step, context, prefix): (P(one), weight of staying)} for lengths 0 and 1.

    At most 255 + 256 * 255 nodes, summed by Spark from those of length two.
    """
    near = F.shiftright("context", 8)  # the nearest byte
    one = nodes.groupBy("step", near.alias("context"), "prefix").agg(
        *[F.sum(c).alias(c) for c in ("a", "b", "log")]).toPandas()
    found = {}
    one = one.sort_values(["step", "context", "prefix"])
    for d in (1, 0):
        a, b = one["a"].to_numpy(float), one["b"].to_numpy(float)
        kt = log_kt(a, b)
        log = np.logaddexp(HALF + kt, HALF + one["log"].to_numpy(float))
        for s, c, p, q, stay in zip(one["step"], one["context"], one["prefix"],
                                    (b + 0.5) / (a + b + 1), np.exp(HALF + kt - log)):
            found[d, int(s), int(c), int(p)] = (float(q), float(stay))
        one = one.assign(log=log, context=0).groupby(["step", "context", "prefix"], as_index=False)[
            ["a", "b", "log"]].sum()
    return found


def _answer_contexts(depth: int, top: dict):
    """Per shard, for every chunk: log10 P(byte) of its own rows, in their order."""
    def run(table: pa.Table, pairs: pa.Table) -> pa.Table:
        key, n, own = _shard_rows(table)
        levels, logs = block_weights(key, n, depth, TOP)
        of_step, context, prefix, q2, stay2 = (
            pairs[c].to_numpy() for c in ("step", "context", "prefix", "q", "stay"))
        name2 = (context.astype(U) << U(8)) | prefix.astype(U)
        steps = path(levels, logs, depth, TOP)
        mixed = []
        for step, (bit, p) in enumerate(steps):
            prefix = (key & U(255)) >> U(8 - step)
            here = np.flatnonzero(of_step == step)
            here = here[np.argsort(name2[here])]
            if len(here):
                node = ((key >> U(8 * (depth - 2) + 8)) << U(8)) | prefix
                at = here[np.minimum(np.searchsorted(name2[here], node), len(here) - 1)]
                known = name2[at] == node
                mixed2 = np.where(np.isnan(p), q2[at], stay2[at] * q2[at] + (1 - stay2[at]) * p)
                p = np.where(known, mixed2, p)
            for d in (1, 0):
                context = key >> U(8 * (depth - d) + 8)
                node, at = np.unique((context << U(8)) | prefix, return_inverse=True)
                known = [top.get((d, step, int(x) >> 8, int(x) & 255)) for x in node]
                q = np.array([k[0] if k else np.nan for k in known])[at]
                stay = np.array([k[1] if k else 0.0 for k in known])[at]
                p = np.where(np.isnan(p), q, stay * q + (1 - stay) * p)
            mixed.append((bit, p))
        value = log_probability(mixed)
        answers = [_plain(value[np.searchsorted(key, o)], "<f4") for o in own]
        return _answered(table, answers)
    return run


def _answer_tokens(table: pa.Table) -> pa.Table:
    """Per shard, for every chunk: the training counts of its own tokens; and the shard's totals."""
    own = [_split_tokens(k) for k in table["keys"].to_pylist()]
    counts = [_from_plain(c, "<i8") for c in table["counts"].to_pylist()]
    words = pa.concat_arrays(own).dictionary_encode()
    code = words.indices.to_numpy()
    total = np.bincount(code, weights=np.concatenate(counts), minlength=len(words.dictionary)).astype(np.int64)
    edges = np.r_[0, np.cumsum([len(o) for o in own])]
    answers = [_plain(total[code[a:b]], "<i8") for a, b in zip(edges[:-1], edges[1:])]
    out = _answered(table, answers)
    here = np.zeros(len(out), dtype=np.int64)
    n, v = here.copy(), here.copy()
    n[:1], v[:1] = total.sum(), (total > 0).sum()
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(n)).set_column(
        out.schema.get_field_index("v"), "v", pa.array(v))


def _split_tokens(packed: bytes) -> pa.Array:
    data = np.frombuffer(_unpress(packed), dtype=np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)])


_ANSWER = "kind string, shard int, chunk int, keys binary, answers binary, n long, v long"


def _answered(table: pa.Table, answers: list[bytes]) -> pa.Table:
    zero = pa.array(np.zeros(len(table), dtype=np.int64))
    return pa.table({"kind": table["kind"], "shard": table["shard"], "chunk": table["chunk"],
                     "keys": table["keys"], "answers": pa.array(answers, pa.binary()), "n": zero, "v": zero})


class _Lookup:
    """Values by 64-bit key, in an open table of arrays."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(2 * len(key) + 1))))
        self.key = np.full(1 << self.bits, ~U(0), dtype=U)
        self.value = np.zeros(1 << self.bits, dtype=value.dtype)
        at = self._at(key)
        left = np.arange(len(key))
        while len(left):
            free = self.key[at] == ~U(0)
            slot, who = at[free], left[free]
            self.key[slot] = key[who]  # of several, the last one stays
            won = self.key[slot] == key[who]
            self.value[slot[won]] = value[who[won]]
            done = np.zeros(len(left), dtype=bool)
            done[np.flatnonzero(free)[won]] = True
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self._at(key)
        out = self.value[at]
        miss = np.flatnonzero(self.key[at] != key)
        while len(miss):
            nxt = (at[miss] + 1) & ((1 << self.bits) - 1)
            at[miss] = nxt
            out[miss] = self.value[nxt]
            miss = miss[self.key[nxt] != key[miss]]
        return out


def _score(depth: int, n_train: int, v_train: int, closing: int):
    """A chunk's texts with the shards' answers for it."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _scored([], [], [], [], [], [], n_train)
        key, value, names, counts = [], [], [], []
        for kind, k, a in zip(answers["kind"].to_pylist(), answers["keys"].to_pylist(),
                              answers["answers"].to_pylist()):
            if kind == "context":
                key.append(_from_numbers(k).astype(U))
                value.append(_from_plain(a, "<f4").astype(np.float64))
            else:
                names.append(_split_tokens(k))
                counts.append(_from_plain(a, "<i8"))
        out, begin, n = sequence(texts["text"])
        find = _Lookup(np.concatenate(key), np.concatenate(value))
        score = np.zeros(len(n))
        for rows, text in keys(out, begin, depth):
            score += np.bincount(text, weights=find(rows), minlength=len(n))
        c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        words, ends = tokens(out)
        words = words.dictionary_encode()
        real = np.asarray(pc.binary_length(words.dictionary)) > 1
        place = pc.index_in(words.dictionary, pa.concat_arrays(names)) if names else None
        of_word = np.zeros(len(words.dictionary), dtype=np.int64)
        if place is not None:
            of_word[real] = c[place.filter(pa.array(real)).to_numpy()]
        log = lambda x: np.log10((x + 0.5) / (n_train + 0.5 * (v_train + 1)))
        code = words.indices.to_numpy()
        text = text_of(begin, ends - 1)
        here = real[code]
        known = np.bincount(text, weights=(of_word[code] > 0) & here, minlength=len(n)) + (closing > 0)
        base = np.bincount(text, weights=np.where(here, log(of_word)[code], 0.0), minlength=len(n)) + log(closing)
        release()
        return _scored(texts["doc_id"], texts["held_out"], n, known.astype(np.int64), base, score, n_train, begin)
    return run


OUT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
       "base_score double, score double, n_bytes long, bits_per_byte double")


def _scored(ids, held, n, known, base, score, n_train, begin=None) -> pa.Table:
    size = np.diff(begin) if begin is not None else np.zeros(0, dtype=np.int64)
    score = np.asarray(score, dtype=float)
    return pa.table({
        "doc_id": ids if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64()),
        "held_out": held if isinstance(held, pa.ChunkedArray) else pa.array(held, pa.bool_()),
        "n_tokens": pa.array(np.asarray(n, dtype=np.int64)), "n_known": pa.array(np.asarray(known, dtype=np.int64)),
        "train_tokens": pa.array(np.full(len(score), n_train, dtype=np.int64)),
        "base_score": pa.array(np.asarray(base, dtype=float)), "score": pa.array(score),
        "n_bytes": pa.array(size.astype(np.int64)),
        "bits_per_byte": pa.array(-score / np.log10(2) / np.maximum(size, 1))})


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(5)) == 1


def score(docs: DataFrame, stage: Stage, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every text's log10 probability under the model, and under the token counts (base_score)."""
    text = F.coalesce("text", F.lit(""))
    chunks = partitions_for(docs, F.octet_length(text) + 1, chunk_bytes)
    shards = min(max(16, chunks), MOST_SHARDS)
    rows = docs.select(
        "doc_id", held_out().alias("held_out"), text.alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    packed = stage.keep(rows.groupBy("chunk").applyInArrow(
        _collect(depth, shards), "kind string, shard int, chunk int, m long, keys binary, counts binary"), "packed")
    context = packed.where("kind = 'context'").repartition(shards, "shard")
    nodes = stage.keep(context.groupBy("shard").applyInArrow(
        _levels(depth), "shard int, step int, context int, prefix int, a double, b double, log double"), "nodes")
    name = ["step", "context", "prefix"]
    pairs = stage.keep(
        nodes.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("a", "b", "log")]).where("a + b > 0").mapInArrow(
            _weighted, "step int, context int, prefix int, a double, b double, log double, q double, stay double"),
        "pairs")
    top = _top(pairs)
    asked = nodes.select("shard", *name).join(pairs.select(*name, "q", "stay"), name)
    stage.keep(context.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(
        _answer_contexts(depth, top), _ANSWER), "context_answers")
    counted = stage.keep(packed.where("kind = 'token'").repartition(shards, "shard").groupBy("shard").applyInArrow(
        _answer_tokens, _ANSWER), "token_answers")
    totals = counted.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    closing = packed.where("kind = 'closing'").agg(F.sum("m")).first()[0] or 0
    n, v = (totals.n or 0) + closing, (totals.v or 0) + (closing > 0)
    answers = docs.sparkSession.read.schema(_ANSWER).parquet(
        f"{stage.store.folder}/context_answers", f"{stage.store.folder}/token_answers")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(depth, n, v, closing), OUT)
