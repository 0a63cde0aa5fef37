"""Token ids of whole texts, with every distinct word encoded once per worker.

The tokenizers library encodes; what is saved is encoding a word again. A text is cut before
single spaces, where neither kind of tokenizer known here lets a token cross:

* byte-level with its own split pattern (a space belongs to the word after it): texts in which
  a space meets other white space are encoded whole;
* white space removed, words split by a pattern: any space may be cut at.

Texts for any other kind of tokenizer are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexicade.llm.textbytes import release

MEMO = 800_000  # words remembered; beyond that the memory starts anew
_BATCH = 1 << 22  # bytes of text handled at once
# between two words when many are encoded in one call; such a word itself is encoded alone
_MARK = "\x01"


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get(
            "add_prefix_space") and norm is None:
        return "prefixed"
    steps = (norm or {}).get("normalizers", [])
    parts = pre.get("pretokenizers", [])
    if (any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " "
            for s in steps) and parts and parts[0].get("type") == "Split" and parts[0].get("invert")
            and parts[0].get("behavior") == "Removed" and "\\s" in parts[0]["pattern"].get("Regex", "")):
        return "spaced"
    return "whole"


class WordIds:
    """Ids of remembered words, in one flat array."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path, self.kind = path, _kind(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.ends = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.kind == "spaced" and suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())  # in the order of their ids
        self.fresh: list[str] = []
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.edges = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.known) + len(self.fresh), len(words)
        while len(self.edges) < n + m + 1:
            self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used: self.used + len(ids)] = ids
        self.edges[n + 1: n + m + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.fresh += words

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        encode = self.tokenizer.encode_batch_fast
        plain = [w for w in words if _MARK not in w]
        odd = [w for w in words if _MARK in w]
        if len(self.mark) != 1 or self.kind != "spaced":
            if self.kind == "prefixed":
                self._learn_prefixed(plain)
                plain = []
            odd, plain = odd + plain, []
        elif self.ends is not None:
            letters = [w for w in plain if w.isalpha()]
            plain = [w for w in plain if not w.isalpha()]
            odd += self._learn_letters(letters)
        for a in range(0, len(plain), 256):
            some = plain[a: a + 256]
            ids = np.array(encode([f" {_MARK} ".join(["", *some, ""])], add_special_tokens=False)[0].ids,
                           dtype=np.uint32)
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(some) + 1:
                odd += some
                continue
            self._store(some, ids[ids != self.mark[0]], np.diff(at) - 1)
        for a in range(0, len(odd), 1024):
            some = odd[a: a + 1024]
            found = [e.ids for e in encode(some, add_special_tokens=False)]
            flat = np.array([i for f in found for i in f], dtype=np.uint32)
            self._store(some, flat, np.array([len(f) for f in found], dtype=np.int64))

    def _learn_letters(self, words: list[str]) -> list[str]:
        """Words of letters alone: each is one piece, whose last token says so. Returns the rest."""
        rest = []
        for a in range(0, len(words), 256):
            some = words[a: a + 256]
            ids = np.array(self.tokenizer.encode_batch_fast(
                [" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(self.ends[ids])
            if len(at) != len(some):
                rest += some
                continue
            self._store(some, ids, np.diff(np.r_[-1, at]))
        return rest

    def _learn_prefixed(self, words: list[str]) -> None:
        """Words that begin with a space and hold no other: a token that begins with one begins a word."""
        encode = self.tokenizer.encode_batch_fast
        if not hasattr(self, "begins"):
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.begins[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        alone, rest = [], []
        for w in words:
            fits = w.startswith(" ") and len(w) > 1 and not w[-1].isspace() and not w[1].isspace()
            (rest if fits else alone).append(w)
        for a in range(0, len(rest), 256):
            some = rest[a: a + 256]
            ids = np.array(encode(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(some):
                alone += some
                continue
            self._store(some, ids, np.diff(np.r_[at, len(ids)]))
        for a in range(0, len(alone), 1024):
            some = alone[a: a + 1024]
            found = [e.ids for e in encode(some, add_special_tokens=False)]
            flat = np.array([i for f in found for i in f], dtype=np.uint32)
            self._store(some, flat, np.array([len(f) for f in found], dtype=np.int64))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        texts = texts.fill_null("")
        if self.kind == "whole":
            return self._whole(texts.to_pylist())
        parts = pc.split_pattern(texts, " ")
        words = parts.flatten()
        counts = np.diff(parts.offsets.to_numpy())
        if self.kind == "prefixed":  # all words but the first of a text take their space back
            first = np.zeros(len(words), dtype=bool)
            first[(np.cumsum(counts) - counts)[counts > 0]] = True
            words = pc.if_else(pa.array(first), words, pc.binary_join_element_wise(
                pa.scalar("", words.type), words, pa.scalar(" ", words.type)))
        coded = words.dictionary_encode()
        names = coded.dictionary
        if len(self.known) + len(names) > MEMO:
            self.clear()
        found = pc.index_in(names, value_set=self.known)
        missing = names.filter(found.is_null())
        code = found.fill_null(0).to_numpy().astype(np.int64)
        if len(missing):
            before = len(self.known)
            self.learn(missing.to_pylist())
            fresh = pa.array(self.fresh, pa.large_string())
            code[found.is_null().to_numpy(zero_copy_only=False)] = before + pc.index_in(
                missing, value_set=fresh).to_numpy()
            self.known, self.fresh = pa.concat_arrays([self.known, fresh]), []
        code = code[coded.indices.to_numpy()] if len(names) else code
        begin, size = self.edges[code], self.edges[code + 1] - self.edges[code]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        run = np.r_[0, total]
        edges = np.r_[0, np.cumsum(counts)]
        lengths = run[edges[1:]] - run[edges[:-1]]
        if self.kind == "prefixed":
            ids, lengths = self._mend(texts, ids, lengths)
        return ids, lengths

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, dtype=np.uint32) for e in
                 self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(found) if found else np.zeros(0, np.uint32),
                np.array([len(f) for f in found], dtype=np.int64))

    def _mend(self, texts: pa.Array, ids: np.ndarray, lengths: np.ndarray):
        """Texts in which a space meets white space are encoded whole."""
        space = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
        odd = np.flatnonzero(pc.match_substring_regex(texts, f" {space}|{space} ").to_numpy(
            zero_copy_only=False))
        if not len(odd):
            return ids, lengths
        new, sizes = self._whole([texts[int(i)].as_py() for i in odd])
        pieces = np.split(ids, np.cumsum(lengths)[:-1])
        for i, piece in zip(odd.tolist(), np.split(new, np.cumsum(sizes)[:-1])):
            pieces[i] = piece
        return np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)


def word_ids(path: str) -> WordIds:
    """The memory of this worker process; it outlives a task, so it hangs on the library's module."""
    import os

    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = vars(tokenizers).setdefault("_word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def encoded(batch: pa.RecordBatch, path: str, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, counts) of parts of a batch; ``end`` closes each text."""
    memory = word_ids(path)
    column = batch.column("text")
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    block = (np.cumsum(sizes) - 1).clip(0) // _BATCH
    edges = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(sizes)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if a == b:
            continue
        ids, counts = memory.of(column.slice(a, b - a).cast(pa.large_string()))
        out = np.full(len(ids) + len(counts), end, dtype=np.uint32)
        mark = np.cumsum(counts + 1) - 1
        body = np.ones(len(out), dtype=bool)
        body[mark] = False
        out[body] = ids
        yield a, b, out, counts + 1
    release()
