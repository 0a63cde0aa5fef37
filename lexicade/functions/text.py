"""Text cleaning, tokenising and token projections as Column expressions.

Everything here stays inside the JVM, except Unicode NFKC and stemming, for
which Spark has no built-in function; both run as Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicade.functions import lexicons as lx
from lexicade.functions.stemming import porter_stem

# words (inner hyphens kept), the clitic 's, runs of dots, single other symbols
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|'s|[.]{2,}|[^\s\p{L}\p{N}]"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
TAG_PATTERN = r"<[^>]+>"
SPACE_PATTERN = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
# pieces for contraction lookup: letters with apostrophes, or anything else
PIECE_PATTERN = r"[\p{L}']+|[^\p{L}']+"
# the same, with neighbouring pieces without an apostrophe taken together
LONG_PIECE_PATTERN = r"(?:\p{L}++(?!')|[^\p{L}']++){1,200}|[\p{L}']+"
# characters that NFKC may change, alone or by combining with a neighbour: all
# but ASCII, the stable part of Latin-1 and the common quotes and dashes
MAYBE_NOT_NFKC = (
    r"[\x{a0}\x{a8}\x{aa}\x{af}\x{b2}-\x{b5}\x{b8}-\x{ba}\x{bc}-\x{be}"
    r"\x{100}-\x{2012}\x{2015}-\x{2017}\x{201b}\x{201f}-\x{10ffff}]"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- cleaning ---
NFKC_ROWS = 256  # texts that are Python strings at a time


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    parts = [pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in texts.slice(
        lo, NFKC_ROWS).to_pylist()], pa.string()) for lo in range(0, len(texts), NFKC_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def maybe_not_nfkc(text: Column | str) -> Column:
    """False if NFKC surely leaves the text as it is."""
    return _col(text).rlike(MAYBE_NOT_NFKC)


def nfkc(text: Column | str) -> Column:
    """Unicode NFKC. Only texts that can change are sent to Python."""
    t = _col(text)
    return F.coalesce(_nfkc(F.when(maybe_not_nfkc(t), t)), t)


def decode_utf8(raw: Column | str) -> Column:
    return F.decode(_col(raw), "UTF-8")


def unify_typography(text: Column | str) -> Column:
    one, three = lx.ELLIPSIS
    plain = F.translate(_col(text), "".join(lx.TYPOGRAPHY), "".join(lx.TYPOGRAPHY.values()))
    return F.replace(plain, F.lit(one), F.lit(three))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), TAG_PATTERN, " ")


def collapse_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), SPACE_PATTERN, " "))


def clean_normalized(text: Column | str) -> Column:
    """Cleaning of a text that is in NFKC already."""
    return collapse_spaces(strip_tags(unify_typography(text)))


def clean_text(text: Column | str) -> Column:
    return clean_normalized(nfkc(text))


def expand_contractions(
    text: Column | str, table: Mapping[str, str] = lx.CONTRACTIONS
) -> Column:
    """Expand contractions; the case of the first letter is kept.

    A word is looked up as it stands, then without the quotes around it.
    Texts without an apostrophe pass through, and only words with one are looked
    up; a text with a listed word that has none is looked up word by word. ``text``
    is used several times, so it should be a column of its own.
    """
    t = _col(text)
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def listed_form(word: Column) -> Column:
        low = F.lower(word)
        found = F.try_element_at(lookup, low)
        raised = F.concat(F.upper(F.left(found, F.lit(1))), F.substr(found, F.lit(2)))
        capital = F.left(word, F.lit(1)) != F.left(low, F.lit(1))
        return F.when(capital, raised).otherwise(found)

    def expanded(piece: Column) -> Column:
        before, word, after = (
            F.regexp_extract(piece, p, i) for p, i in (("^'*", 0), ("^'*(.*?)'*$", 1), ("'*$", 0)))
        # null, and so passed over, where the word is not listed either
        quoted = F.concat(before, listed_form(word), after)
        return F.coalesce(listed_form(piece), quoted, piece)

    def by_piece(pattern: str, listed: Sequence[str]) -> Column:
        def one(piece: Column) -> Column:
            wanted = piece.contains("'")
            if listed:
                wanted = wanted | F.lower(piece).isin(*listed)
            return F.when(wanted, expanded(piece)).otherwise(piece)

        pieces = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(pieces, one), "")

    quick = F.when(t.contains("'"), by_piece(LONG_PIECE_PATTERN, ())).otherwise(t)
    bare = [k for k in table if "'" not in k]
    if not bare:
        return quick
    has_bare = t.rlike(r"(?i)\b(?:" + "|".join(bare) + r")\b")
    return F.when(has_bare, by_piece(PIECE_PATTERN, bare)).otherwise(quick)


# --------------------------------------------------------------- tokenising --
def tokenize(text: Column | str) -> Column:
    """Words and punctuation marks, in order."""
    return F.regexp_extract_all(_col(text), F.lit(TOKEN_PATTERN), F.lit(0))


def lower_tokens(tokens: Column | str) -> Column:
    return F.transform(_col(tokens), F.lower)


def letter_tokens(tokens: Column | str) -> Column:
    """ASCII letters only; tokens left empty are dropped."""
    bare = F.transform(_col(tokens), lambda t: F.regexp_replace(t, "[^a-zA-Z]", ""))
    return F.filter(bare, lambda t: t != "")


def content_tokens(
    tokens: Column | str,
    dropped: Sequence[str] = lx.AUXILIARIES + lx.DETERMINERS + lx.POSSESSIVE_ENDINGS,
) -> Column:
    """Part-of-speech filter by closed word classes (modals stay)."""
    return F.filter(_col(tokens), lambda t: ~t.isin(*dropped))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_lists(lists: pa.Array) -> pa.Array:
    """Stem every distinct token of the batch once, then put the stems back."""
    codes = lists.flatten().dictionary_encode()
    stems = pa.array([porter_stem(t) for t in codes.dictionary.to_pylist()], pa.string())
    flat = pc.take(stems, codes.indices)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(ends, flat, mask=mask)


def stem_tokens(tokens: Column | str) -> Column:
    return _stem_lists(_col(tokens))


def split_spaces(text: Column | str) -> Column:
    """Split on single spaces; empty tokens are kept."""
    return F.split(_col(text), " ")


def word_tokens(text: Column | str, lowercase: bool = True) -> Column:
    """Words of at least two characters; punctuation is dropped."""
    t = F.lower(_col(text)) if lowercase else _col(text)
    return F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0))


def ngrams(tokens: Column | str, n_range: tuple[int, int] = (1, 3)) -> Column:
    """All 1-grams, then all 2-grams, ... as space-joined strings.

    ``tokens`` is used once per n-gram, so it should be a column of its own.
    """
    t = _col(tokens)
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        if n == 1:
            return t
        # sequence() would count downwards on arrays shorter than n
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(none)

    lo, hi = n_range
    if lo == hi:
        return of(lo)
    return F.flatten(F.array(*[of(n) for n in range(lo, hi + 1)]))


def ngram_size(term: Column | str) -> Column:
    return F.regexp_count(_col(term), F.lit(" ")) + 1


def display_label(term: Column | str) -> Column:
    return F.replace(_col(term), F.lit(" "), F.lit("_"))


# -------------------------------------------------------------- predictions --
def predict_label(probability: Column | str) -> Column:
    """1 if the probability is strictly above one half."""
    return (_col(probability) > 0.5).cast("int")


def outcome_label(probability: Column | str, true_label: Column | str) -> Column:
    p, y = predict_label(probability), _col(true_label)
    return (
        F.when(p == y, "Correctly Classified")
        .when((p == 0) & (y == 1), "False Negative")
        .when((p == 1) & (y == 0), "False Positive")
        .otherwise("Unknown")
    )


def uncertainty(probability: Column | str) -> Column:
    return F.abs(_col(probability) - 0.5)
