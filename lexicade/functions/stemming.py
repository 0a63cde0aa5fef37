"""Porter's suffix stripping (Program 14(3), 1980) with the usual extensions:
a few irregular words, short words kept, and the ``-ies``/``-ied`` endings of
four-letter words."""

from __future__ import annotations

# --- fixed values: words with a listed stem -----------------------------------
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# --- fixed values: endings of step 2, 3 and 4 ---------------------------------
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(stem: str) -> str:
    """Consonants as c, vowels as v; y is a vowel after a consonant."""
    out: list[str] = []
    for ch in stem:
        if ch in "aeiou" or (ch == "y" and out and out[-1] == "c"):
            out.append("v")
        else:
            out.append("c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _cvc(stem: str) -> bool:
    shape = _shape(stem)
    if len(stem) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and stem[-1] not in "wxy"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replace(word: str, rules, min_measure: int) -> str:
    for ending, new in rules:
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            return stem + new if _measure(stem) >= min_measure else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            return w[: len(w) - len(ending)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for ending in ("ed", "ing"):
        stem = w[: len(w) - len(ending)]
        if w.endswith(ending) and "v" in _shape(stem):
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    if _measure(stem) == 1 and _cvc(stem):
        return stem + "e"
    return stem


def _final_y(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        return w[:-1] + "i"
    return w


def _suffixes2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _suffixes2(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _replace(w, STEP2, 1)


def _suffixes4(w: str) -> str:
    for ending in sorted(STEP4, key=len, reverse=True):
        if w.endswith(ending):
            stem = w[: len(w) - len(ending)]
            if ending == "ion" and not stem.endswith(("s", "t")):
                return w
            return stem if _measure(stem) > 1 else w
    return w


def _final_e(w: str) -> str:
    if not w.endswith("e"):
        return w
    stem = w[:-1]
    m = _measure(stem)
    return stem if m > 1 or (m == 1 and not _cvc(stem)) else w


def _final_l(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def porter_stem(token: str | None) -> str | None:
    if token is None:
        return None
    w = token.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (
        _plural, _past, _final_y, _suffixes2,
        lambda x: _replace(x, STEP3, 1), _suffixes4, _final_e, _final_l,
    ):
        w = step(w)
    return w
