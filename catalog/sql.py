"""Building blocks of the oracle SQL."""

from __future__ import annotations

from catalog.inputs import NOISE, run_names
from lexicade.functions import lexicons as lx
from lexicade.functions import text as tx
from lexicade.functions.stats import ERFC_COEFFICIENTS
from lexicade.functions.stemming import IRREGULAR, STEP2, STEP3, STEP4


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


# ------------------------------------------------------------------- text ----
def typography(x: str) -> str:
    frm = " || ".join(f"chr({ord(c)})" for c in lx.TYPOGRAPHY)
    to = " || ".join(f"chr({ord(c)})" for c in lx.TYPOGRAPHY.values())
    return f"replace(translate({x}, {frm}, {to}), chr({ord(lx.ELLIPSIS[0])}), '...')"


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def spaces(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(tx.SPACE_PATTERN)}, ' ', 'g'))"


def clean(x: str) -> str:
    return spaces(strip_tags(typography(x)))


def expand(x: str) -> str:
    """A listed word, also in quotes, becomes its long form with the same first capital."""
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.CONTRACTIONS.items())
    bare = in_list(k for k in lx.CONTRACTIONS if "'" not in k)
    quote = q("'")

    def cased(word: str, form: str) -> str:
        return (f"CASE WHEN left({word}, 1) <> left(lower({word}), 1) "
                f"THEN upper(left({form}, 1)) || substr({form}, 2) ELSE {form} END")

    return f"""array_to_string(list_transform(list_transform(list_transform(
        regexp_extract_all({x}, {q("[" + chr(92) + "p{L}']+|[^" + chr(92) + "p{L}']+")}),
        lambda p: {{'p': p, 'c': trim(p, {quote}), 'on': contains(p, {quote}) OR lower(p) IN {bare}}}),
        lambda s: {{'s': s, 'f': CASE WHEN s.on THEN CASE lower(s.p) {cases} END END,
                    'g': CASE WHEN s.on THEN CASE lower(s.c) {cases} END END}}),
        lambda r: CASE WHEN r.f IS NOT NULL THEN {cased('r.s.p', 'r.f')}
          WHEN r.g IS NOT NULL
            THEN left(r.s.p, length(r.s.p) - length(ltrim(r.s.p, {quote}))) || {cased('r.s.c', 'r.g')}
              || right(r.s.p, length(r.s.p) - length(rtrim(r.s.p, {quote})))
          ELSE r.s.p END), '')"""


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(tx.TOKEN_PATTERN)})"


def lower(t: str) -> str:
    return f"list_transform({t}, lambda w: lower(w))"


def letters(t: str) -> str:
    return (f"list_filter(list_transform({t}, lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g')),"
            " lambda w: w <> '')")


def filtered(t: str) -> str:
    words = in_list(lx.AUXILIARIES + lx.DETERMINERS + lx.POSSESSIVE_ENDINGS)
    return f"list_filter({t}, lambda w: w NOT IN {words})"


def grams(t: str, upto: int = 3) -> str:
    out = t
    for n in range(2, upto + 1):
        out = (f"list_concat({out}, list_transform(range(1, len({t}) - {n - 2}), "
               f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')))")
    return out


# ----------------------------------------------------------------- corpus ----
CORPUS = """corpus AS (
  SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"""
UNIQUE = """uniq AS (SELECT * FROM corpus
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"""
SPLIT = """split AS MATERIALIZED (SELECT doc_id, text, label,
    CASE WHEN rn * 100 <= 50 * n THEN 'train' WHEN rn * 100 <= 85 * n THEN 'val'
         ELSE 'test' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n,
          row_number() OVER (PARTITION BY label ORDER BY md5('42' || doc_id), doc_id) AS rn
        FROM uniq))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def split_corpus() -> list[str]:
    return [CORPUS, UNIQUE, SPLIT]


def token_docs(column: str = "tokens_lower") -> list[str]:
    """split -> toks(doc_id, label, split, t) with an empty list as one empty token."""
    base = lower("c")
    made = {"tokens_cased": "c", "tokens_lower": base, "tokens_letters": letters(base),
            "tokens_filtered": filtered(base)}[column]
    return [*split_corpus(), f"""toks AS MATERIALIZED (
  SELECT doc_id, label, split, CASE WHEN len(t) = 0 THEN [''] ELSE t END AS t FROM (
    SELECT doc_id, label, split, {made} AS t FROM (
      SELECT *, {tokens(expand(clean('text')))} AS c FROM split)))"""]


def term_counts(upto: int = 3) -> str:
    return f"""cnts AS MATERIALIZED (SELECT doc_id, label, split, term, count(*) AS cnt FROM (
    SELECT doc_id, label, split, unnest({grams('t', upto)}) AS term FROM toks)
  GROUP BY doc_id, label, split, term)"""


FEATURES = """feats AS MATERIALIZED (SELECT term, count(*) AS df,
    coalesce(sum(cnt) FILTER (WHERE label = 1), 0)::BIGINT AS c_pos,
    coalesce(sum(cnt) FILTER (WHERE label <> 1), 0)::BIGINT AS c_neg
  FROM cnts WHERE split = 'train' GROUP BY term
  HAVING count(*) >= 10
     AND count(*) <= 0.7::DOUBLE * (SELECT count(*) FROM split WHERE split = 'train'))"""


def scored(source: str, name: str) -> str:
    """name(source columns, logodds, z) with totals over the rows of source."""
    return f"""{name} AS MATERIALIZED (SELECT *,
    logodds / sqrt(1.0::DOUBLE / (c_pos + a) + 1.0::DOUBLE / (c_neg + a)) AS z
  FROM (SELECT {source}.*, a, ln(((c_pos + a) / (n_pos + a * size))
               / ((c_neg + a) / (n_neg + a * size))) AS logodds
        FROM {source}, (SELECT 0.01::DOUBLE AS a, sum(c_pos) AS n_pos, sum(c_neg) AS n_neg,
                               count(*) AS size FROM {source})))"""


Z = scored("feats", "z")


def features(column: str = "tokens_lower", upto: int = 3) -> list[str]:
    return [*token_docs(column), term_counts(upto), FEATURES]


def z_features(column: str = "tokens_lower", upto: int = 3) -> list[str]:
    return [*features(column, upto), Z]


# ------------------------------------------------------------ predictions ----
def predictions(*experiments: str) -> list[str]:
    rows = ", ".join(f"({q(e)}, {q(m)})" for e, m in run_names(*experiments))
    return [CORPUS, f"""runs(experiment, model) AS (VALUES {rows}),
hashed AS (SELECT experiment, model, doc_id, label,
    md5(model || ':' || md5(text) || ':' || doc_id) AS h, md5(model) AS g FROM corpus, runs),
drawn AS (SELECT *, ('0x' || substr(h, 1, 6))::UBIGINT::BIGINT % 1001 AS u,
    ('0x' || substr(h, 7, 6))::UBIGINT::BIGINT % 100
      < 55 + ('0x' || substr(g, 1, 6))::UBIGINT::BIGINT % 40 AS leans FROM hashed),
preds AS MATERIALIZED (SELECT experiment, model, doc_id, label AS true_label,
    (CASE WHEN NOT leans THEN u WHEN label = 1 THEN greatest(u, 1000 - u)
          ELSE least(u, 1000 - u) END)::DOUBLE / 1000.0::DOUBLE AS probability FROM drawn),
hard_labels AS MATERIALIZED (SELECT *, (probability > 0.5)::INT AS pred,
    ((probability > 0.5)::INT = true_label)::INT AS ok FROM preds)"""]


# cells per model, as used by the report and the metrics
def cells(source: str = "hard_labels", by: str = "model") -> str:
    return f"""cells AS (SELECT {by},
    count(*) FILTER (WHERE pred = 1 AND true_label = 1)::DOUBLE AS tp,
    count(*) FILTER (WHERE pred = 1 AND true_label = 0)::DOUBLE AS fp,
    count(*) FILTER (WHERE pred = 0 AND true_label = 1)::DOUBLE AS fn,
    count(*) FILTER (WHERE pred = 0 AND true_label = 0)::DOUBLE AS tn
  FROM {source} GROUP BY {by})"""


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a}) / nullif({b}, 0) END)"


P1, R1 = ratio("tp", "(tp + fp)"), ratio("tp", "(tp + fn)")
P0, R0 = ratio("tn", "(tn + fn)"), ratio("tn", "(tn + fp)")
F1, F0 = ratio("2 * tp", "(2 * tp + fp + fn)"), ratio("2 * tn", "(2 * tn + fp + fn)")
ACC = ratio("tp + tn", "(tp + tn + fp + fn)")


def p_value(chi2: str) -> str:
    """Upper tail of chi-squared with one degree of freedom."""
    x = f"sqrt(({chi2}) / 2.0::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {x}))"
    poly = f"{ERFC_COEFFICIENTS[-1]}::DOUBLE"
    for a in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({a}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


NOISY = f"noisy AS (SELECT doc_id, text || {q(NOISE)} AS text FROM documents)"


# ----------------------------------------------------------- stems, lemmas ----
def lemma_candidates(words: str) -> str:
    parts = [f"SELECT token, token AS lemma, -1 AS o FROM {words}"]
    for i, (ending, new) in enumerate(lx.NOUN_ENDINGS):
        parts.append(
            f"SELECT token, left(token, length(token) - {len(ending)}) || {q(new)} AS lemma, "
            f"{i} AS o FROM {words} WHERE ends_with(token, {q(ending)})")
    return " UNION ALL ".join(parts)


# Porter's measure as regular expressions over a stem
_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_FIRST = f"(?:{_CS}{_VS}|[aeiou]+)"  # y does not count as a vowel at the start
M_GT0 = f"^{_FIRST}{_CS}"
M_EQ1 = f"^{_FIRST}{_CS}({_VS})?$"
M_GT1 = f"^{_FIRST}{_CS}{_VS}{_CS}"
HAS_VOWEL = f"^(?:{_CS}{_V}|[aeiou])"
# consonant-vowel-consonant end; also vowel-consonant as the whole stem
CVC = f"(^{_CS}{_V}[^aeiouwxy]$|^{_V}{_C}$)"


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _rules(x: str, rules, condition: str) -> str:
    """First matching ending decides, whether or not its condition holds."""
    cases = " ".join(
        f"WHEN ends_with({x}, {q(e)}) THEN CASE WHEN {_m(_cut(x, len(e)), condition)} "
        f"THEN {_cut(x, len(e))} || {q(n)} ELSE {x} END" for e, n in rules)
    return f"CASE {cases} ELSE {x} END"


def _after_cut(x: str) -> str:
    """Repair of a stem from which -ed or -ing was removed."""
    return (
        f"CASE WHEN ends_with({x}, 'at') OR ends_with({x}, 'bl') OR ends_with({x}, 'iz') "
        f"THEN {x} || 'e' WHEN length({x}) > 1 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) "
        f"AND {_m(x, '[^aeiou]$')} THEN CASE WHEN right({x}, 1) IN ('l', 's', 'z') THEN {x} "
        f"ELSE {_cut(x, 1)} END WHEN {_m(x, M_EQ1)} AND {_m(x, CVC)} THEN {x} || 'e' "
        f"ELSE {x} END")


def porter_steps(words: str) -> str:
    """SELECT token, stem for a table of distinct lower-case tokens."""
    w = "w"
    steps = [
        f"CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {_cut(w, 1)} "
        f"WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(w, 2)} "
        f"WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_cut(w, 1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_cut(w, 1)} "
        f"ELSE {_cut(w, 2)} END "
        f"WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(_cut(w, 3), M_GT0)} THEN {_cut(w, 1)} "
        f"ELSE w END "
        f"WHEN ends_with(w, 'ed') AND {_m(_cut(w, 2), HAS_VOWEL)} "
        f"THEN {_after_cut(_cut(w, 2))} "
        f"WHEN ends_with(w, 'ing') AND {_m(_cut(w, 3), HAS_VOWEL)} "
        f"THEN {_after_cut(_cut(w, 3))} ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND {_m(_cut(w, 1), '[^aeiou]$')} "
        f"THEN {_cut(w, 1)} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {_m(_cut(w, 4), M_GT0)} THEN {_cut(w, 2)} ELSE w END",
        f"CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {_m(_cut(w, 3), M_GT0)} "
        f"THEN {_cut(w, 1)} ELSE w END ELSE {_rules(w, STEP2, M_GT0)} END",
        _rules(w, STEP3, M_GT0),
        "CASE " + " ".join(
            f"WHEN ends_with(w, {q(e)}) THEN CASE WHEN {_m(_cut(w, len(e)), M_GT1)}"
            + (f" AND {_m(_cut(w, 3), '[st]$')}" if e == "ion" else "")
            + f" THEN {_cut(w, len(e))} ELSE w END"
            for e in sorted(STEP4, key=len, reverse=True)) + " ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({_m(_cut(w, 1), M_GT1)} OR "
        f"({_m(_cut(w, 1), M_EQ1)} AND NOT {_m(_cut(w, 1), CVC)})) THEN {_cut(w, 1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_m(_cut(w, 1), M_GT1)} THEN {_cut(w, 1)} ELSE w END",
    ]
    inner = f"SELECT token, token AS w FROM {words}"
    for step in steps:
        inner = f"SELECT token, {step} AS w FROM ({inner})"
    listed = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in IRREGULAR.items())
    return (f"SELECT token, CASE token {listed} ELSE CASE WHEN length(token) <= 2 THEN token "
            f"ELSE w END END AS stem FROM ({inner})")


def stemmed_documents() -> str:
    cased = tokens(expand(clean("text")))
    return with_(
        NOISY, f"lows AS MATERIALIZED (SELECT doc_id, {lower('c')} AS t FROM "
               f"(SELECT doc_id, {cased} AS c FROM noisy))",
        "words AS MATERIALIZED (SELECT DISTINCT unnest(t) AS token FROM lows)",
        f"stems AS MATERIALIZED ({porter_steps('words')})",
        "spread AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM lows)",
    ) + ("SELECT doc_id, list(stem ORDER BY pos) AS tokens FROM spread JOIN stems USING (token) "
         "GROUP BY doc_id")


def mapped_docs(column: str, where: str = "true") -> list[str]:
    """As token_docs, with every lower-case token replaced by its stem or lemma."""
    if column == "tokens_stemmed":
        table = [f"mapping AS MATERIALIZED (SELECT token, stem AS form FROM ({porter_steps('words')}))"]
    else:
        table = [f"forms AS ({lemma_candidates('words')})",
                 """mapping AS MATERIALIZED (SELECT f.token,
    arg_min(f.lemma, length(f.lemma) * 100 + f.o) AS form
  FROM forms f JOIN words w ON f.lemma = w.token GROUP BY f.token)"""]
    lows = token_docs("tokens_lower")
    return [*lows[:-1], lows[-1].replace("toks AS", "lows AS"),
            f"lowered AS MATERIALIZED (SELECT * FROM lows WHERE {where})",
            "words AS MATERIALIZED (SELECT DISTINCT unnest(t) AS token FROM lowered)", *table,
            """toks AS MATERIALIZED (SELECT doc_id, label, split,
    list(coalesce(form, token) ORDER BY pos) AS t FROM (
      SELECT doc_id, label, split, unnest(t) AS token, unnest(range(len(t))) AS pos FROM lowered)
    LEFT JOIN mapping USING (token) GROUP BY doc_id, label, split)"""]
