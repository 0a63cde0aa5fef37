"""Personal data: fixed patterns as seeds, and identifiers that their contexts give away.

Seeds are e-mail addresses, IPv4 addresses, card numbers (14 to 19 digits, Luhn) and phone
numbers (10 to 15 digits), leftmost and without overlap per kind; a match that fails its
check is dropped. The expressions are written with guards and possessive quantifiers that
change no match but keep the time linear in the text.

Outside the seeds, every token with a digit or @ is an open instance, and neighbouring
tokens of digits, dots and dashes with at most three spaces and brackets between them are one;
dots and dashes at its ends are not compared. An occurrence has a context of three lexical
patterns, from at most 64 code points on either side: the two words before it, the word on either side, the two
words after it. Patterns and instances form a graph, scored in rounds:

* A pattern's confidence for a kind is the sum of what its different instances give, divided by their
  number; the sum must reach ``support`` and the share one half. A seed gives 1 to its own kind. An open
  instance gives the confidence it has from its contexts without that pattern, so nothing is
  proved by itself; one that has no other context gives 0, and still counts in the number.
* A context's confidence is that of its best pattern. An instance's is 1 - prod(1 - confidence) over its
  contexts.
* An open instance must look like one (``plausible``): six digits for cards and phones, six characters with
  three digits for addresses of machines, an @ or six characters with a letter for mail.

A pattern needs no seed: instances found in one round support the patterns of the next. There are at
least ``rounds`` rounds, and more until one adds no pattern. After the rounds, an occurrence is a found
span if its context is confident. It is one in any context if its instance is confident also when its confidence
is no more than the mean over its contexts, of which only those are left out whose patterns have too few instances
to tell: what is seen in many contexts that say nothing is no identifier. Only distinct contexts are
counted, so copies of a text add nothing.

Defined cases: a null text is empty and has no span; rows that repeat are judged row by row;
overlapping spans of different kinds are all reported, and masked together; no
column but the text is looked at, and the others are carried along under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3.0  # summed confidence of a pattern's instances of the kind
CONFIDENT = 0.8
ROUNDS = 3  # at least
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = "A-Za-z0-9@._%+-"
# a token of digits, dots and dashes, and such tokens after it
_NUMBER = rf"(?<![{_TOKEN}])[.+-]*+[0-9][0-9.+-]*+(?![{_TOKEN}])"
OPEN = (rf"(?:(?<![{_TOKEN}])\((?=[0-9.+-]++\)))?+{_NUMBER}(?:[\x20()]{{1,3}}+{_NUMBER})*+"
        rf"|(?<![{_TOKEN}])(?=[{_TOKEN}]*?[0-9@])[{_TOKEN}]++")
_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "open": "[0-9@]"}
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda s, i: s + digit(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+(?=.)", "")
            return F.when(F.length(plain) > 3, F.lit(False)).otherwise(plain.cast("int") <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def spans(text: Column, kind: str) -> Column:
    """Valid matches as (start, rank, kind, end): code points, from 0, end exclusive."""
    pattern = PATTERNS.get(kind, OPEN)
    none = F.array().cast(_SPAN)
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"),
                               F.lit(kind).alias("kind"), end.alias("end")))
        found = F.when(_valid(kind, x["m"]), F.concat(s["found"], one)).otherwise(s["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    # as many gaps as matches: the text after the last match is left out
    both = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("gap"), matches.alias("m"))
    folded = F.aggregate(
        both, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])
    return F.when(text.rlike(_NEEDS[kind]), folded).otherwise(none)


def base_spans(text: Column) -> Column:
    """All seeds by start, then by kind."""
    return F.array_sort(F.concat(*[spans(text, k) for k in KINDS]))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def _without(text: Column, found: Column) -> Column:
    """The text with line breaks in place of spans, as long as before."""
    def add(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        blank = F.repeat(F.lit("\n"), F.greatest(x["end"] - F.greatest(s["at"], x["start"]), F.lit(0)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap, blank).alias("out"))

    blanked = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) == 0, text).otherwise(blanked)


def _occurrence(text: Column):
    """(start, end, kind or null, instance, its three patterns) of a span."""
    def of(x: Column) -> Column:
        near = 64  # code points on either side
        first = F.greatest(x["start"] - near, F.lit(0))
        before = F.split(F.trim(F.lower(F.regexp_replace(
            F.substring(text, first + 1, x["start"] - first), r"\s+", " "))), " ")
        after = F.split(F.trim(F.lower(F.regexp_replace(
            F.substring(text, x["end"] + 1, F.lit(near)), r"\s+", " "))), " ")

        m = F.substring(text, x["start"] + 1, x["end"] - x["start"])

        def word(a: Column, i: int) -> Column:
            return F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))

        patterns = F.array(
            F.concat_ws(" ", word(before, -2), word(before, -1), F.lit("_")),
            F.concat_ws(" ", word(before, -1), F.lit("_"), word(after, 1)),
            F.concat_ws(" ", F.lit("_"), word(after, 1), word(after, 2)))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            F.when(x["rank"] < len(KINDS), x["kind"]).alias("kind"),
            F.when(x["rank"] < len(KINDS), m).otherwise(F.btrim(m, F.lit(".-"))).alias("instance"),
            patterns.alias("patterns"))
    return of


def plausible(instance: Column, kind: Column) -> Column:
    """Whether an open instance can be an identifier of the kind."""
    digits, size = F.length(_digits(instance)), F.length(instance)
    mail = instance.contains("@") | ((size >= 6) & instance.rlike("[A-Za-z]"))
    return F.when(kind == "email", mail).when(kind == "ip", (size >= 6) & (digits >= 3)).otherwise(digits >= 6)


def _scored(contexts: DataFrame, stage: Stage, rounds: int) -> tuple[DataFrame, DataFrame]:
    """From stored (context, instance, kind, patterns), of the open instances:
    (instance, patterns, kind, conf) in their contexts, (instance, kind, conf) in any."""
    each = contexts.select("context", "instance", "kind", F.explode("patterns").alias("pattern"))
    # a pattern of fewer instances never has the support, whatever is found
    totals = stage.keep(each.select("pattern", "instance").distinct().groupBy("pattern").agg(
        F.count("*").alias("n")).where(F.col("n") >= SUPPORT), "pii_totals")
    told = stage.keep(each.join(totals.select("pattern"), "pattern").distinct(), "pii_graph")
    seeds = told.where("kind is not null").select("pattern", "instance", "kind").distinct().select(
        "pattern", "kind", F.lit(1.0).alias("conf"))
    might = F.lit(False)
    for kind in KINDS:
        might = might | plausible(F.col("instance"), F.lit(kind))
    open_ = stage.keep(told.where(F.col("kind").isNull() & might).drop("kind"), "pii_open")
    of_instance = stage.keep(
        open_.select("instance", "context").distinct().groupBy("instance").agg(F.count("*").alias("m")), "pii_sizes")
    pairs = stage.keep(open_.select("pattern", "instance").distinct(), "pii_pairs")
    given, r, before, now = None, 0, None, None
    log = F.log(1 - F.least("conf", F.lit(0.99)))
    while r < rounds or now != before:
        known = seeds if given is None else seeds.union(given.select("pattern", "kind", "conf"))
        weight = known.groupBy("pattern", "kind").agg(F.sum("conf").alias("w")).where(F.col("w") >= SUPPORT)
        score = stage.keep(
            weight.join(totals, "pattern").select("pattern", "kind", (F.col("w") / F.col("n")).alias("conf"))
            .where(F.col("conf") >= 0.5), f"pii_patterns{r}")
        best = stage.keep(open_.join(score, "pattern").groupBy("instance", "context", "kind").agg(
            F.max("conf").alias("conf")).where(plausible(F.col("instance"), F.col("kind"))), f"pii_best{r}")
        sums = best.groupBy("instance", "kind").agg(F.sum(log).alias("log"), F.sum("conf").alias("total"))
        sums = stage.keep(sums.join(of_instance, "instance"), f"pii_found{r}")
        own = best.join(open_, ["instance", "context"]).groupBy("pattern", "instance", "kind").agg(
            F.sum(log).alias("own_log"))
        others = pairs.join(sums.drop("m"), "instance").join(own, ["pattern", "instance", "kind"], "left")
        left = 1 - F.exp(F.col("log") - F.coalesce("own_log", F.lit(0.0)))
        given = stage.keep(others.select("pattern", "kind", left.alias("conf")).where("conf > 1e-9"), f"pii_given{r}")
        # confidences only rise, so equal counts are equal sets
        before, now = now, score.agg(F.count("*"), F.count_if(F.col("conf") >= CONFIDENT)).first()
        r += 1
    near = best.join(contexts.where("kind is null").select("context", "patterns"), "context").drop("context")
    free = sums.select("instance", "kind", F.least(1 - F.exp("log"), F.col("total") / F.col("m")).alias("conf"))
    return near, free


def extract(docs: DataFrame, stage: Stage, carry: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Every row as (doc, base, spans): its ``carry`` columns in a struct, seeds, all spans."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), text.alias("text"))
    rows = rows.select("doc", "text", base_spans(F.col("text")).alias("base"))
    rows = rows.select("*", _without(F.col("text"), F.col("base")).alias("rest"))
    alone = spans(F.col("rest"), "open")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc", "base",
        F.transform(F.concat("base", alone), _occurrence(F.col("text"))).alias("seen"))
    rows = stage.keep(rows, "pii_rows")

    places = rows.select("row", F.explode("seen").alias("x")).select("row", "x.*").withColumn(
        "patterns", F.filter("patterns", lambda p: F.length(p) > 3))
    contexts = stage.keep(places.select("instance", "kind", "patterns").distinct().withColumn("context", F.monotonically_increasing_id()), "pii_contexts")
    found = _scored(contexts, stage, rounds)
    open_ = places.where("kind is null").select("row", "start", "end", "instance", "patterns")
    near, free = (x.where(F.col("conf") >= CONFIDENT - 1e-9) for x in found)
    added = open_.join(free, "instance").unionByName(open_.join(near, ["instance", "patterns"])).groupBy(
        "row", "start", "end").agg(F.max(F.struct("conf", "kind")).alias("b"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("b.kind")).cast("int") - 1
    added = stage.keep(added.groupBy("row").agg(F.collect_list(F.struct(
        "start", rank.alias("rank"), F.col("b.kind").alias("kind"), "end")).alias("added")), "pii_added")
    more = F.coalesce("added", F.array().cast(_SPAN))
    return rows.join(added, "row", "left").select(
        "doc", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """The text with <KIND> for every span; overlapping spans become one, named by the first."""
    def add(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["at"]
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        out = F.when(apart, F.concat(s["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.otherwise(s["out"]).alias("out"))

    return F.aggregate(
        found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def mask(docs: DataFrame, stage: Stage) -> DataFrame:
    """The rows of ``docs`` with all found spans masked in their texts."""
    found = extract(docs, stage, docs.columns)
    text = F.col("doc.text")
    new = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(masked(text, F.col("spans")))
    return found.select(*[
        new.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
