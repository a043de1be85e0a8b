"""Grounding: do the factual claims of an output agree with context documents?

A text is split into sentences; sentences with a claim marker are judged in four steps, and the first that objects
decides: years, numbers with units, negated conditions, overlap of words. The context is either one of the options (then
all that is drawn from it is a literal, worked out once) or a column that a join has brought to each row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.patterns import any_of
from ..functions.stems import any_literal
from .scan import Options, all_matches, if_likely, java, nothing, violation

RULE = "block_hallucination"
MOST = 3
SENTENCE_END = "[.!?;]+"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), trimmed), lambda s: s != "")


def trimmed(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, java(r"^\s+|\s+$"), ""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of ``value``, which is worked out once however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_claim(sentence: Column) -> Column:
    return sentence.rlike(java(any_literal(C.CLAIM_MARKERS), True))


def cued_years(text: Column) -> Column:
    return F.transform(F.array_distinct(all_matches(text, C.CUED_YEAR, True, 1)), lambda y: y.cast("int"))


def all_years(text: Column) -> Column:
    return F.transform(F.array_distinct(all_matches(text, C.YEAR, False, 1)), lambda y: y.cast("int"))


def numbers(text: Column) -> Column:
    """array<struct<value:double,unit:string,raw:string>>: dollars first, then numbers with a unit; only values above 0."""
    value = lambda n: F.coalesce(F.regexp_replace(n, ",", "").try_cast("double"), F.lit(0.0))

    def one(raw: Column, number: Column, unit: Column) -> Column:
        return F.struct(value(number).alias("value"), unit.alias("unit"), F.trim(raw).alias("raw"))

    dollars = F.zip_with(all_matches(text, C.DOLLARS, False, 0), all_matches(text, C.DOLLARS, False, 1), lambda r, n: one(r, n, F.lit("usd")))
    parts = F.arrays_zip(*[all_matches(text, C.WITH_UNIT, True, i).alias(f"g{i}") for i in range(3)])
    units = F.transform(parts, lambda p: one(p["g0"], p["g1"], F.regexp_replace(F.lower(p["g2"]), "s$", "")))
    return F.filter(F.concat(dollars, units), lambda e: e["value"] > 0)


def tokens(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*C.STOPWORDS))


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def share(needles: Column, haystack: Column) -> Column:
    return F.size(F.filter(needles, lambda n: F.contains(haystack, n))) / F.size(needles)


def overlap(sentence: Column, lower_context: Column) -> Column:
    """struct(supported, score): bigrams decide for four tokens and more, else and failing that single tokens."""
    score = lambda value, least: F.struct((value >= least).alias("supported"), value.alias("score"))
    words = tokens(sentence)

    def judge(w: Column) -> Column:
        by_pair, by_word = share(bigrams(w), lower_context), share(w, lower_context)
        return (
            F.when(F.size(w) == 0, F.struct(F.lit(True).alias("supported"), F.lit(1.0).alias("score")))
            .when((F.size(w) >= 4) & (by_pair >= 0.55), score(by_pair, 0.55))
            .when(F.size(w) >= 4, score(by_word, 0.60))
            .otherwise(score(by_word, 0.55))
        )

    return F.element_at(F.transform(F.array(words), judge), 1)


def ungrounded(claimed: Column, known: Column) -> Column:
    """The claimed numbers for which no known number has the same unit and is within one per cent."""
    near = lambda c, k: (c["unit"] == k["unit"]) & (F.abs(k["value"] - c["value"]) / F.greatest(k["value"], c["value"], F.lit(1.0)) <= 0.01)
    return F.filter(claimed, lambda c: ~F.exists(known, lambda k: near(c, k)))


def negates(sentence: Column, obliged: Column, limited: Column) -> Column:
    """A negation that turns round an obligation or a limit that the context states."""
    no = sentence.rlike(java(any_literal(C.NEGATIONS), True))
    obligation = sentence.rlike(java(C.NEGATED_OBLIGATION[0], True)) | sentence.rlike(java(C.NEGATED_OBLIGATION[1], True))
    return no & ((obliged & obligation) | (limited & sentence.rlike(java(C.NEGATED_LIMIT, True))))


def context_facts(context: Column) -> Column:
    """What is drawn from a context once: struct(lower, years, numbers, obliged, limited)."""
    return F.struct(
        F.lower(context).alias("lower"),
        all_years(context).alias("years"),
        numbers(context).alias("numbers"),
        context.rlike(java(C.OBLIGATION, True)).alias("obliged"),
        context.rlike(java(C.QUANTITY, True)).alias("limited"),
    )


def _cut(sentence: Column, n: int) -> Column:
    return F.concat(F.substring(sentence, 1, n), F.when(F.length(sentence) > n, "...").otherwise(""))


def judged(sentence: Column, facts: Column) -> Column:
    """The violation of one claim sentence, or null."""
    joined = lambda a: F.array_join(F.transform(a, lambda y: y.cast("string")), ", ")
    evidence = F.substring(sentence, 1, 200)
    known_years = F.coalesce(F.nullif(joined(facts["years"]), F.lit("")), F.lit("none"))

    def temporal(years: Column) -> Column:
        found = violation(RULE, F.concat(F.lit("Temporal claim references year(s) ("), joined(years), F.lit(") not found in context (context years: "), known_years, F.lit('). Claim: "'), _cut(sentence, 100), F.lit('"')), evidence, "HIGH", F.lit(0.90))
        return F.when(F.size(years) > 0, found).otherwise(bound(ungrounded(numbers(sentence), facts["numbers"]), numeric))

    def numeric(wrong: Column) -> Column:
        found = violation(RULE, F.concat(F.lit("Numeric value(s) in factual claim not found in context: "), F.array_join(F.transform(F.slice(wrong, 1, 2), lambda e: e["raw"]), ", "), F.lit('. Claim: "'), _cut(sentence, 100), F.lit('"')), evidence, "CRITICAL", F.lit(0.98))
        flip = violation(RULE, F.concat(F.lit('Factual claim appears to contradict context via negation: "'), _cut(sentence, 100), F.lit('"')), evidence, "HIGH", F.lit(0.85))
        return F.when(F.size(wrong) > 0, found).when(negates(sentence, facts["obliged"], facts["limited"]), flip).otherwise(bound(overlap(sentence, facts["lower"]), unsupported))

    def unsupported(lap: Column) -> Column:
        confidence = F.round(F.least(F.lit(0.75), F.greatest(F.lit(0.45), (1 - lap["score"]) * 0.75)), 2)
        return F.when(~lap["supported"], violation(RULE, F.concat(F.lit("Factual claim is not sufficiently grounded in provided context (overlap: "), F.round(lap["score"] * 100).cast("int").cast("string"), F.lit('%): "'), _cut(sentence, 120), F.lit('"')), evidence, "HIGH", confidence))

    return bound(F.array_except(cued_years(sentence), facts["years"]), temporal)


def _first_faults(text: Column, facts: Column, o: Options | None = None) -> Column:
    """The first violations of a text's claims; without claims nothing is drawn from the context."""
    found = lambda claims: F.slice(F.filter(F.transform(claims, lambda s: judged(s, facts)), lambda v: v.isNotNull()), 1, MOST)
    claims = F.filter(sentences(text), is_claim)
    return if_likely(text, [any_of(C.CLAIM_MARKERS)], F.element_at(F.transform(F.array(claims), lambda c: F.when(F.size(c) == 0, nothing()).otherwise(found(c))), 1), o)


def grounded_against(text: Column, context: Column) -> Column:
    """Violations of ``text`` against a context column; a null or empty context checks nothing."""
    found = F.element_at(F.transform(F.array(context_facts(context)), lambda facts: _first_faults(text, facts)), 1)
    return F.when(context.isNull() | (context == "") | ~is_claim(text), nothing()).otherwise(found)


@lru_cache(maxsize=64)
def _literal(context: str):
    """What is drawn from a literal context, worked out once; a one-row query, nothing of the data."""
    return SparkSession.active().sql("SELECT 1").select(context_facts(F.lit(context)).alias("f")).first()["f"]


def hallucination(text: Column, o: Options) -> Column:
    """The rule with context documents from the options, joined by single spaces; their facts are constants of the plan."""
    if not o.context:
        return nothing()
    f = _literal(" ".join(o.context))
    known = [F.struct(F.lit(n["value"]).alias("value"), F.lit(n["unit"]).alias("unit"), F.lit(n["raw"]).alias("raw")) for n in f["numbers"]]
    facts = F.struct(
        F.lit(f["lower"]).alias("lower"),
        F.array(*[F.lit(y) for y in f["years"]]).cast("array<int>").alias("years"),
        F.array(*known).cast("array<struct<value:double,unit:string,raw:string>>").alias("numbers"),
        F.lit(f["obliged"]).alias("obliged"),
        F.lit(f["limited"]).alias("limited"),
    )
    return _first_faults(text, facts, o)
