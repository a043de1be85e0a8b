"""Grounding against a table of context documents: what a claim states is looked up in an index of all of them.

A literal context is searched through for each claim; here the claims' years, numbers, words and pairs of words are joined
with what the documents hold, each distinct value once, so work grows with both tables and not with their product. A word
of a claim may stand inside a longer one of a document, as with a literal context, so the index has the pieces of the
documents' distinct words that are as long as some word of a claim; a pair of words may stretch over the end of one and the
start of the next. Numbers meet by unit and bucket of the logarithm, two buckets apart at most, and are then compared.

Each document is read by itself: no pair of words stretches over two of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..sources.storage import checkpointed
from .grounding import SENTENCE_END, all_years, bigrams, cued_years, is_claim, negates, numbers, tokens, trimmed
from .scan import java

#: Width of a bucket of numbers that may be within one per cent of each other: they lie in one or in neighbours.
_BUCKET = 0.0101


@dataclass(frozen=True)
class Index:
    """What context documents hold, distinct: words (word), pairs of adjacent words (left, right), numbers (unit, value) and
    years (year); and whether any of them obliges or limits."""

    words: DataFrame
    adjacent: DataFrame
    numbers: DataFrame
    years: DataFrame
    obliged: bool
    limited: bool


def index_of(documents: DataFrame, text: str = "text") -> Index:
    """The index, written to the shared folder; null texts hold nothing."""
    docs = documents.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    lower = F.lower("text")
    words = docs.select(F.explode(F.split(lower, "[^a-z0-9]+")).alias("word")).filter("word <> ''").distinct()
    # Words with exactly one blank between them; a look-ahead leaves the right one to be the next pair's left.
    pair = r"([a-z0-9]+)(?= ([a-z0-9]+))"
    both = F.arrays_zip(F.regexp_extract_all(lower, F.lit(pair), F.lit(1)).alias("left"), F.regexp_extract_all(lower, F.lit(pair), F.lit(2)).alias("right"))
    adjacent = docs.select(F.explode(both).alias("p")).select("p.left", "p.right").distinct()
    known = docs.select(F.explode(numbers(F.col("text"))).alias("n")).select("n.unit", "n.value").distinct()
    years = docs.select(F.explode(all_years(F.col("text"))).alias("year")).distinct()
    states = docs.agg(*[F.coalesce(F.bool_or(F.col("text").rlike(java(p, True))), F.lit(False)) for p in (C.OBLIGATION, C.QUANTITY)]).first()
    return Index(*map(checkpointed, (words, adjacent, known, years)), *states)


def claims(runs: DataFrame, key: str, output: str = "output") -> DataFrame:
    """(key, n, s): the claim sentences of each row's text, by their place among its sentences.

    No marker holds the end of a sentence or starts or ends with white space, so a text without one isn't split at all, and
    only claims are trimmed.
    """
    said = F.filter(F.split(output, SENTENCE_END), lambda s: s.rlike(java(r"[^\s]")))
    rows = runs.filter(is_claim(F.col(output))).select(key, F.posexplode_outer(said).alias("n", "s"))
    return rows.filter(F.col("n").isNotNull() & is_claim(F.col("s"))).select(key, "n", trimmed(F.col("s")).alias("s"))


def _held(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """Of distinct tokens (token) those that stand in some word."""
    lengths = [r[0] for r in wanted.select(F.length("token")).distinct().collect()]  # as many as the longest token has characters
    if not lengths:
        return wanted
    size = F.length("word")
    pieces = F.flatten(
        F.transform(
            F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= size),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr("word", i, n)),
        )
    )
    return wanted.join(words.select(F.explode(pieces).alias("token")).distinct(), "token", "left_semi")


def _paired(wanted: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Of distinct pairs of tokens (a, b) those where a word that ends in ``a`` stands before one that starts with ``b``."""
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.length(c)))
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, F.lit(1), i))
    left = adjacent.withColumn("a", F.explode(ends("left"))).join(wanted.select("a").distinct(), "a").select("a", "right").distinct()
    right = left.withColumn("b", F.explode(starts("right"))).select("a", "b").distinct()
    return wanted.join(right, ["a", "b"], "left_semi")


def _near(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Of distinct numbers (unit, value) those that a known one of the unit is within one per cent of."""
    bucket = F.floor(F.ln(F.greatest("value", F.lit(1.0))) / _BUCKET)
    spread = wanted.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    k = known.select("unit", F.col("value").alias("known"), bucket.alias("bucket"))
    both = spread.join(k, ["unit", "bucket"]).filter(F.abs(F.col("known") - F.col("value")) / F.greatest("known", "value", F.lit(1.0)) <= 0.01)
    return both.select("unit", "value").distinct()


def judged(claimed: DataFrame, index: Index, *key: str, sentence: str = "s") -> DataFrame:
    """(key, bad_years, bad_nums, flip, score, supported) of each claim; ``key`` names one claim.

    The steps are those of ``grounding.judged``, with all documents as the context.
    """
    s = F.col(sentence)
    drawn = checkpointed(claimed.select(*key, s.alias("s"), cued_years(s).alias("years"), numbers(s).alias("nums"), tokens(s).alias("words")))
    count = lambda rows, name: rows.groupBy(*key).agg(F.count("*").alias(name))

    years = drawn.select(*key, F.explode("years").alias("year"))
    bad_years = count(years.join(index.years, "year", "left_anti"), "bad_years")
    nums = drawn.select(*key, F.explode("nums").alias("x")).select(*key, "x.unit", "x.value")
    bad_nums = count(nums.join(_near(nums.select("unit", "value").distinct(), index.numbers), ["unit", "value"], "left_anti"), "bad_nums")
    token = drawn.select(*key, F.explode("words").alias("token"))
    single = count(token.join(checkpointed(_held(token.select("token").distinct(), index.words)), "token", "left_semi"), "single")
    two = drawn.select(*key, F.explode(F.transform(bigrams(F.col("words")), lambda p: F.split(p, " "))).alias("p")).select(*key, F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    pairs = count(two.join(checkpointed(_paired(two.select("a", "b").distinct(), index.adjacent)), ["a", "b"], "left_semi"), "pairs")

    of = drawn.select(*key, "s", F.size("words").alias("size"))
    for part in (bad_years, bad_nums, single, pairs):
        of = of.join(part, list(key), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_word, by_pair = n("single") / F.col("size"), n("pairs") / (F.col("size") - 1)
    long = F.col("size") >= 4
    score = F.when(F.col("size") == 0, 1.0).when(long & (by_pair >= 0.55), by_pair).otherwise(by_word)
    supported = F.when(F.col("size") == 0, True).when(long, (by_pair >= 0.55) | (by_word >= 0.60)).otherwise(by_word >= 0.55)
    return of.select(*key, n("bad_years").alias("bad_years"), n("bad_nums").alias("bad_nums"), _negates(F.col("s"), index).alias("flip"), score.alias("score"), supported.alias("supported"))


def _negates(sentence: Column, index: Index) -> Column:
    return negates(sentence, F.lit(index.obliged), F.lit(index.limited)) if index.obliged or index.limited else F.lit(False)


def ungrounded(claimed: DataFrame, index: Index, *key: str, sentence: str = "s") -> DataFrame:
    """(key, step): the claims that the documents don't bear out, and the first step that objects."""
    found = judged(claimed, index, *key, sentence=sentence)
    step = F.when(F.col("bad_years") > 0, "temporal").when(F.col("bad_nums") > 0, "numeric").when(F.col("flip"), "negation").when(~F.col("supported"), "overlap")
    return found.select(*key, step.alias("step")).filter("step is not null")
