"""Operator 6: quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text; they overlap and err. Expectation-maximisation estimates
each labeller's accuracies on good texts and on each kind of bad text, and the shares of these, from how often each pattern of votes occurs (counts over all rows;
the patterns are bounded by the number of labellers, not by the data). The posterior of a text's pattern is its label
for a linear scorer over hashed token shapes, learnt on a bounded sample and applied to every whole text. A token is a
run without white space, or each ``PART`` characters of a longer one, so texts without spaces are judged to their end.
The sample is ``SAMPLE_ROWS`` texts of any length, first in hash order; tasks make their features, so no text reaches
the driver.

Defined results: null and empty texts are bad by definition: score 0.0, kept false; texts of any length are read whole;
repeated rows and ties score alike; an empty table gives an empty table; without any vote the scorer follows the prior.
Only the text is an input, so further columns, whatever their names, neither matter nor clash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoGenerations, frugal, materialise, quoted, read_table, slices, text_or_empty, unused

#: Bound of the scorer's sample: rows, half of them good by their posterior, first in hash order.
SAMPLE_ROWS = 6000
DIMENSIONS = 1 << 14
THRESHOLD = 0.35
#: Vote of a labeller: good above the first bound and bad beyond the second, where it has an opinion at all.
GOOD, BAD, NONE = 1, 0, -1

def measures(text: Column) -> dict[str, Column]:
    """Native measures of a text that the labellers judge."""
    length = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words = F.greatest(count(r"\S+"), F.lit(1))
    return {
        "chars": F.length(text),
        "words": words,
        "symbols": count(r"[^\p{L}\p{N}\s.,;:'\"()?!|-]") / length,
        "marks": count(r"[!?|]") / words,
        "upper": count(r"\p{Lu}") / F.greatest(count(r"\p{L}"), F.lit(1)),
        "repeats": count(r"(?<!\S)(\S+)(?=\s+\1(?!\S))") / words,
        "digits": count(r"\p{N}") / length,
        "stops": count(r"[.!?](?=\s|$)") / words,
    }


def votes(m: dict[str, Column]) -> dict[str, Column]:
    """Labellers. Their bounds are rules of thumb for prose; the model finds out how far each is to be trusted."""
    judge = lambda good, bad: F.when(bad, BAD).when(good, GOOD).otherwise(NONE)
    return {
        "symbols": judge(m["symbols"] < 0.005, m["symbols"] > 0.03),
        "marks": judge(m["marks"] < 0.02, m["marks"] > 0.1),
        "upper": judge((m["upper"] > 0.001) & (m["upper"] < 0.15), m["upper"] > 0.5),
        "repeats": judge(m["repeats"] < 0.01, m["repeats"] > 0.05),
        "digits": judge(m["digits"] < 0.05, m["digits"] > 0.2),
        "sentences": judge((m["stops"] > 0.03) & (m["stops"] < 0.3), (m["stops"] < 0.005) & (m["words"] > 40)),
        "word_length": judge((m["chars"] / m["words"] > 4) & (m["chars"] / m["words"] < 10), (m["chars"] / m["words"] < 2.5) | (m["chars"] / m["words"] > 20)),
        "amount": judge(m["words"] >= 20, m["words"] < 3),
    }


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM: (posterior of good for each pattern, rates by bad and good, labeller and vote).

    Bad texts are of several kinds, each of which few labellers look for, so labellers don't err independently over all of
    them. The classes are good and, for each labeller, the bad kind that it looks for; within a class labellers are
    independent, and not voting is an outcome of its own. It starts from the rule that a bad vote makes a text bad, of
    the kinds of the labellers that cast one; all shares of classes and rates are then estimated, smoothed by one row.
    """
    one_hot = patterns[:, :, None] == np.array([BAD, NONE, GOOD])
    bad, kinds = patterns == BAD, patterns.shape[1]
    share = np.concatenate([np.where(bad.any(1), 0.1, 0.95)[:, None], np.where(bad.any(1, keepdims=True), 0.9 * bad / np.maximum(bad.sum(1, keepdims=True), 1), 0.05 / kinds)], 1)
    for _ in range(rounds):
        weight = counts[:, None] * share
        votes_for = np.einsum("pc,plv->clv", weight, one_hot)
        rates = (votes_for + 1 / 3) / (votes_for.sum(2, keepdims=True) + 1)
        prior = (weight.sum(0) + 1) / (counts.sum() + kinds + 1)
        log = np.log(prior) + np.einsum("plv,clv->pc", one_hot, np.log(rates))
        share = np.exp(log - log.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    by_side = np.stack([votes_for[1:].sum(0), votes_for[0]])
    return share[:, 0], (by_side + 1 / 3) / (by_side.sum(2, keepdims=True) + 1)


_LETTERS = re.compile(r"[^\W\d_]+")
#: Characters of a token; longer runs without white space are cut into consecutive tokens.
PART = 32


def tokens(text: str) -> list[str]:
    runs = text.split()
    if max(map(len, runs), default=0) <= PART:
        return runs
    return [run[at : at + PART] for run in runs for at in range(0, len(run), PART)]


def mixture(part: str) -> str:
    """Quarters of a part that are upper-case, lower-case and other letters, digits and other characters."""
    letters, upper, lower, digits = (sum(map(test, part)) for test in (str.isalpha, str.isupper, str.islower, str.isdigit))
    return "=" + "".join(str(round(4 * n / len(part))) for n in (upper, lower, letters - upper - lower, digits, len(part) - letters - digits))


def shape(word: str) -> str:
    """A token's form: its letters as their case and length class, its other characters as they are. Hardly two long
    tokens would have one form, so tokens of ``PART`` characters go by their mixture."""
    if len(word) >= PART:
        return mixture(word)
    return _LETTERS.sub(lambda m: ("A" if m[0].isupper() else "a" if m[0].islower() else "Aa") + "234567"[min(len(m[0]) // 3, 5)], word)


class Hashed:
    """Sparse hashed features of a text: shares of its token shapes and of words said again at once."""

    def __init__(self):
        self.slot = TwoGenerations(lambda w: zlib.crc32(shape(w).encode()) % (DIMENSIONS - 8) + 8)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = tokens(text)
        if not words:
            return np.array([0]), np.array([1.0])
        slots = np.fromiter(map(self.slot.__getitem__, words), "i8", len(words))
        again = sum(map(str.__eq__, words, words[1:])) / len(words)
        used, n = np.unique(slots, return_counts=True)
        return np.concatenate([[0, 1, 2], used]), np.concatenate([[1.0, 4 * again, min(len(words), 50) / 50], np.sqrt(n / len(words))])


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, passes: int = 6, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft labels by adaptive stochastic steps."""
    w, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    r = np.random.default_rng(3)
    for _ in range(passes):
        for i in r.permutation(len(rows)):
            at, x = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30))) - target[i]) * x + 1e-5 * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
    return w


def weak_labels(docs: DataFrame, text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """``order`` (a hash of the text), the votes and ``posterior`` for each row; the labellers' rates."""
    named = votes(measures(F.col("__text")))
    body = docs.select(text_or_empty(text).alias("__text"))
    voted = materialise(body.select(F.xxhash64("__text").alias("order"), *[v.cast("int").alias(f"vote_{k}") for k, v in named.items()]), "op6-votes")
    columns = [f"vote_{k}" for k in named]
    found = voted.groupBy(*columns).count().orderBy(*columns).collect()  # at most 3 ** labellers rows
    if not found:
        return voted.withColumn("posterior", F.lit(0.5)), np.full((2, len(columns), 3), 1 / 3)
    posterior, rates = label_model(np.array([[r[c] for c in columns] for r in found]), np.array([r["count"] for r in found], float))
    table = docs.sparkSession.createDataFrame([(*[r[c] for c in columns], float(p)) for r, p in zip(found, posterior, strict=True)], ", ".join(f"{c} int" for c in columns) + ", posterior double")
    return voted.join(F.broadcast(table), columns), rates


def sampled_features(rows: DataFrame) -> DataFrame:
    """Rows (order, text) to (order, slots, values), made in the tasks."""

    def run(batches):
        hashed = Hashed()
        for whole in batches:
            for batch in slices(whole, 1):
                found = [hashed.of(t) for t in batch.column(1).to_pylist()]
                hashed.slot.turn()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))], names=["order", "slots", "features"])

    return rows.select("order", "text").mapInArrow(frugal(run), "order long, slots array<int>, features array<double>")


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weights of the linear scorer, from posterior labels of the bounded sample."""
    labelled, _ = weak_labels(docs, text)
    half = SAMPLE_ROWS // 2
    body = docs.select(text_or_empty(text).alias("text")).withColumn("order", F.xxhash64("text")).filter("text <> ''")
    wanted = [labelled.filter(side).groupBy("order").agg(F.max("posterior").alias("posterior")).orderBy("order").limit(half) for side in (F.col("posterior") < 0.5, F.col("posterior") >= 0.5)]
    chosen = materialise(wanted[0].unionByName(wanted[1]), "op6-chosen")  # at most SAMPLE_ROWS rows
    drawn = sampled_features(body.join(F.broadcast(chosen), "order", "left_semi"))
    features = drawn.groupBy("order").agg(F.first("slots").alias("slots"), F.first("features").alias("features"))
    found = sorted(features.join(F.broadcast(chosen), "order").collect(), key=lambda r: r["order"])  # each at most DIMENSIONS long
    return fit_linear([(np.array(r["slots"], "i8"), np.array(r["features"])) for r in found], np.array([r["posterior"] for r in found]))


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """Columns ``keep`` and ``into`` (none of them), the score of each row; no shuffle."""
    fields = [docs.schema[k] for k in keep]
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    n = len(keep)

    def run(batches):
        hashed, w = Hashed(), shared.value
        for whole in batches:
            for batch in slices(whole, n):
                got = []
                for t in batch.column(n).to_pylist():
                    slots, x = hashed.of(t)
                    got.append(0.0 if not t.strip() else float(1 / (1 + np.exp(-np.clip(w[slots] @ x, -30, 30)))))
                hashed.slot.turn()
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.float64())], names=[*keep, into])

    schema = T.StructType([*fields, T.StructField(into, T.DoubleType())])
    return docs.select(*map(quoted, keep), text_or_empty(text).alias(unused("__text", docs))).mapInArrow(frugal(run), schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs), ["doc_id"]).withColumn("good", F.col("score") >= THRESHOLD)
