"""Claims against a table of documents: as a search through all of them finds."""

import itertools

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import catalog as C
from ledgerlight.operators import context, grounding

DOCS = [
    "The maximum daily dose is 500 mg for adults. Approval is required.",
    "As of 2024 refunds take 30 days, and the rate is 3.5% per year.",
    "alpha beta gamma-delta  epsilon zeta_eta theta1 iota",
    None,
    "",
    "Prices: $1,000 and 0.004 units; reports were unreportable in 1999.",
]
CLAIMS = [
    "According to the label the dose is 500 mg", "The dose is 505 mg", "The dose is 506 mg", "The rate is 3.5% per year", "The rate is 35% per year", "As of 2024 refunds take 30 days",
    "As of 2019 refunds take 30 days", "According to alpha beta gamma delta", "According to beta gamma", "Per the port reportable", "The value is $1,000", "The value is $990", "The value is $989.99", "The value is 0.013 units", "The value is 0.015 units",
    "According to nobody approval is not required", "The policy says no approval", "Studies show zebras run quickly through valleys", "The current epsilon zeta eta theta", "As per of", "It is a fact that maximum daily dose adults", "No claim here", None,
]


@pytest.fixture(scope="module")
def index(spark):
    return context.index_of(spark.createDataFrame([(d,) for d in DOCS], "text string"))


def test_as_one_by_one(spark, index):
    runs = spark.createDataFrame([(i, c) for i, c in enumerate(CLAIMS)], "run_id int, output string")
    claimed = context.claims(runs, "run_id")
    got = {r["run_id"]: r for r in context.judged(claimed, index, "run_id", "n").collect()}
    said = {r["run_id"]: r for r in claimed.select("run_id", grounding.cued_years(F.col("s")).alias("years"), grounding.numbers(F.col("s")).alias("nums"), grounding.tokens(F.col("s")).alias("words")).collect()}
    facts = [r["f"] for r in spark.createDataFrame([(d,) for d in DOCS if d], "text string").select(grounding.context_facts(F.col("text")).alias("f")).collect()]
    assert set(got) == set(said) and len(got) >= 18
    for i, r in said.items():
        held = lambda t: any(t in f["lower"] for f in facts)
        near = lambda x, k: k["unit"] == x["unit"] and abs(k["value"] - x["value"]) / max(k["value"], x["value"], 1.0) <= 0.01
        words, pairs = r["words"], [" ".join(p) for p in itertools.pairwise(r["words"])]
        single = sum(map(held, words)) / len(words) if words else 1.0
        two = sum(map(held, pairs)) / len(pairs) if pairs else 0.0
        long = len(words) >= 4
        score, supported = (two, True) if long and two >= 0.55 else (single, single >= (0.60 if long else 0.55))
        expected = (sum(all(y not in f["years"] for f in facts) for y in r["years"]), sum(not any(near(x, k) for f in facts for k in f["numbers"]) for x in r["nums"]), round(score, 9), supported)
        assert (got[i]["bad_years"], got[i]["bad_nums"], round(got[i]["score"], 9), got[i]["supported"]) == expected, CLAIMS[i]
    assert any(r["flip"] for r in got.values()) and {r["bad_nums"] for r in got.values()} == {0, 1}


def test_steps_and_empty_tables(spark, index):
    runs = spark.createDataFrame([(i, c) for i, c in enumerate(CLAIMS)], "run_id int, output string")
    found = {r["run_id"]: r["step"] for r in context.ungrounded(context.claims(runs, "run_id"), index, "run_id", "n").collect()}
    assert found[CLAIMS.index("As of 2019 refunds take 30 days")] == "temporal" and found[CLAIMS.index("The dose is 506 mg")] == "numeric" and "overlap" in found.values() and "negation" in found.values()
    assert CLAIMS.index("The rate is 3.5% per year") not in found
    assert context.ungrounded(context.claims(runs.limit(0), "run_id"), index, "run_id", "n").count() == 0
    none = context.index_of(spark.createDataFrame([], "text string"))
    assert context.judged(context.claims(runs, "run_id"), none, "run_id", "n").filter("supported").count() <= 1
    assert not none.obliged and not none.limited


def test_no_cross_join(spark, index):
    runs = spark.createDataFrame([(1, CLAIMS[0])], "run_id int, output string")
    plan = context.judged(context.claims(runs, "run_id"), index, "run_id", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_stopwords_are_plain():
    assert isinstance(C.STOPWORDS, tuple) and "the" in C.STOPWORDS and len(C.STOPWORDS) == len(set(C.STOPWORDS))


def test_claims_split_only_texts_with_a_marker(spark):
    """The same sentences at the same places as by ``grounding.sentences``; the marker is looked for before a text is split."""
    texts = ["", None, "None here. Nor here!", " .  ;\t! As of 2019 it stands.\n\nThe value is 5  ? no; \u0085 based on the\x85", "AS PER.per the;as  of.x as of ", "it is set to\n. a!?b. Is Set To 4 "]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    every = rows.select("k", F.posexplode_outer(grounding.sentences(F.col("t"))).alias("n", "s")).filter("n is not null").filter(grounding.is_claim(F.col("s")))
    found = context.claims(rows, "k", "t")
    assert sorted(found.collect()) == sorted(every.collect()) and found.count() >= 6
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
    assert "RLIKE" in below
