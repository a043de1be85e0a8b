"""A training corpus from raw documents: stages that each apply one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first four return the
columns of documents, the last the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import jaccard_join, line_dedup, packing, quality, toxicity
from ledgerlight.llm.common import columns_of, materialise, read_table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the scorer learns from labelled documents among them.

    Null and empty texts score 0 and stay, equal texts share a fate, repeated rows included, whatever their ids; texts of
    any length are scored whole; an empty table stays empty; further columns pass through, whatever their names.
    """
    scorer = toxicity.train(*toxicity.training_rows(docs, read_table(spark, sf_dir, "labels")))
    score = unused("score", docs)
    scored = toxicity.score(docs, scorer, docs.columns, into=score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*columns_of(docs))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer takes for good.

    Null and empty texts score 0 and go, equal texts share a fate, repeated rows included; texts of any length are scored
    whole; an empty table stays empty; further columns pass through, whatever their names.
    """
    score = unused("score", docs)
    scored = quality.score(docs, quality.train(docs), docs.columns, into=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*columns_of(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many sources carry; n_chars follows the text.

    Null and empty texts and blank lines stay as they are; null sources count as one; repeated rows stay and are treated
    alike; an empty table stays empty; further columns pass through, whatever their names.
    """
    removed = unused("lines_removed", docs)
    cut = line_dedup.without_boilerplate(docs, removed=removed)
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*columns_of(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row: of the smallest id, null ids last. Rows without words all stay.

    Rows go by id and whole text: of repeated rows one stays; an id with several texts loses only those that have a near
    copy elsewhere; an empty table stays empty; further columns pass through, whatever their names.
    """
    row = jaccard_join.ROW
    rows = materialise(jaccard_join.near_rows(docs).filter("class_node is not null").groupBy("class_node", *row).agg(F.count("*").alias("n")), "pipeline-near")
    winners = materialise(rows.groupBy("class_node").agg(jaccard_join.first_row().alias("w")).select("class_node", "w.*"), "pipeline-first")
    wins = (rows["class_node"] == winners["class_node"]) & jaccard_join.same_row(rows, winners)
    gone = materialise(rows.join(winners, wins, "left_anti").select(*row), "pipeline-gone")
    repeated = materialise(rows.filter("n > 1").join(winners, wins, "left_semi").select(*row), "pipeline-repeated")
    # The documents travel as one struct, so their columns' names meet none of ours.
    named = docs.select(F.struct(*columns_of(docs)).alias("__doc"), *jaccard_join.row_key())
    out = gone.unionByName(repeated)
    named = named.withColumn("__hit", jaccard_join.maybe_among(out))
    # Only rows that may go meet the list of those that do.
    some = materialise(named.filter("__hit"), "pipeline-possible")
    stay = named.filter("not __hit").select("__doc").unionByName(some.join(out, jaccard_join.same_row(some, out), "left_anti").select("__doc"))
    again = some.join(repeated, jaccard_join.same_row(some, repeated), "left_semi").groupBy(*row).agg(F.first("__doc").alias("__doc"))
    return stay.select("__doc.*").unionByName(again.select("__doc.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, in sequences of at most 2048 tokens, a row for each piece.

    Null and empty texts are a document of their end token; repeated rows are packed each; long texts are cut into pieces;
    an empty table gives an empty table; columns other than doc_id and text aren't read.
    """
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", one_of_each),
    ("packing", pack),
]

#: Learnt scores and packing can't be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
