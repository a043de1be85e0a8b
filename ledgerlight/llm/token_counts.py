"""Operator 7: token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, count) in the shared folder or wherever its path says. A
run joins the digests of its texts to it, encodes one text of each missing digest and appends what it has counted. A
new version of a tokenizer has another digest, so stale counts are never used.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; repeated rows and ties in doc_id give a row each;
an empty table gives an empty table; only the columns named are read, so further columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialise, read_table, scratch_path, slices, text_or_empty
from .words import drops_space, loaded, read_definition

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Rows that need no encoding are broadcast as an anti-join up to this count (a digest and an id each), else shuffled.
BROADCAST_ROWS = 1_000_000


def content(text: Column, space_free: bool) -> Column:
    """The normalised content: without outer blanks where the tokenizer drops white space anyway."""
    return F.trim(text) if space_free else text


def encoded_counts(df: DataFrame, path: str) -> DataFrame:
    """(content_digest, n_tokens) for rows (content_digest, text), by the library for the file at ``path``; no shuffle."""
    data, key = read_definition(path)
    shared = df.sparkSession.sparkContext.broadcast(data)
    piecewise = path.endswith(".model")

    def run(batches):
        if piecewise:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            tokenizer = loaded(key, shared)
            count = lambda texts: [len(x) // 4 for x in tokenizer.ids(texts)]
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(count(batch.column(1).to_pylist()), "i8"))], names=["content_digest", "n_tokens"])

    return df.select("content_digest", "text").mapInArrow(frugal(run, holds=True), "content_digest binary, n_tokens long")


def cached_counts(docs: DataFrame, path: str, cache_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of ``docs``; appends what was missing to the cache at ``cache_path``."""
    spark = docs.sparkSession
    data, version = read_definition(path)
    body = text_or_empty(text)
    keyed = docs.select(F.col(id_column).alias("__id"), F.unhex(F.sha2(content(body, not path.endswith(".model") and drops_space(data)), 256)).alias("content_digest"), body.alias("text"))
    rows = materialise(keyed.select("__id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "op7-digests")
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    except AnalysisException:
        known = spark.createDataFrame([], "content_digest binary, n_tokens long")
    #: One row speaks for each digest; its other rows, and those whose digest is known, need no encoding.
    first = rows.groupBy("content_digest").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1 and __first is not null")
    first = materialise(first, "op7-first")
    spare = rows.join(first, "content_digest").filter("not (__id <=> __first)").select("__id", "content_digest")
    spare = materialise(spare.union(rows.join(known, "content_digest", "left_semi").select("__id", "content_digest")), "op7-spare")
    small = spare.count() <= BROADCAST_ROWS
    same = keyed["__id"].eqNullSafe(spare["__id"]) & (keyed["content_digest"] == spare["content_digest"])
    misses = keyed.join(F.broadcast(spare) if small else spare, same, "left_anti").select("content_digest", "text")
    fresh = encoded_counts(misses, path).withColumn("tokenizer_digest", F.lit(version)).select("content_digest", "tokenizer_digest", "n_tokens")
    fresh.write.mode("append").parquet(cache_path)
    #: Rows with one id and one text twice, or appended by two runs at once, agree.
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = materialise(counts, "op7-counts")
    return rows.join(counts, "content_digest").select(F.col("__id").alias(id_column), "n_bytes", "n_tokens", "content_digest")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    counted = cached_counts(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "op7-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
