"""Operator 4: exact de-duplication by a log-structured merge index.

Level 0: each task gathers digests in a memtable and flushes it, when full, as a run of (digest, smallest id, count)
sorted by digest, cut into segments by digest range; each segment carries its filter, the sorted 32-bit fingerprints of
its digests. Compaction takes all segments of a range: digests whose fingerprint is in no other segment's filter and
that stand for one row are unique and stay where they are; the others are merged into level 1, where the smallest
identifier and the total count remain. Rows whose digest is in level 1 are hits: a Bloom filter over level 1 spares most
other texts the shuffle, each hit is compared byte by byte with the row that stays, and rows that differ (a digest
collision) are grouped by their bytes.

The Bloom filter takes ``FILTER_BITS`` a digest up to ``FILTER_BYTES`` in all; a larger index only makes it let more
texts pass, which the join by digest then sorts out: one way at every size, and the same result.

Defined results: null text counts as empty, so all null and empty texts are equal; each row gives a row, repeated ids
too (all rows with the smallest id of their text are kept); rows with a null id never stay unless all of their group
have one; texts of any length are hashed and compared whole; an empty table gives an empty table; only the columns
named are read, so further columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialise, read_table, scratch_path, text_or_empty

#: Rows in a memtable before it is flushed, and digests that a range of the index should hold.
MEMTABLE_ROWS, RANGE_ROWS = 200_000, 500_000
#: Filter bits for each digest, how many of them a digest sets, and the filter's greatest size, as it goes to all tasks.
FILTER_BITS, FILTER_HASHES, FILTER_BYTES = 16, 4, 64 << 20
#: A segment: its range, its filter, and its digests, ids and counts one after another; ids of null are marked.
SEGMENT = "range int, filter binary, digests binary, ids binary, no_id binary, counts binary"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def flush_runs(batches, ranges: int):
    """Memtables of rows (digest, id) to sorted runs in segments."""
    table: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(table).group_by("digest").aggregate([("doc_id", "min"), ("digest", "count")]).sort_by("digest")
        table.clear()
        digests = b"".join(t["digest"].to_pylist())
        no_id = t["doc_id_min"].is_null().to_numpy()
        columns = [t["doc_id_min"].fill_null(0).to_numpy(), no_id.astype("u1"), t["digest_count"].to_numpy()]
        words = np.frombuffer(digests, ">u4").reshape(-1, 8)
        place = (words[:, 0].astype("u8") * ranges >> 32).astype("i4")  # digests are sorted, so ranges follow one another
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        found = [(int(place[a]), np.unique(words[a:b, 1]).astype("<u4").tobytes(), digests[32 * a : 32 * b], *(c[a:b].tobytes() for c in columns)) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*found, strict=True))], names=["range", "filter", "digests", "ids", "no_id", "counts"])

    for batch in batches:
        if batch.num_rows:
            table.append(batch)
        if sum(b.num_rows for b in table) >= MEMTABLE_ROWS:
            yield flush()
    if table:
        yield flush()


def merged(segments: list[tuple]) -> pa.RecordBatch:
    """Level 1 of one range: digests of several rows, from segments (filter, digests, ids, no_id, counts)."""
    prints = np.concatenate([np.frombuffer(s[0], "<u4") for s in segments])
    prints, in_filters = np.unique(prints, return_counts=True)
    shared = prints[in_filters > 1]
    digests, ids, no_id, counts = [], [], [], []
    for _, d, i, no, n in segments:
        rows = np.frombuffer(d, ">u4").reshape(-1, 8)
        hit = np.isin(rows[:, 1], shared) | (np.frombuffer(n, "i8") > 1)
        digests.append(rows[hit])
        ids.append(np.frombuffer(i, "i8")[hit])
        no_id.append(np.frombuffer(no, "u1")[hit])
        counts.append(np.frombuffer(n, "i8")[hit])
    digests, ids, no_id, counts = (np.concatenate(x) for x in (digests, ids, no_id, counts))
    order = np.lexsort([ids, no_id, *digests.T[::-1]])
    digests, ids, no_id, counts = digests[order], ids[order], no_id[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (digests[1:] != digests[:-1]).any(1)])) if len(digests) else np.zeros(0, "i8")
    total = np.add.reduceat(counts, first) if len(first) else counts
    first, total = first[total > 1], total[total > 1]
    return pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in digests[first].astype(">u4")], pa.binary()), pa.array(ids[first], pa.int64(), mask=no_id[first] > 0), pa.array(total, pa.int64())], names=["digest", "keep_id", "n"])


def compacted(batches):
    """Segments sorted by range to level 1, one range at a time."""
    held, now = [], None
    for batch in batches:
        place, *parts = (c.to_pylist() for c in batch.columns)
        for r, *segment in zip(place, *parts, strict=True):
            if r != now and held:
                yield merged(held)
                held = []
            now = r
            held.append(tuple(segment))
    if held:
        yield merged(held)


class DigestIndex:
    """Runs at ``path``/level0, one write for each batch of documents; ``compact`` makes level 1 of them.

    ``rows`` is about how many rows the index will hold: it decides into how many ranges digests fall.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int):
        self.spark, self.path = spark, path
        self.ranges = min(1 << 20, max(math.ceil(rows / RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def append(self, keyed: DataFrame) -> None:
        """Flush rows (doc_id, digest) as level-0 runs."""
        ranges = self.ranges
        keyed.select("digest", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(frugal(lambda b: flush_runs(b, ranges)), SEGMENT).write.mode("append").parquet(f"{self.path}/level0")

    def compact(self) -> DataFrame:
        """(digest, keep_id, n) of digests of several rows. A run holds a digest once, so no key floods a task."""
        runs = self.spark.read.schema(SEGMENT).parquet(f"{self.path}/level0").repartition("range").sortWithinPartitions("range")
        return materialise(runs.mapInArrow(frugal(compacted), "digest binary, keep_id long, n long"), "op4-level1")


def positions(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]


def filter_of(digests: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter over a column ``digest`` and its number of bits."""
    bits = min(max(64, digests.count() * FILTER_BITS), 8 * FILTER_BYTES)
    words = (
        digests.select(F.explode(F.array(*positions(F.col("digest"), bits))).alias("p"))
        .groupBy(F.floor(F.col("p") / 64).cast("long").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    )
    out = np.zeros(bits // 64 + 1, "i8")
    for batch in words.toArrow().to_batches():  # at most FILTER_BYTES / 8 rows
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out, bits


def maybe_in(filter_words: np.ndarray, spark: SparkSession, digest: Column, bits: int) -> Column:
    shared = spark.sparkContext.broadcast(filter_words)

    @F.pandas_udf("boolean")
    def test(*at: pd.Series) -> pd.Series:
        words = shared.value
        return pd.Series(np.logical_and.reduce([(words[p.to_numpy() >> 6] >> (p.to_numpy() & 63)) & 1 == 1 for p in at]))

    return test(*positions(digest, bits))


def exact_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, digest) for each row."""
    spark = docs.sparkSession
    body = docs.select(F.col(id_column).alias("doc_id"), normalised(text).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    rows = materialise(body.select("doc_id", "digest"), "op4-digests")
    index = DigestIndex(spark, scratch_path(spark, "op4-index"), rows.count())
    index.append(rows)
    repeated = index.compact()
    words, bits = filter_of(repeated.select("digest"))
    hit = maybe_in(words, spark, F.col("digest"), bits)
    flagged = rows.withColumn("hit", hit)
    possible = body.withColumn("hit", hit).filter("hit").select("doc_id", "digest", "body")
    hits = materialise(possible.join(repeated, "digest"), "op4-hits")
    #: A row of each digest that stays, to compare the others with. A table of its own, so that a hot digest's hits can be split.
    stays = materialise(hits.filter("doc_id <=> keep_id").groupBy("digest").agg(F.min("body").alias("kept_body")), "op4-stays")
    compared = hits.join(stays, "digest", "left").select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest", F.coalesce(F.col("body") == F.col("kept_body"), F.lit(True)).alias("same"))
    compared = materialise(compared, "op4-compared")
    cols = ["doc_id", "keep_id", "group_size", "digest"]
    sized = compared.filter("same").select(cols)
    if not compared.filter("not same").isEmpty():
        sized = _collided(hits.join(compared.filter("not same").select("digest").distinct(), "digest", "left_semi")).select(cols).unionByName(
            sized.join(compared.filter("not same").select("digest").distinct(), "digest", "left_anti")
        )
    passed = flagged.filter("hit").join(repeated.select("digest"), "digest", "left_anti")
    single = flagged.filter("not hit").select("doc_id", "digest").unionByName(passed.select("doc_id", "digest"))
    single = single.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    return single.select(cols).unionByName(sized)


def _collided(hits: DataFrame) -> DataFrame:
    """Rows of digests that different texts share, grouped by their bytes."""
    groups = hits.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return hits.select("doc_id", "digest", "body").join(groups, ["digest", "body"])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
"""
