"""Operator 5: line de-duplication by distinct-site spread.

A line that many sites carry is boilerplate. Each line's hash gets a HyperLogLog sketch of its sites; sketches merge by
aggregation, so a common line never meets in one task. Estimates well above or below the threshold decide; for lines
near it the distinct sites are counted exactly. Every occurrence of a boilerplate line goes; other lines stay in place.

Lines compare by their trimmed, lower-case form with single spaces; all but blank ones are judged, short ones and those
of scripts without spaces too (``min_words`` above 1 exempts shorter lines). Defined results: blank lines always stay; a
null text stays null; null sites count as one site of their own; repeated rows are treated alike, and so are lines of
any length; an empty table gives an empty table; columns that aren't needed pass through unchanged whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, unused

#: Sites from which on a line is boilerplate, and words a line must have to be judged.
MIN_SITES, MIN_WORDS = 10, 1
#: log2 of the sketch's registers, and the relative error taken as near: four standard errors, 1.04 / sqrt(2^12) each.
LG_K, NEAR = 12, 0.065
#: Keys of boilerplate lines (16 bytes each) that are sent to the tasks; beyond that texts are joined with their keys.
BROADCAST_KEYS = 1_000_000


def normal_form(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def key_of(plain: Column) -> Column:
    """128 bits of a line's normal form: no two different lines of a corpus share them but by vanishing chance."""
    return F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit(1), plain).alias("b"))


def judged_lines(docs: DataFrame, row: Column, text: str, site: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, key, site) of each line with enough words, once for each row, by native functions."""
    plain = F.array_distinct(F.transform(F.split(F.col(text), "\n"), normal_form))
    one = docs.select(row.alias("row"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0none"))).alias("site"), F.explode_outer(plain).alias("line"))
    # The outer form, as below the inner one the optimizer tests the array's size, which would split all texts twice.
    enough = F.col("line") != "" if min_words <= 1 else F.size(F.split("line", " ")) >= min_words
    return one.filter(F.col("line").isNotNull() & (F.col("line") != "") & enough).select("row", "site", key_of(F.col("line")).alias("key")).select("row", "site", "key.a", "key.b")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (a, b) of lines on at least ``min_sites`` distinct sites."""
    met = lines.groupBy("a", "b").agg(F.count("*").alias("n"))
    repeated = materialise(met.filter(F.col("n") >= min_sites).select("a", "b"), "op5-repeated")
    some = lines.join(repeated, ["a", "b"], "left_semi")
    spread = some.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = materialise(spread.filter(F.col("sites") >= min_sites * (1 - NEAR) - 1), "op5-spread")
    sure = F.col("sites") > min_sites * (1 + NEAR) + 1
    near = materialise(spread.filter(~sure).select("a", "b"), "op5-near")
    exact = lines.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").count().filter(F.col("count") >= min_sites)
    return materialise(spread.filter(sure).select("a", "b").unionByName(exact.select("a", "b")), "op5-boilerplate")


def _flags_by_broadcast(spark: SparkSession, keys: pa.Table, a: Column, b: Column) -> Column:
    """An array of booleans for arrays of keys: which are among ``keys``, looked up by binary search."""
    wanted = np.sort(np.rec.fromarrays([keys.column("a").to_numpy(), keys.column("b").to_numpy()], names="a,b"), order=["a", "b"])
    shared = spark.sparkContext.broadcast((wanted.a.copy(), wanted.b.copy()))

    @F.arrow_udf("array<boolean>")
    def among(a: pa.Array, b: pa.Array) -> pa.Array:
        known_a, known_b = shared.value
        ours, theirs = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
        at, end = np.searchsorted(known_a, ours), np.searchsorted(known_a, ours, side="right")
        found = np.zeros(len(ours), bool)
        while (open_ := at < end).any():  # once, but for keys that share their first half
            found[open_] |= known_b[at[open_]] == theirs[open_]
            at = at + 1
        return pa.ListArray.from_arrays(a.offsets, pa.array(found), mask=a.is_null() if a.null_count else None)

    return among(a, b)


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, removed: str = "lines_removed") -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text`` and a new column ``removed`` (long): how many went.

    Up to ``BROADCAST_KEYS`` keys of boilerplate lines go to the tasks, and no text is shuffled. Beyond, lines to remove
    reach a document as keys: its own, joined by a hash of its text, so equal rows share them.
    """
    row = F.xxhash64(F.col(text), F.lit(5))
    lines = materialise(judged_lines(docs, row, text, site, min_words), "op5-lines")
    common = boilerplate(lines, min_sites)
    flags, cut, left, own, gone_keys = (unused(f"__{n}", docs) for n in ("flags", "cut", "left", "row", "gone"))
    split = F.split(F.col(text), "\n")
    # Lines that aren't judged have keys like the others, but none of these is among the boilerplate's.
    if common.count() <= BROADCAST_KEYS:
        plain = F.transform(split, normal_form)
        a, b = F.transform(plain, lambda x: key_of(x)["a"]), F.transform(plain, lambda x: key_of(x)["b"])
        flagged = docs.withColumn(flags, _flags_by_broadcast(docs.sparkSession, common.select("a", "b").toArrow(), F.coalesce(a, F.array().cast("array<bigint>")), F.coalesce(b, F.array().cast("array<bigint>"))))
        flagged = flagged.withColumn(cut, F.exists(flags, lambda x: x))
        stays = lambda x, i: ~F.get(flags, i)
    else:
        gone = lines.join(common, ["a", "b"]).select("row", "a", "b").distinct()
        gone = materialise(gone.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias(gone_keys)).withColumnRenamed("row", own), "op5-gone")
        flagged = docs.withColumn(own, row).join(gone, own, "left")
        flagged = flagged.withColumn(cut, F.col(gone_keys).isNotNull())
        stays = lambda x, i: ~F.array_contains(gone_keys, key_of(normal_form(x)))
    out = flagged.withColumn(left, F.when(F.col(cut), F.filter(split, stays)))
    count = F.when(F.col(cut), F.size(split) - F.size(left)).otherwise(0).cast("long")
    body = F.when(F.col(cut), F.array_join(left, "\n")).otherwise(F.col(text))
    kept = [body.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() != removed.lower()]
    return out.select(*kept, count.alias(removed))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return without_boilerplate(docs).select("doc_id", "lines_removed", "text")


OP5_SQL = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, source, line, i, lower(trim(regexp_replace(line, '\s+', ' ', 'g'), ' ')) AS key,
             trim(regexp_replace(line, '\s+', ' ', 'g'), ' ') <> '' AS judged FROM l),
b AS (SELECT key FROM k WHERE judged GROUP BY key HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
r AS (SELECT k.*, judged AND b.key IS NOT NULL AS gone FROM k LEFT JOIN b USING (key))
SELECT d.doc_id, coalesce(c.lines_removed, 0) AS lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS lines_removed,
                                   string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text FROM r GROUP BY doc_id) c USING (doc_id)
"""
