"""Reports that are kept up to date: figures of each append, worked out once, and merged when asked for.

A poll reads the appends that have come since the one before and keeps, for each append and ledger, partial counts of
verdicts by risk and what the verifier must know of it: faults inside it, its first chained line and its last. Totals are
sums of these; whether one append links up with what stands before it is told from the few rows kept, in commit order. The
kept figures are appends themselves, so a poll that fails shows nothing, and of two at once one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ledger
from .storage import exists

PARTS = "append string, ledger string, commit bigint, total bigint, legacy bigint, broken bigint, gaps bigint, head struct<n:bigint,seq:bigint,prev_hash:string>, tail struct<n:bigint,seq:bigint,row_hash:string>, risks array<struct<risk_level:string,total:bigint,blocked:bigint>>"


def _kept(spark: SparkSession, kept: str) -> DataFrame:
    folders = [f"{kept}/{folder}" for _, folder, _ in ledger.commits(spark, kept)] if exists(spark, kept) else []
    return spark.read.schema(PARTS).parquet(*folders) if folders else spark.createDataFrame([], PARTS)


def parts(lines: DataFrame) -> DataFrame:
    """The figures of each append and ledger of ``ledger.numbered`` lines.

    Lines are judged in segments, as ``ledger.faults`` does, with a segment's own first chained line left open, and then
    the segments' ends are put in order.
    """
    p = ledger._links(lines, "append", "ledger", "commit", "n").withColumn("segment", F.floor(F.col("n") / ledger.SEGMENT))
    valid = ~F.col("corrupt") & ~F.col("legacy")
    inside = Window.partitionBy("append", "ledger", "commit", "segment").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    link = F.when(valid, F.struct("n", "seq", "row_hash"))
    p = p.withColumn("last", F.last(link, ignorenulls=True).over(inside))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    linked = valid & F.col("last").isNotNull()
    segments = p.groupBy("append", "ledger", "commit", "segment").agg(
        F.count("*").alias("total"), n(F.col("legacy")).alias("legacy"),
        (n(F.col("corrupt")) + n(F.col("bad_hash")) + n(linked & (F.col("prev_hash") != F.col("last.row_hash")))).alias("broken"),
        n(linked & (F.col("seq") != F.col("last.seq") + F.col("n") - F.col("last.n"))).alias("gaps"),
        F.min(F.when(valid, F.struct("n", "seq", "prev_hash"))).alias("head"), F.max(link).alias("tail"),
    )
    own = _linked_up(segments, Window.partitionBy("append", "ledger", "commit").orderBy("segment"), first_counts=False)
    whole = own.groupBy("append", "ledger", "commit").agg(*[F.sum(c).alias(c) for c in ("total", "legacy", "broken", "gaps")], F.min("head").alias("head"), F.max("tail").alias("tail"))
    r = ledger.traces(ledger.parsed(lines).filter("not corrupt").select("append", "ledger", "commit", "r._type", "r.risk_level", "r.blocked"))
    risks = r.groupBy("append", "ledger", "commit", "risk_level").agg(F.count("*").alias("total"), F.count_if(F.coalesce("blocked", F.lit(False))).alias("blocked"))
    risks = risks.groupBy("append", "ledger", "commit").agg(F.collect_list(F.struct("risk_level", "total", "blocked")).alias("risks"))
    null_safe = (F.col("w.append").eqNullSafe(F.col("r.append"))) & (F.col("w.ledger") == F.col("r.ledger")) & (F.col("w.commit") == F.col("r.commit"))
    return whole.alias("w").join(risks.alias("r"), null_safe, "left").select("w.*", "r.risks")


def _linked_up(rows: DataFrame, order, first_counts: bool) -> DataFrame:
    """``rows`` with the faults of their first chained line counted, by the last one of the rows before.

    ``n`` counts within an append; segments of one append share it, appends don't.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("total").over(before), F.lit(0)) if first_counts else F.lit(0)
    rows = rows.withColumn("base", base)
    placed = F.when(F.col("tail").isNotNull(), F.struct((F.col("base") + F.col("tail.n")).alias("n"), F.col("tail.seq").alias("seq"), F.col("tail.row_hash").alias("row_hash")))
    rows = rows.withColumn("placed", placed).withColumn("last", F.last("placed", ignorenulls=True).over(before))
    at = F.col("base") + F.col("head.n")
    seq = F.coalesce(F.col("last.seq") + at - F.col("last.n"), at if first_counts else F.lit(None))
    prev = F.coalesce(F.col("last.row_hash"), F.lit(ledger.GENESIS) if first_counts else F.lit(None))
    wrong = lambda c: F.coalesce((F.col("head").isNotNull() & c).cast("long"), F.lit(0))
    return rows.withColumns({"broken": F.col("broken") + wrong(F.col("head.prev_hash") != prev), "gaps": F.col("gaps") + wrong(F.col("head.seq") != seq)}).drop("base", "placed", "last")


def poll(spark: SparkSession, path: str, kept: str) -> int:
    """Work out the figures of the appends to the ledgers at ``path`` that ``kept`` doesn't have yet; how many there were.

    Only appends are kept; lines that no commit names are left to the full pass.
    """
    before = ledger.last_commit(spark, kept)
    known = {r[0] for r in _kept(spark, kept).select("append").distinct().collect()}
    new = {folder for _, folder, _ in ledger.commits(spark, path)} - known
    if new:
        found = parts(ledger.numbered(spark, path, but=known).filter("append is not null"))
        ledger.commit(spark, kept, lambda folder: found.write.parquet(folder), after=before)
    return len(new)


def stats(spark: SparkSession, kept: str) -> DataFrame:
    """(risk_level, total, blocked), as ``report.stats`` counts them, of all appends polled so far."""
    rows = _kept(spark, kept).select(F.explode("risks").alias("r")).select("r.*")
    return rows.groupBy("risk_level").agg(F.sum("total").alias("total"), F.sum("blocked").alias("blocked"))


def integrity(spark: SparkSession, kept: str) -> DataFrame:
    """What ``ledger.integrity`` says, of all appends polled so far."""
    rows = _linked_up(_kept(spark, kept), Window.partitionBy("ledger").orderBy("commit"), first_counts=True)
    sums = [F.sum(c).alias(name) for c, name in (("total", "total_records"), ("legacy", "legacy_records"), ("broken", "broken_links"), ("gaps", "sequence_gaps"))]
    return rows.groupBy("ledger").agg(*sums).withColumn("intact", (F.col("broken_links") == 0) & (F.col("sequence_gaps") == 0))
