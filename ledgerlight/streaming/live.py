"""Streaming versions: the batch projections on streams, running counts, a keyed circuit breaker, chained ledgers.

Rule scans are stateless, so the batch functions take streaming DataFrames as they are. State is kept where order
matters: per pipeline for the breaker (one flag each), per ledger where its chain ends, per risk level for counts. Keyed
state lives in RocksDB: queries that are started here have it as their state store; a query that is started otherwise on
``breaker`` or ``ledger_lines`` must set spark.sql.streaming.stateStore.providerClass itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.extension import safe_callback
from ..operators.report import stats
from ..sources import ledger
from ..sources.storage import checkpointed, exists

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _started(spark: SparkSession, writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    """A query over everything available, or every so often; it takes the state store that is set as it starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(PROVIDER, before)


def files(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """A stream of Parquet files; new ones are picked up at each trigger."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ledger lines as they are appended in new files."""
    return spark.readStream.text(folder)


def to_files(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Start writing: everything available once, or every so often ("10 seconds"). ``on_batch`` may fail without harm."""
    if on_batch is None:
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        told = safe_callback(on_batch)

        def both(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={n}")  # the same batch again overwrites itself
            told(batch, n)

        writer = stream.writeStream.foreachBatch(both)
    return _started(stream.sparkSession, writer.option("checkpointLocation", checkpoint), every)


def running_stats(verdicts: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Counts by risk so far; each trigger replaces the table at ``path``."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    writer = stats(verdicts).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _started(verdicts.sparkSession, writer, every)


def windowed(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", *keys: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling windows, or sliding ones, with a watermark: rows count until it has passed their window's end."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, late: str, gap: str, *keys: str) -> DataFrame:
    """Counts in sessions that end after ``gap`` without a row of the keys, with a watermark."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped as late, by the progress that it still remembers."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def approved_in_time(verdicts: DataFrame, approvals: DataFrame, key: str = "run_id", time: str = "ts", given: str = "approved_at", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Verdicts with the approvals of two streams that came for them in time: the columns of verdicts, then ``approved_at``.

    A verdict comes out with each of its approvals as that arrives, or alone, with a null, once the watermarks tell that
    none can come any more; state on both sides is bounded by the interval.
    """
    v = verdicts.withWatermark(time, late).alias("v")
    a = approvals.select(F.col(key).alias("__key"), F.col(given).alias("__given")).withWatermark("__given", late).alias("a")
    in_time = (F.col(f"v.{key}") == F.col("a.__key")) & F.col("a.__given").between(F.col(f"v.{time}"), F.col(f"v.{time}") + F.expr(f"INTERVAL {within}"))
    return v.join(a, in_time, "left").select("v.*", F.col("a.__given").alias("approved_at"))


def _nulls_first(value) -> tuple:
    return (value is not None, value)


class _Breaker(StatefulProcessor):
    """One flag for each pipeline that was blocked, and a timer that ends it."""

    def __init__(self, timed: bool, idle_ms: int):
        self.timed, self.idle_ms = timed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.tripped = handle, handle.getValueState("tripped", "tripped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ran, latest = not self.tripped.exists(), 0
        for r in sorted(rows, key=lambda r: _nulls_first(r["ord"])):
            latest = max(latest, r["__ms"] or 0)
            yield Row(pipeline_id=r["pipeline_id"], ord=r["ord"], blocked=r["blocked"], ran=ran)
            ran = ran and not r["blocked"]
        if not ran:
            self.tripped.update((True,))
            if self.timed:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.tripped.clear()
        return iter(())


def breaker(stages: DataFrame, time: str | None = None, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """Adds ``ran``: false for stages that come after a blocked one of their pipeline, across batches.

    Needs pipeline_id, ord and blocked. Within a batch stages count in their order. Only blocked pipelines have state, one
    flag each. With a ``time`` column the flag goes once the watermark, ``late`` behind the latest stage of any pipeline,
    is ``idle_ms`` milliseconds past the pipeline's last stage, and stages behind the watermark don't count; without one
    it stays.
    """
    names = ["pipeline_id", "ord", "blocked"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stages.select(names).schema) + ", ran boolean"
    timed = stages.select(*names, F.lit(0).cast("long").alias("__ms"))
    if time is not None:
        timed = stages.withWatermark(time, late).select(*names, F.col(time).alias("__time"), F.unix_millis(time).alias("__ms"))
    return timed.groupBy("pipeline_id").transformWithState(_Breaker(time is not None, idle_ms), schema, "append", "none" if time is None else "eventTime")


class _Chain(StatefulProcessor):
    """Where each ledger's chain ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "prev_hash string, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        prev, seq = self.end.get() if self.end.exists() else (ledger.GENESIS, 0)
        for r in sorted(rows, key=lambda r: _nulls_first(r["o"])):
            line, digest = ledger.linked(r["json"], seq, prev)
            yield Row(ledger=key[0], seq=seq, prev_hash=prev, row_hash=digest, line=line)
            prev, seq = digest, seq + 1
        self.end.update((prev, seq))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.end.update((initialState["prev_hash"], initialState["seq"]))


def ledger_lines(records: DataFrame, by: str, order: str, json_column: str, state: DataFrame | None = None) -> DataFrame:
    """A stream of records as chained lines (ledger, seq, prev_hash, row_hash, line), as ``ledger.chained`` makes them.

    Within a batch a ledger's records count in their order. The ends of the chains are the query's state, which never goes:
    one hash and one number for each ledger. ``state`` (``ledger.chain_state``) is where they start in the first batch.
    """
    rows = records.select(ledger.ledger_key(F.col(by)).alias("ledger"), F.col(order).alias("o"), F.col(json_column).alias("json"))
    first = None if state is None else state.select("ledger", "prev_hash", "seq").groupBy("ledger")
    return rows.groupBy("ledger").transformWithState(_Chain(), "ledger string, seq bigint, prev_hash string, row_hash string, line string", "append", "none", first)


def to_ledger(records: DataFrame, path: str, checkpoint: str, by: str, order: str, json_column: str, every: str | None = None) -> StreamingQuery:
    """Start appending a stream of records to chained ledgers, one for each value of ``by``.

    Each batch is an append under its own id: one that comes again after a failure starts from the same state, gives the
    same lines, and is left out if they are there. A ledger that was begun otherwise is carried on when the query starts
    for the first time; while it runs nobody else may append.
    """
    spark = records.sparkSession
    new = not exists(spark, f"{checkpoint}/commits")
    begun = checkpointed(ledger.chain_state(ledger.lines(spark, path))) if new and exists(spark, path) else None
    chained = ledger_lines(records, by, order, json_column, begun)

    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, n: int) -> None:
        if any(done == f"{own}-{n}" for _, _, done in ledger.commits(spark, path)):
            batch.write.format("noop").mode("overwrite").save()  # its state must be worked out again all the same
        else:
            ledger.append(batch, path, append_id=f"{own}-{n}")

    return _started(spark, chained.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every)
