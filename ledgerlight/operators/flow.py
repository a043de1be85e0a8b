"""Staged pipelines over recorded runs: short circuit, lineage, summaries.

All need the stages of a pipeline in order, so one shuffle by pipeline serves windows and aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def pipeline_id(key: Column) -> Column:
    return F.concat(F.lit("pipe_"), F.substring(F.sha2(key.cast("string"), 256), 1, 12))


def in_order(pipeline: str = "pipeline_id", order: str = "ord"):
    return Window.partitionBy(pipeline).orderBy(order)


def with_errors(stages: DataFrame) -> DataFrame:
    """A stage that failed is blocked and critical in every mode, under an id of its own."""
    failed = F.col("error").isNotNull()
    return stages.withColumns(
        {
            "blocked": failed | F.col("blocked"),
            "risk_level": F.when(failed, "CRITICAL").otherwise(F.col("risk_level")),
            "audit_id": F.when(failed, F.concat(F.lit("error-"), F.col("audit_id"))).otherwise(F.col("audit_id")),
            "stage_error": F.when(failed, F.concat(F.lit('Stage "'), F.col("stage"), F.lit('" threw an exception: '), F.col("error"))),
        }
    )


def ran(stages: DataFrame, pipeline: str = "pipeline_id", order: str = "ord") -> DataFrame:
    """Stages up to and including the first blocked one."""
    before = in_order(pipeline, order).rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("__before", F.max(F.col("blocked").cast("int")).over(before)).filter(F.coalesce("__before", F.lit(0)) == 0).drop("__before")


def skipped(stages: DataFrame, pipeline: str = "pipeline_id", order: str = "ord") -> DataFrame:
    """Stages after the first blocked one."""
    before = in_order(pipeline, order).rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("__before", F.max(F.col("blocked").cast("int")).over(before)).filter(F.col("__before") == 1).drop("__before")


def with_lineage(stages: DataFrame, pipeline: str = "pipeline_id", order: str = "ord") -> DataFrame:
    """Adds parent_trace_id, the audit id of the stage before, and stage_input, what that stage returned."""
    w = in_order(pipeline, order)
    out = stages.withColumn("parent_trace_id", F.lag("audit_id").over(w))
    return out.withColumn("stage_input", F.lag("result").over(w)) if "result" in stages.columns else out


def summaries(stages: DataFrame, pipeline: str = "pipeline_id", order: str = "ord") -> DataFrame:
    """One row for each pipeline: stages (in order), short_circuited, blocked_at, total_duration_ms, of stages that ran."""
    s = ran(stages, pipeline, order)
    first = F.min(F.when(F.col("blocked"), F.struct(order, "stage")))
    stage = F.struct(order, "stage", "audit_id", "blocked", "risk_level", "duration_ms")
    return s.groupBy(pipeline).agg(
        F.sort_array(F.collect_list(stage)).alias("stages"),
        F.bool_or("blocked").alias("short_circuited"),
        first["stage"].alias("blocked_at"),
        F.sum("duration_ms").alias("total_duration_ms"),
    )


def hops(traces: DataFrame) -> DataFrame:
    """Each trace with its parent's id and stage: one step of lineage."""
    parent = traces.select(F.col("audit_id").alias("parent_trace_id"), F.col("stage").alias("parent_stage"))
    return traces.join(parent, "parent_trace_id", "left")


def ancestry(traces: DataFrame) -> DataFrame:
    """(audit_id, root_id, depth) by following parents to the first stage, however long the chain.

    Each round doubles the distance that a row has covered, so a chain of n stages takes log2(n) joins, and what hasn't
    reached a root after log2 of all rows leads into a circle of parents: it has no root and no depth (both null).
    """
    from ..sources.storage import checkpointed

    now = traces.select("audit_id", F.col("parent_trace_id").alias("up"), F.when(F.col("parent_trace_id").isNull(), 0).otherwise(1).alias("depth"))
    now = checkpointed(now.withColumn("open", F.col("up").isNotNull()))
    for _ in range(now.count().bit_length() + 1):
        above = now.select(F.col("audit_id").alias("at"), F.col("up").alias("up2"), F.col("depth").alias("further"))
        # A row whose ancestor has none above stands at its root already.
        moved = now.join(above, F.col("up") == F.col("at"), "left")
        now = checkpointed(moved.select("audit_id", F.when(F.col("up2").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"), (F.col("depth") + F.when(F.col("up2").isNull(), 0).otherwise(F.col("further"))).alias("depth"), F.col("up2").isNotNull().alias("open")))
        if now.filter("open").isEmpty():
            break
    return now.select("audit_id", F.when(~F.col("open"), F.coalesce("up", "audit_id")).alias("root_id"), F.when(~F.col("open"), F.col("depth")).alias("depth"))


def numbered_steps(steps: DataFrame, trace: str = "trace_id", order: str = "timestamp", tie: str = "step_id") -> DataFrame:
    """Adds step_index (from 0 within a trace) and last_action, that of the trace's last step."""
    w = Window.partitionBy(trace).orderBy(order, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return steps.withColumns({"step_index": F.row_number().over(w) - 1, "last_action": F.last("action").over(whole)})


def observed(stages: DataFrame, observation: Observation) -> DataFrame:
    """``stages``, whose counts the observation holds once any action has run over them: no pass of their own."""
    return stages.observe(observation, F.count("*").alias("stages"), F.count_if("blocked").alias("blocked"), F.sum("duration_ms").alias("total_ms"))


def lineage_table(summary: DataFrame, pipeline: str = "pipeline_id") -> DataFrame:
    """Stages of summaries as rows numbered from 1, each with the trace of the stage before it."""
    rows = summary.select(pipeline, F.posexplode("stages").alias("n", "s"), F.col("stages").alias("all"))
    parent = F.when(F.col("n") > 0, F.get("all", F.col("n") - 1)["audit_id"])
    return rows.select(pipeline, (F.col("n") + 1).alias("number"), "s.stage", "s.audit_id", parent.alias("parent_trace_id"), "s.blocked", "s.risk_level", "s.duration_ms")
