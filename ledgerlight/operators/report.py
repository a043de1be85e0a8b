"""Reports over verdicts and summaries: counts, feeds, search, distributions.

Counts are partial aggregates; feeds are top-k by line number, so no full sort happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISKS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def stats(verdicts: DataFrame) -> DataFrame:
    """(risk_level, total, blocked): counts by risk; totals are their sums."""
    return verdicts.groupBy("risk_level").agg(F.count("*").alias("total"), F.count_if("blocked").alias("blocked"))


def api_stats(verdicts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row: total, blocked, allowed, by risk (LOW if there is none), pipelines and short-circuited ones."""
    risk = F.coalesce(F.nullif("risk_level", F.lit("")), F.lit("LOW"))
    out = verdicts.agg(F.count("*").alias("total"), F.count_if("blocked").alias("blocked"), F.count_if(~F.col("blocked")).alias("allowed"), *[F.count_if(risk == r).alias(r.lower()) for r in RISKS])
    if summaries is None:
        return out.withColumns({"pipelines": F.lit(0).cast("bigint"), "short_circuited": F.lit(0).cast("bigint")})
    return out.crossJoin(summaries.agg(F.count("*").alias("pipelines"), F.count_if("short_circuited").alias("short_circuited")))  # one row each


def block_rate(verdicts: DataFrame) -> DataFrame:
    """One row: blocked runs as a rounded percentage, allowed ones as the rest; 0 without runs."""
    n, b = F.count("*"), F.count_if("blocked")
    return verdicts.agg(F.when(n == 0, 0).otherwise(F.floor(100 * b / n + 0.5)).cast("bigint").alias("block_rate"), F.when(n == 0, 0).otherwise(F.floor(100 * (n - b) / n + 0.5)).cast("bigint").alias("allow_rate"))


def risk_distribution(verdicts: DataFrame) -> DataFrame:
    """(risk_level, n, percent) for levels that occur."""
    n = verdicts.groupBy("risk_level").agg(F.count("*").alias("n"))  # at most a row for each level
    return n.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5).cast("bigint"))


def outcomes(verdicts: DataFrame) -> DataFrame:
    c = lambda e: F.count_if(e)
    return verdicts.agg(c(~F.col("blocked")).alias("allowed"), c(F.col("blocked")).alias("blocked"), c(F.col("risk_level") == "CRITICAL").alias("critical"), c(F.col("risk_level") == "HIGH").alias("high"))


def recent(verdicts: DataFrame, limit: int = 20, order: str = "line_no") -> DataFrame:
    """The last ``limit`` runs, newest first; 0 means all."""
    found = verdicts.orderBy(F.desc(order))
    return found.limit(limit) if limit else found


def blocked_recent(verdicts: DataFrame, limit: int = 50, order: str = "line_no") -> DataFrame:
    return recent(verdicts.filter("blocked"), limit, order)


def by_id(verdicts: DataFrame, audit_id: str, order: str = "line_no") -> DataFrame:
    return verdicts.filter(F.col("audit_id") == audit_id).orderBy(order).limit(1)


def by_pipeline(verdicts: DataFrame, pipeline_id: str, order: str = "line_no") -> DataFrame:
    return verdicts.filter(F.col("pipeline_id") == pipeline_id).orderBy(order)


def with_summary(verdicts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Runs beside the summary of their pipeline."""
    return verdicts.join(summaries, "pipeline_id")


def activity(verdicts: DataFrame, limit: int = 8, order: str = "line_no") -> DataFrame:
    """The latest runs in time's order: label T1.., allowed and blocked as 0 or 1."""
    last = verdicts.orderBy(F.desc(order)).limit(limit)
    n = F.row_number().over(Window.orderBy(order))  # ``limit`` rows
    return last.select(F.concat(F.lit("T"), n.cast("string")).alias("label"), (~F.col("blocked")).cast("int").alias("allowed"), F.col("blocked").cast("int").alias("blocked"))


def violation_feed(verdicts: DataFrame, limit: int = 6, order: str = "line_no") -> DataFrame:
    """The latest blocked runs that have violations: their first rule and 50 characters of its description."""
    v = F.element_at("violations", 1)
    found = verdicts.filter(F.col("blocked") & (F.size("violations") > 0)).orderBy(F.desc(order)).limit(limit)
    return found.select("audit_id", v["rule"].alias("rule"), F.substring(v["description"], 1, 50).alias("description"))


def with_rule(verdicts: DataFrame, rule: str) -> DataFrame:
    """Runs of which any violation is of the rule."""
    return verdicts.filter(F.exists("violations", lambda v: v["rule"] == rule))


def by_start(verdicts: DataFrame, start: str = "started_at", order: str = "line_no") -> DataFrame:
    """Runs in the order in which they started, those of one moment in the order of their lines."""
    return verdicts.orderBy(start, order)


def pipeline_feed(summaries: DataFrame, limit: int = 6, order: str = "line_no") -> DataFrame:
    """The latest pipelines: how many stages ran and where the pipeline was cut short."""
    last = summaries.orderBy(F.desc(order)).limit(limit)
    return last.select("pipeline_id", F.size("stages").cast("bigint").alias("n_stages"), "short_circuited", "blocked_at")


def search(verdicts: DataFrame, query: str = "", risk: str = "all") -> DataFrame:
    """Runs of a risk level whose id, agent, pipeline, action or any violation's rule or description holds the query."""
    q = query.lower()
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    text = has(F.col("audit_id")) | has(F.col("agent_name")) | has(F.col("pipeline_id")) | has(F.col("action"))
    found = text | F.coalesce(F.exists("violations", lambda v: has(v["rule"]) | has(v["description"])), F.lit(False))
    risky = F.lit(True) if risk == "all" else F.col("risk_level") == risk
    return verdicts.filter(risky & found) if q else verdicts.filter(risky)


def action_label() -> Column:
    """Agent, else the first rule's name in words, else the action, else a general label; empty texts count as missing."""
    rule = F.replace(F.regexp_replace(F.try_element_at("violations", F.lit(1))["rule"], "^((?:(?!block_).)*)block_", "$1"), F.lit("_"), F.lit(" "))
    return F.coalesce(F.nullif("agent_name", F.lit("")), F.nullif(rule, F.lit("")), F.nullif("action", F.lit("")), F.lit("Agent run"))


def chips() -> Column:
    """The first two rules and how many more there are."""
    more = F.greatest(F.size("violations") - 2, F.lit(0))
    names = F.array_join(F.transform(F.slice("violations", 1, 2), lambda v: v["rule"]), " ")
    return F.concat(names, F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def short_id(column: str, keep: int = 8) -> Column:
    c = F.col(column)
    return F.when(F.length(c) > keep + 1, F.concat(F.substring(c, 1, keep), F.lit("…"))).otherwise(c)


def time_ago(seconds: Column) -> Column:
    """Age in words: seconds, minutes, hours, days."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, part(1, "s")).when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def stat_delta(snapshots: DataFrame, order: str, value: str, key: str | None = None) -> DataFrame:
    """Change of a figure from one snapshot to the next."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(order)
    return snapshots.withColumn("delta", F.col(value) - F.lag(value).over(w))
