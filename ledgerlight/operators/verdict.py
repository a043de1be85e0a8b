"""Verdicts: risk, enforcement and the texts that go with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import SEVERITIES
from .scan import Options, Rule, once, output_text, resolve_rules, scanned_text, violations_of

MODES = ("enforce", "shadow", "degraded")
#: Rules for the check of inputs.
INPUT_RULES = ("block_prompt_injection", "block_pii_leakage")


def ordinal(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def max_severity(violations: Column) -> Column:
    """The highest severity; LOW for no violations."""
    top = F.array_max(F.transform(violations, lambda v: ordinal(v["severity"])))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(top, F.lit(1)))


def base_risk(n_steps: Column, total_ms: Column) -> Column:
    """Risk of a run without violations."""
    return F.when((n_steps > 10) | (total_ms > 30_000), "MEDIUM").otherwise("LOW")


def step_time(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["durationMs"].cast("long"), F.lit(0).cast("long")))


def severe(violations: Column) -> Column:
    return F.exists(violations, lambda v: v["severity"].isin("HIGH", "CRITICAL"))


def blocks(violations: Column, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return F.lit(False) if mode == "shadow" else severe(violations) if mode == "degraded" else F.size(violations) > 0


def explain_block(violations: Column, last_action: Column, audit_id: Column) -> Column:
    """The short report of a block, one line each."""
    rules = F.array_join(F.transform(violations, lambda v: F.concat(F.lit('"'), v["rule"], F.lit('"'))), ", ")
    null = F.lit("unknown")
    return F.concat_ws(
        "\n", F.lit("⛔ AGENT ACTION BLOCKED"), F.concat(F.lit("Violated rule(s): "), rules), F.concat(F.lit("Highest severity: "), max_severity(violations)),
        F.concat(F.lit('Action attempted: "'), F.coalesce(last_action, null), F.lit('"')), F.concat(F.lit("Audit ID: "), F.coalesce(audit_id, null)), F.lit("No action was taken. Human review required."),
    )


def explain_block_fully(violations: Column, last_action: Column, audit_id: Column, timestamp: Column) -> Column:
    """The long report: a bullet for each violation with its evidence (80 characters) and remedy."""
    filled = lambda c: c.isNotNull() & (c != "")
    bullet = lambda v: F.concat(
        F.lit("  • ["), v["severity"], F.lit('] Rule "'), v["rule"], F.lit('": '), v["description"],
        F.when(filled(v["evidence"]), F.concat(F.lit(" (Evidence: "), F.substring(v["evidence"], 1, 80), F.lit(")"))).otherwise(""),
        F.when(filled(v["remediation"]), F.concat(F.lit("\n    Remediation: "), v["remediation"])).otherwise(""),
    )
    return F.concat(
        F.lit('⛔ AGENT ACTION BLOCKED\n\nThe agent attempted to perform: "'), F.coalesce(last_action, F.lit("")), F.lit('"\nAudit ID: '), audit_id, F.lit("\nTimestamp: "), timestamp, F.lit("\n\nRule Violations ("),
        F.size(violations).cast("string"), F.lit("):\n"), F.array_join(F.transform(violations, bullet), "\n"), F.lit("\n\nNo action was taken. This event has been logged. Human review required."),
    )


def explain_allow(n_steps: Column) -> Column:
    return F.concat(F.lit("Agent completed task in "), n_steps.cast("string"), F.lit(" step(s). All accountability rules passed."))


def summarise(steps: Column) -> Column:
    """One line for each step of a trace."""
    line = lambda s: F.concat(F.lit("[Step "), (s["stepIndex"] + 1).cast("string"), F.lit("] "), s["action"], F.lit(" — "), s["durationMs"].cast("string"), F.lit("ms"))
    return F.when(F.size(steps) > 0, F.array_join(F.transform(steps, line), "\n")).otherwise("(no steps recorded)")


def evaluate(
    runs: DataFrame, rules: Iterable[str | Rule], mode: str = "enforce", options: Options | None = None, explain: bool = False,
    output: str = "output", n_steps: Column | None = None, total_ms: Column | None = None, last_action: Column | None = None, audit_id: Column | None = None,
) -> DataFrame:
    """``runs`` with violations, blocked, risk_level, degraded, reason, explanation and result. One narrow stage.

    Runs that failed (a column ``error`` that isn't null) have no verdict and are left out.
    """
    n_steps = F.lit(1) if n_steps is None else n_steps
    total_ms = F.lit(0) if total_ms is None else total_ms
    last_action = F.lit(None).cast("string") if last_action is None else last_action
    audit_id = F.lit(None).cast("string") if audit_id is None else audit_id
    rules = resolve_rules(rules)
    runs = runs.filter("error is null") if "error" in runs.columns else runs
    found = runs.withColumn("__text", output_text(runs, output)).withColumn("violations", once(violations_of(F.col("__text"), rules, options)))
    v = F.col("violations")
    blocked, any_found = blocks(v, mode), F.size(v) > 0
    passes = ~any_found | ~blocked
    return found.withColumns(
        {
            "blocked": any_found & blocked,
            "risk_level": F.when(any_found, max_severity(v)).otherwise(base_risk(n_steps, total_ms)),
            "degraded": any_found & ~blocked if mode == "degraded" else F.lit(False),
            "reason": F.when(any_found, explain_block(v, last_action, audit_id)),
            "explanation": F.when(~any_found, explain_allow(n_steps)) if explain or not rules else F.lit(None).cast("string"),
            "result": F.when(passes, F.col(output)),
        }
    ).drop("__text")


def lite_risk(violations: Column) -> Column:
    """The lite dialect knows no MEDIUM for violations."""
    return F.when(F.exists(violations, lambda v: v["severity"] == "CRITICAL"), "CRITICAL").otherwise("HIGH")


def check_input(inputs: DataFrame, column: str = "input") -> DataFrame:
    """``inputs`` with violations, blocked (a severe one, whatever the mode) and risk_level."""
    found = inputs.withColumn("violations", once(violations_of(scanned_text(column), INPUT_RULES)))
    return found.withColumn("blocked", severe(F.col("violations"))).withColumn("risk_level", max_severity(F.col("violations")))
