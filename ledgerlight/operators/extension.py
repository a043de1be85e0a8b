"""Extension points: approvals, explainers, interception lists, callbacks."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import scan
from .flow import ran
from .scan import Options, approval, output_text

log = logging.getLogger(__name__)
#: Characters of an output that an explainer is shown.
MOST_OUTPUT = 800
# The calls that are recorded unless told otherwise.
INTERCEPTED = ("run", "execute", "invoke", "call", "generate", "chat", "complete", "query", "stream", "ask")


def intercepted(calls: DataFrame, methods: tuple[str, ...] = INTERCEPTED, action: str = "action") -> DataFrame:
    """Calls that are guarded; others pass through."""
    return calls.filter(F.col(action).isin(*methods))


def with_approvals(runs: DataFrame, approvals: DataFrame, options: Options | None = None, output: str = "output", key: str = "run_id") -> DataFrame:
    """Violations of the approval rule, less those that rows (key, kind: phrase or amount, approved) of ``approvals`` grant."""
    given = approvals.filter("approved").groupBy(key).agg(F.bool_or(F.col("kind") == "phrase").alias("__phrase"), F.bool_or(F.col("kind") == "amount").alias("__amount"))
    joined = runs.join(given, key, "left").withColumn("__text", output_text(runs, output))
    found = approval(F.col("__text"), options or Options(), F.col("__phrase"), F.col("__amount"))
    return joined.withColumn("violations", scan.once(found)).drop("__text", "__phrase", "__amount")


def approval_requests(runs: DataFrame, options: Options | None = None, output: str = "output", key: str = "run_id") -> DataFrame:
    """What a person must decide on: (key, kind, description)."""
    rows = scan.exploded(scan.scan(runs, ["require_human_approval"], options, output), key)
    return rows.select(key, F.when(rows["description"].startswith("High-impact"), "phrase").otherwise("amount").alias("kind"), "description")


def pandas_rule(name: str, check: Callable[[str], list[dict]], description: str = "") -> scan.Rule:
    """A rule whose ``check`` is Python; batches go through Arrow. A native rule (scan.make_rule) is the faster way."""

    @F.pandas_udf(f"array<{scan.VIOLATION}>")
    def run(texts: pd.Series) -> pd.Series:
        keys = ("rule", "description", "evidence", "severity", "remediation", "confidence")
        return texts.map(lambda t: [{"rule": name, **{k: v.get(k) for k in keys if k != "rule"}} for v in check(t)])

    return scan.Rule(name, lambda text, _: run(text), description)


class Explainer(Protocol):
    def explain_allow(self, text: str, n_steps: int, task: str | None, steps: list[tuple[str, int]]) -> str: ...

    def explain_block(self, rules: list[str], last_action: str | None) -> str: ...


@dataclass(frozen=True)
class ChatExplainer:
    """An explainer by a chat client that the caller brings: ``send(messages, model, base_url, max_tokens)`` gives a text.

    A service with the same protocol elsewhere is this one with another ``base_url`` (``dataclasses.replace``).
    """

    send: Callable[[list[dict], str, str, int], str]
    model: str
    base_url: str
    max_tokens: int = 300

    def _ask(self, task: str, content: str) -> str:
        return self.send([{"role": "system", "content": task}, {"role": "user", "content": content}], self.model, self.base_url, self.max_tokens)

    def explain_allow(self, text: str, n_steps: int, task: str | None = None, steps: Sequence[tuple[str, int]] = ()) -> str:
        taken = [f"{i}. {action}, {ms} ms" for i, (action, ms) in enumerate(steps, 1)] or ["none recorded"]
        content = "\n".join([f"Task: {json.dumps(task, ensure_ascii=False)}", f"Steps: {n_steps}", *taken, f"Output: {json.dumps(text, ensure_ascii=False)[:MOST_OUTPUT]}"])
        return self._ask("Say in two or three plain sentences, for a reader without technical knowledge, why an agent came to this output: what it weighed, how it reasoned, how sure it seems.", content)

    def explain_block(self, rules: list[str], last_action: str | None) -> str:
        return self._ask("Say plainly why this action of an agent was blocked, and name the rules that it broke.", f"Rules: {', '.join(rules)}\nAction: {last_action}")


def with_retry(call: Callable[[], str], retries: int = 2, wait_s: float = 0.6) -> str:
    """Calls again after 0.6 s, 1.2 s and so on; the last failure is raised."""
    for n in range(retries + 1):
        try:
            return call()
        except Exception:
            if n == retries:
                raise
            time.sleep(wait_s * 2**n)
    raise AssertionError


def explained(runs: DataFrame, explainer: Explainer, n_steps: Column, output: str = "output", retries: int = 2, task: Column | None = None, steps: Column | None = None) -> DataFrame:
    """Adds ``explanation`` by an outside explainer, batch by batch; a fixed text stands in where it fails or says nothing.

    ``task`` is what the run was asked for, ``steps`` an array of structs (action, duration_ms).
    """

    def one(text: str, n: int, asked: str | None, taken) -> str:
        done = f"Agent completed the task in {n} step(s). All accountability rules passed."
        plain = [] if taken is None else [(s["action"], s["duration_ms"]) for s in taken]
        try:
            return (with_retry(lambda: explainer.explain_allow(text, n, asked, plain), retries) or "").strip() or done
        except Exception:
            return f"{done} [Explanation unavailable]"

    @F.pandas_udf("string")
    def run(texts: pd.Series, counts: pd.Series, tasks: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(texts, counts, tasks, lists, strict=True)], dtype=object)

    none = F.lit(None).cast("array<struct<action:string,duration_ms:bigint>>")
    told = run(F.substring(output_text(runs, output), 1, MOST_OUTPUT), n_steps, F.lit(None).cast("string") if task is None else task.cast("string"), none if steps is None else steps)
    return runs.withColumn("explanation", told)


def explained_blocks(verdicts: DataFrame, explainer: Explainer, last_action: Column, retries: int = 2) -> DataFrame:
    """``explanation`` of blocked rows by an outside explainer, batch by batch; a fixed text stands in where it fails."""

    def one(rules, action) -> str | None:
        if rules is None:
            return None
        try:
            return with_retry(lambda: explainer.explain_block(list(rules), action), retries)
        except Exception:
            return f"Action BLOCKED. Violated rule(s): {', '.join(rules)}. Human review required."

    @F.pandas_udf("string")
    def run(rules: pd.Series, actions: pd.Series) -> pd.Series:
        return pd.Series([one(r, a) for r, a in zip(rules, actions, strict=True)], dtype=object)

    told = run(F.when(F.col("blocked"), F.transform("violations", lambda v: v["rule"])), last_action)
    other = F.col("explanation") if "explanation" in verdicts.columns else F.lit(None).cast("string")
    return verdicts.withColumn("explanation", F.when(F.col("blocked"), told).otherwise(other))


def resolve_explainer(explain: bool = True, configured: Explainer | None = None, custom: Explainer | None = None, environment: dict[str, str] | None = None, from_environment: Callable[[str], Explainer] | None = None) -> Explainer | None:
    """A custom explainer first, none if switched off, then a configured one, then one for the first key that is set."""
    if custom is not None:
        return custom
    if not explain:
        return None
    if configured is not None:
        return configured
    keys = [k for k in ("FEATHERLESS_API_KEY", "OPENAI_API_KEY", "ANTHROPIC_API_KEY") if (environment or {}).get(k)]
    return from_environment(keys[0]) if keys and from_environment else None


def safe_callback(callback: Callable[..., None]) -> Callable[..., None]:
    """A callback (for foreachBatch or after a write) whose errors are logged and don't end the job."""

    def run(*args) -> None:
        try:
            callback(*args)
        except Exception:
            log.exception("callback failed")

    return run


def tell_stages(stages: DataFrame, callback: Callable[[str, Row], None], pipeline: str = "pipeline_id", order: str = "ord", stage: str = "stage") -> None:
    """Calls ``callback(stage, row)`` for each stage that ran, a pipeline's in their order, where the rows are.

    Stages that the circuit breaker skipped aren't told; a callback's errors are logged and don't end the job. It runs in
    the tasks, and again if a task does, so it should send or write, not gather.
    """
    told = safe_callback(callback)

    def each(rows: Iterator[Row]) -> None:
        for row in rows:
            told(row[stage], row)

    ran(stages, pipeline, order).repartition(pipeline).sortWithinPartitions(pipeline, order).foreachPartition(each)
