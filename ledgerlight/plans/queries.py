"""Registered queries over the driver's tables: each applies an operator to whole tables and returns scalars."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..operators import context as K
from ..operators import entities as E
from ..operators import extension as X
from ..operators import flow, report, scan, verdict
from ..operators import grounding as G
from ..sources import ledger as L
from ..sources import rollup as R
from ..sources.storage import checkpointed, shared_folder, spread
from ..streaming import live
from . import fixtures
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
OPTIONS = scan.Options(context=fixtures.CONTEXT)
SHORT = {
    "pii_violations": "block_pii_leakage", "rule_special": "block_special_category_data", "rule_manipulation": "block_manipulation", "rule_harmful": "block_harmful_content",
    "rule_medical": "block_medical_advice", "rule_legal": "block_legal_advice", "rule_financial": "block_financial_advice", "rule_discrimination": "block_discriminatory_output",
    "rule_injection": "block_prompt_injection", "rule_leakage": "block_system_prompt_leakage", "rule_identity": "block_ai_identity_deception", "rule_approval": "require_human_approval",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned(spark: SparkSession, sf_dir: str, rules: tuple[str, ...]) -> DataFrame:
    return scan.scan(fixtures.runs(spark, sf_dir), rules, OPTIONS)


def verdicts(spark: SparkSession, sf_dir: str, mode: str = "enforce", rules: tuple[str, ...] = C.RULES) -> DataFrame:
    """Verdicts on all runs, with the columns that reports read; a run's key stands for its line."""
    return verdicts_on(fixtures.runs(spark, sf_dir), mode, rules)


def verdicts_on(runs: DataFrame, mode: str = "enforce", rules: tuple[str, ...] = C.RULES) -> DataFrame:
    runs = runs.withColumns({"audit_id": F.concat(F.lit("run-"), F.col("run_id").cast("string")), "line_no": F.col("run_id")})
    return verdict.evaluate(runs, rules, mode, OPTIONS, n_steps=F.col("n_steps"), total_ms=F.col("total_ms"), last_action=F.col("action"), audit_id=F.col("audit_id"), explain=True)


def _rule(rule: str) -> Query:
    return lambda spark, sf: scan.exploded(scanned(spark, sf, (rule,)), "run_id").select("run_id", F.col("ord").cast("int"), "severity", "description", "evidence")


def _long(rules: tuple[str, ...]) -> Query:
    return lambda spark, sf: scan.exploded(scanned(spark, sf, rules), "run_id").select("run_id", F.col("ord").cast("int"), "rule", "severity", "evidence")


def _verdict(mode: str) -> Query:
    return lambda spark, sf: verdicts(spark, sf, mode).select("audit_id", "blocked", "degraded", "risk_level", F.size("violations").cast("bigint").alias("n_violations"), F.col("result").isNotNull().alias("has_result"))


def _pii_counts(name: str, key: str, text: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        counts = {k: F.size(scan.pii_matches(F.col("t"), k)).cast("bigint") for k in C.PII_TEXTS}
        return spread(table(spark, sf, name).select(key, text), key).select(key, scan.scanned_text(text).alias("t")).select(key, *[c.alias(k) for k, c in counts.items()])

    return run


def _pii_sql(name: str, key: str, text: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"len({O.matches(k, 't')}) AS {k}" for k in C.PII_TEXTS) + f" FROM (SELECT {key}, coalesce({text}, 'null') AS t FROM {name})"


def document_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: personal data in whole documents, verdicts by risk level."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return report.stats(verdict.evaluate(docs, ["block_pii_leakage"], output="text"))


DOCUMENT_VERDICTS_SQL = f"""
WITH d AS (SELECT doc_id AS run_id, coalesce(text, 'null') AS output FROM documents), v AS ({O.pii_rows('d')}),
r AS (SELECT run_id, max({O.RANK}) AS top FROM v GROUP BY run_id), s AS (SELECT d.run_id, r.top FROM d LEFT JOIN r ON d.run_id = r.run_id)
SELECT coalesce(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][top], 'LOW') AS risk_level, count(*) AS total, count(*) FILTER (WHERE top IS NOT NULL) AS blocked FROM s GROUP BY 1
"""


def luhn_cards(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.explode(scan.all_matches(scan.scanned_text("text"), C.PII["cc"])).alias("card"))
    return found.select("doc_id", "card", scan.luhn(F.col("card")).alias("valid"))


LUHN_SQL = f"SELECT doc_id, card, {O.LUHN.format(n='card')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, {O.p(C.PII['cc'])}, 0)) AS card FROM documents)"


def base_risk(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events of a day as the steps of a run."""
    steps = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_steps"), F.sum(F.floor("value").cast("bigint") * 100).alias("total_ms"))
    return steps.select("user_id", F.col("day").cast("string").alias("day"), "n_steps", "total_ms", verdict.base_risk(F.col("n_steps"), F.col("total_ms")).alias("risk_level"))


BASE_RISK_SQL = """
WITH s AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_steps, CAST(sum(CAST(floor(value) AS BIGINT) * 100) AS BIGINT) AS total_ms FROM events GROUP BY 1, 2)
SELECT *, CASE WHEN n_steps > 10 OR total_ms > 30000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s
"""


def input_check(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("input"))
    runs = fixtures.runs(spark, sf).select(F.concat(F.lit("r-"), F.col("run_id").cast("string")).alias("id"), F.col("output").alias("input"))
    return verdict.check_input(asked.unionByName(runs)).select("id", "blocked", "risk_level", F.size("violations").cast("bigint").alias("n_violations"))


INPUT_SQL = f"""
WITH runs0 AS ({fixtures.RUNS_SQL}),
runs AS (SELECT 'c-' || conv_id || '-' || turn AS run_id, coalesce(text, 'null') AS output FROM conversations WHERE role = 'user' UNION ALL SELECT 'r-' || run_id, output FROM runs0),
v AS (SELECT run_id, severity FROM ({O.group_rows('block_prompt_injection')}) UNION ALL SELECT run_id, severity FROM ({O.pii_rows()})),
a AS (SELECT run_id, count(*) AS n, max({O.RANK}) AS top FROM v GROUP BY run_id)
SELECT runs.run_id AS id, coalesce(top, 0) >= 3 AS blocked, coalesce(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][top], 'LOW') AS risk_level, coalesce(n, 0) AS n_violations FROM runs LEFT JOIN a ON runs.run_id = a.run_id
"""


def claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    runs = fixtures.runs(spark, sf)
    said = runs.select("run_id", F.posexplode_outer(G.sentences(F.col("output"))).alias("n", "s")).filter("n is not null")
    facts = G.context_facts(F.lit(" ".join(fixtures.CONTEXT)))
    return said.filter(G.is_claim(F.col("s"))).withColumn("facts", facts)


def claim_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return claim_rows(spark, sf).select("run_id", F.col("n").cast("bigint").alias("n"), F.col("s").alias("sentence"))


def grounding_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What each step says of each claim, whichever comes first."""
    s, f = F.col("s"), F.col("facts")
    return claim_rows(spark, sf).select(
        "run_id", F.col("n").cast("bigint").alias("n"),
        F.size(F.array_except(G.cued_years(s), f["years"])).cast("bigint").alias("bad_years"),
        F.size(G.ungrounded(G.numbers(s), f["numbers"])).cast("bigint").alias("bad_nums"),
        G.negates(s, f["obliged"], f["limited"]).alias("flip"),
        F.round(G.overlap(s, f["lower"])["score"], 6).alias("score"),
        G.overlap(s, f["lower"])["supported"].alias("supported"),
    )


def _step(filter_sql: str, *columns: str) -> Query:
    return lambda spark, sf: grounding_steps(spark, sf).filter(filter_sql).select("run_id", "n", *columns)


def grounding_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.exploded(scanned(spark, sf, ("block_hallucination",)), "run_id")
    return rows.select("run_id", F.col("ord").cast("int").alias("g"), "severity", "evidence", F.col("confidence"))


def grounding_by_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context by key: each order status has a context of its own, joined as a column."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    contexts = spark.createDataFrame([("F", fixtures.CONTEXT[0]), ("O", fixtures.CONTEXT[1])], "status string, context string")
    runs = fixtures.runs(spark, sf).join(orders, "run_id").join(F.broadcast(contexts), "status", "left")  # two rows
    return runs.select("run_id", "status", F.size(G.grounded_against(F.col("output"), F.col("context"))).cast("bigint").alias("n_violations"))


GROUNDING_BY_CONTEXT_SQL = f"""{O.runs()}, {", ".join(f"{status} AS (WITH {O.grounding_ctes((fixtures.CONTEXT[i],))} SELECT run_id, count(*) AS n FROM grounded GROUP BY 1)" for i, status in enumerate(("by_f", "by_o")))}
SELECT r.run_id, o_orderstatus AS status, coalesce(CASE o_orderstatus WHEN 'F' THEN by_f.n WHEN 'O' THEN by_o.n END, 0) AS n_violations
FROM runs r JOIN orders ON r.run_id = o_orderkey LEFT JOIN by_f ON r.run_id = by_f.run_id LEFT JOIN by_o ON r.run_id = by_o.run_id
"""


def grounding_by_document(spark: SparkSession, sf: str) -> DataFrame:
    """The claims of documents, held against the table of benchmark passages."""
    claimed = K.claims(spread(table(spark, sf, "documents"), "doc_id"), "doc_id", "text")
    found = K.judged(claimed, K.index_of(table(spark, sf, "benchmark")), "doc_id", "n")
    return found.select("doc_id", F.col("n").cast("bigint").alias("n"), "bad_years", "bad_nums", "flip", F.round("score", 6).alias("score"), "supported")


#: What runs ask for, by their keys; one name is an alias, one is nobody's.
RULE_LISTS = (
    ("block_pii_leakage", "require_human_approval"),
    ("require_human_approval", "block_discrimination_output", "no_such_rule"),
    ("block_harmful_content", "block_hallucination", "block_manipulation"),
    ("block_financial_advice", "block_special_category_data", "block_prompt_injection", "block_legal_advice"),
    (),
)


def _asking(spark: SparkSession, sf: str) -> DataFrame:
    lists = F.array(*[F.array(*[F.lit(n) for n in names]).cast("array<string>") for names in RULE_LISTS])
    return fixtures.runs(spark, sf).withColumn("rules", F.element_at(lists, (F.col("run_id") % len(RULE_LISTS) + 1).cast("int")))


def rules_per_run(spark: SparkSession, sf: str) -> DataFrame:
    """Each run by the rules that it names itself."""
    rows = scan.exploded(scan.scan_named(_asking(spark, sf), options=OPTIONS), "run_id")
    return rows.select("run_id", F.col("ord").cast("int"), "rule", "severity", "evidence")


def unknown_rules(spark: SparkSession, sf: str) -> DataFrame:
    return scan.unknown_names(_asking(spark, sf), "run_id")


def _rules_per_run_sql() -> str:
    parts = []
    for i, names in enumerate(RULE_LISTS):
        for j, rule in enumerate(C.ALIASES.get(n, n) for n in names if n != "no_such_rule"):
            rows = O.rule_rows(rule) if rule != "block_hallucination" else "SELECT run_id, g, severity, evidence FROM grounded"
            parts.append(f"SELECT run_id, {j} AS r, g, {O.quoted(rule)} AS rule, severity, evidence FROM ({rows}) WHERE run_id % {len(RULE_LISTS)} = {i}")
    return f"{O.runs(O.grounding_ctes(), 'v AS (' + ' UNION ALL '.join(parts) + ')')} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY r, g) - 1 AS INT) AS ord, rule, severity, evidence FROM v"


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as stages: a turn is blocked when its number and conversation say so, some fail."""
    c = table(spark, sf, "conversations")
    made = c.select(
        F.col("conv_id").alias("pipeline_id"), F.col("turn").alias("ord"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("stage"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("audit_id"),
        ((F.col("conv_id") + F.col("turn") * 3) % 7 == 0).alias("blocked"), F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "timeout").alias("error"), F.lit("LOW").alias("risk_level"),
        F.length("text").cast("bigint").alias("duration_ms"),
    )
    return flow.with_errors(made)


STAGED = """st AS (SELECT conv_id AS pipeline_id, turn AS ord, 't' || turn AS stage, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'error-' ELSE '' END || conv_id || '-' || turn AS audit_id,
 (conv_id + turn * 3) % 7 = 0 OR (conv_id + turn) % 11 = 0 AS blocked, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'CRITICAL' ELSE 'LOW' END AS risk_level, CAST(length(text) AS BIGINT) AS duration_ms FROM conversations),
m AS (SELECT *, coalesce(max(blocked::INT) OVER (PARTITION BY pipeline_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st),
ran AS (SELECT * EXCLUDE (before) FROM m WHERE before = 0)"""


def short_circuit(spark: SparkSession, sf: str) -> DataFrame:
    return flow.ran(staged(spark, sf)).select("pipeline_id", "ord", "stage", "audit_id", "blocked", "risk_level")


def skipped_stages(spark: SparkSession, sf: str) -> DataFrame:
    return flow.skipped(staged(spark, sf)).select("pipeline_id", "ord", "stage")


def lineage_hops(spark: SparkSession, sf: str) -> DataFrame:
    return flow.hops(flow.with_lineage(flow.ran(staged(spark, sf)))).select("audit_id", "parent_trace_id", "parent_stage")


def lineage_recursive(spark: SparkSession, sf: str) -> DataFrame:
    found = flow.ancestry(flow.with_lineage(flow.ran(staged(spark, sf))))
    return found.select("audit_id", "root_id", F.col("depth").cast("bigint").alias("depth"))


def pipeline_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = flow.summaries(staged(spark, sf))
    return s.select("pipeline_id", F.size("stages").cast("bigint").alias("n_stages"), F.array_join(F.transform("stages", lambda x: x["stage"]), ",").alias("stage_names"), "short_circuited", "blocked_at", "total_duration_ms")


def lineage_table(spark: SparkSession, sf: str) -> DataFrame:
    return flow.lineage_table(flow.summaries(staged(spark, sf)))


def stage_entities(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract(E.stage_outputs(fixtures.stages(spark, sf)))


def _entities(kind: str) -> Query:
    return lambda spark, sf: stage_entities(spark, sf).filter(F.col("type") == kind).select("pipeline_id", "stage", "value", "raw")


def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return E.contradictions(stage_entities(spark, sf))


def consistency_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.consistency(E.stage_outputs(fixtures.stages(spark, sf)))


PAYLOAD = "'{\"id\":\"o' || cast(o_orderkey as varchar(20)) || '\",\"amount\":' || cast(cast(floor(o_totalprice) as bigint) as varchar(20)) || '}'"


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("ledger"), "o_orderkey", F.expr(PAYLOAD).alias("json"))
    return L.chained(rows, "ledger", "o_orderkey", "json")


def ledger_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).select("ledger", "seq", "prev_hash", "row_hash")


CHAIN = f"""RECURSIVE o AS (SELECT CAST(o_custkey AS VARCHAR) AS ledger, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, {PAYLOAD} AS json FROM orders),
c AS (SELECT ledger, seq, repeat('0', 64) AS prev_hash, sha256(json[:-2] || ',"seq":0,"prev_hash":"' || repeat('0', 64) || '"}}') AS row_hash, json FROM o WHERE seq = 0
      UNION ALL SELECT o.ledger, o.seq, c.row_hash, sha256(o.json[:-2] || ',"seq":' || o.seq || ',"prev_hash":"' || c.row_hash || '"}}'), o.json FROM c JOIN o ON o.ledger = c.ledger AND o.seq = c.seq + 1)"""
#: Tampering by the numbers: lines that go, that change, that break, and that lose their chain.
TAMPER = """
CASE WHEN seq % 11 = 5 THEN replace(line, '"amount":', '"amount":9') WHEN seq % 13 = 7 THEN '{broken' WHEN seq % 17 = 3 THEN '{"id":"old","amount":1}' ELSE line END
"""


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chain(spark, sf).filter("not (cast(ledger as bigint) % 3 = 0 and seq % 5 = 4)")
    changed = rows.withColumn("line", F.when(F.col("ledger").cast("bigint") % 2 == 0, F.col("line")).otherwise(F.expr(TAMPER)))
    w = flow.Window.partitionBy("ledger").orderBy("seq")
    return changed.select("ledger", (F.row_number().over(w) - 1).alias("line_no"), "line")


def ledger_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Each line at fault and why."""
    f = L.faults(tampered(spark, sf)).filter("corrupt or gap or bad_link or bad_hash")
    return f.select("ledger", "line_no", "expected_seq", "corrupt", "gap", "bad_link", "bad_hash")


def chain_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Where each ledger would be written on."""
    return L.chain_state(_chain(spark, sf).select("ledger", F.col("seq").alias("line_no"), "line"))


def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    return L.integrity(tampered(spark, sf))


FAULTS = f"""
WITH {CHAIN},
l AS (SELECT *, json[:-2] || ',"seq":' || seq || ',"prev_hash":"' || prev_hash || '","row_hash":"' || row_hash || '"}}' AS line FROM c WHERE NOT (CAST(ledger AS BIGINT) % 3 = 0 AND seq % 5 = 4)),
t AS (SELECT ledger, row_number() OVER (PARTITION BY ledger ORDER BY seq) - 1 AS line_no, CASE WHEN CAST(ledger AS BIGINT) % 2 = 0 THEN line ELSE {TAMPER} END AS line FROM l),
j AS (SELECT *, line = '{{broken' AS corrupt, CASE WHEN line <> '{{broken' THEN json_extract_string(line, '$.row_hash') END AS rh, CASE WHEN line <> '{{broken' THEN json_extract_string(line, '$.prev_hash') END AS ph, CASE WHEN line <> '{{broken' THEN CAST(json_extract_string(line, '$.seq') AS BIGINT) END AS sq FROM t),
g AS (SELECT *, NOT corrupt AND rh IS NULL AS legacy, rh IS NOT NULL AS valid FROM j),
w AS (SELECT *, last_value(CASE WHEN valid THEN {{'h': rh, 's': sq, 'n': line_no}} END IGNORE NULLS) OVER (PARTITION BY ledger ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM g),
f AS (SELECT *, valid AND sq <> coalesce(last.s + line_no - last.n, line_no) AS gap, valid AND ph <> coalesce(last.h, repeat('0', 64)) AS bad_link,
      valid AND sha256(regexp_replace(line, ',"row_hash":"[^"]*"\\}}$', '') || '}}') <> rh AS bad_hash FROM w)
"""
LEDGER_VERIFY_SQL = FAULTS + """SELECT ledger, count(*) AS total_records, count(*) FILTER (WHERE legacy) AS legacy_records, count(*) FILTER (WHERE corrupt) + count(*) FILTER (WHERE bad_link) + count(*) FILTER (WHERE bad_hash) AS broken_links,
       count(*) FILTER (WHERE gap) AS sequence_gaps, count(*) FILTER (WHERE corrupt OR bad_link OR bad_hash OR gap) = 0 AS intact FROM f GROUP BY ledger
"""


def ledger_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written as chained lines, customers dealt out over the ledgers, read again and verified.

    Orders are dealt out before they are judged, and lines are compressed: all but the links of lines is on disk once.
    """
    orders = table(spark, sf, "orders").withColumn("ledger", F.concat(F.lit("c-"), (F.col("o_custkey") % 500).cast("string")))
    v = verdicts_on(fixtures.runs_of(L.gathered(orders, "ledger", "o_orderkey"), "ledger")).withColumn("id", F.col("audit_id"))
    kept = v.withColumn("json", L.payload(v, ["id", "blocked", "risk_level", "reason", "violations", "agent_name"]))
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    L.append(L.chained(kept, "ledger", "line_no", "json", gathered=True), path, gathered=True, compression="gzip")
    raw = L.lines(spark, path)
    good = L.integrity(raw).agg(F.sum("total_records").alias("total_records"), F.bool_and("intact").alias("intact"))
    back = L.traces(L.records(L.parsed(raw).filter("not corrupt"))).agg(F.count("*").alias("traces"), F.count_if("blocked").alias("blocked"))
    return good.crossJoin(back)  # one row each


LEDGER_ROUNDTRIP_SQL = O.on_verdicts("SELECT CAST(count(*) AS BIGINT) AS total_records, true AS intact, count(*) AS traces, count(*) FILTER (WHERE blocked) AS blocked FROM verdicts")


def summaries(spark: SparkSession, sf: str, judged: DataFrame | None = None) -> DataFrame:
    v = (verdicts(spark, sf) if judged is None else judged).select("pipeline_id", F.col("line_no").alias("ord"), F.col("audit_id").alias("stage"), "audit_id", "blocked", "risk_level", F.col("total_ms").alias("duration_ms"))
    return flow.summaries(v)


def judged_once(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts without their texts, written down: a query that reads them twice scans outputs once."""
    return checkpointed(verdicts(spark, sf).select("audit_id", "pipeline_id", "line_no", "blocked", "risk_level", "total_ms"))


def api_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = judged_once(spark, sf)
    return report.api_stats(v, summaries(spark, sf, v))


def with_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = judged_once(spark, sf)
    return report.with_summary(v, summaries(spark, sf, v)).select("audit_id", "short_circuited", "blocked_at")


def pipeline_feed(spark: SparkSession, sf: str) -> DataFrame:
    return report.pipeline_feed(summaries(spark, sf), order="pipeline_id")


def _plain_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ledger records: twenty ledgers, a third of the rows in one of them."""
    o = fixtures.orders_of(spark, sf)
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit("main + 1")).otherwise(F.concat(F.lit("l:"), (F.col("o_custkey") % 20).cast("string")))
    return o.select(key.alias("ledger"), F.col("o_orderkey").alias("o"), F.concat(F.lit('{"id":"t'), F.col("o_orderkey").cast("string"), F.lit('","blocked":'), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"), F.lit(',"created_at":"2024"}')).alias("json"))


_LEDGER_KEY = "CASE WHEN o_orderkey % 3 = 0 THEN 'main + 1' ELSE 'l:' || CAST(o_custkey % 20 AS BIGINT) END"


def _appended_twice(spark: SparkSession, sf: str, second: DataFrame) -> str:
    """Path of ledgers whose even orders were appended first, and carried on by ``second``."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    done = L.append(L.chained(_plain_rows(spark, sf).filter("o % 2 = 0"), "ledger", "o", "json"), path)
    L.append(L.chained(second, "ledger", "o", "json", L.chain_state(L.lines(spark, path))), path, after=done)
    return path


def ledger_append_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Append, carry on from the ledger's state, append, verify."""
    return L.integrity(L.lines(spark, _appended_twice(spark, sf, _plain_rows(spark, sf).filter("o % 2 = 1"))))


def ledger_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Traces, then a summary for each ledger's runs in the same chain: both read apart, all verified."""
    rows = _plain_rows(spark, sf)
    done = rows.groupBy("ledger").agg(F.count("*").alias("total_duration_ms"), F.lit(False).alias("short_circuited"), F.max("o").alias("o")).withColumn("pipeline_id", F.concat(F.lit("p-"), F.col("ledger")))
    done = done.withColumn("json", L.summary_payload(done, ["pipeline_id", "short_circuited", "total_duration_ms"])).select("ledger", F.lit(1 << 40).cast("bigint").alias("o"), "json")
    path = _appended_twice(spark, sf, rows.filter("o % 2 = 1").select("ledger", F.col("o").cast("bigint").alias("o"), "json").unionByName(done))
    back = L.read(spark, path, strict=True)
    seen = L.verdict_rows(back).filter("timestamp = '2024'").groupBy("ledger").agg(F.count("*").alias("traces"), F.count_if("blocked").alias("blocked"))
    ends = L.summary_rows(back).select("ledger", "pipeline_id", F.col("total_duration_ms").alias("summarised"))
    return L.integrity(L.lines(spark, path)).select("ledger", "total_records", "intact").join(seen, "ledger").join(ends, "ledger")


def ledger_many_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders of ledgers in three appends each, one of them tried twice, read by a pattern and verified."""
    at = f"{shared_folder(spark)}/ledgers-{uuid.uuid4().hex}"
    for side in (0, 1):
        path, rows = f"{at}/side{side}", _plain_rows(spark, sf).filter(F.col("o") % 2 == side)
        for part in (0, 1, 2, 2):
            done, state = L.last_commit(spark, path), L.chain_state(L.lines(spark, path))
            own = rows.filter(F.pmod(F.floor(F.col("o") / 2), F.lit(3)) == part)
            L.append(L.chained(own, "ledger", "o", "json", state), path, after=done, append_id=f"part-{part}")
    return L.integrity(L.lines(spark, f"{at}/side*"))


LEDGER_MANY_SQL = """
SELECT 'side' || CAST(o_orderkey % 2 AS BIGINT) || '/' || {key} AS ledger, count(*) AS total_records, CAST(0 AS BIGINT) AS legacy_records, CAST(0 AS BIGINT) AS broken_links, CAST(0 AS BIGINT) AS sequence_gaps, true AS intact FROM orders GROUP BY 1
"""
#: Valid lines whose row_hash stands elsewhere, with a nested one, or changed besides.
REORDERED = """
CASE seq % 5 WHEN 1 THEN concat('{"row_hash":"', row_hash, '",', substr(line, 2, length(line) - 80), '}')
 WHEN 2 THEN concat('{"row_hash":"', row_hash, '",', replace(substr(line, 2, length(line) - 80), '"amount":', '"amount":9'), '}')
 WHEN 3 THEN replace(concat(substr(line, 1, length(line) - 79), '}'), ',"prev_hash"', concat(',"row_hash":"', row_hash, '","prev_hash"'))
 WHEN 4 THEN concat('{"a":{"row_hash":"', row_hash, '"},', substr(line, 2)) ELSE line END
"""


def ledger_reordered_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose own hash is judged wrong, by where among their keys it stands and whether more was changed."""
    rows = _chain(spark, sf).select("ledger", F.col("seq").alias("line_no"), F.expr(REORDERED).alias("line"))
    return L.faults(rows).select("ledger", "line_no", "bad_hash", "bad_link", "gap")


def ledger_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Lines appended without a chain: readable, and legacy to the verifier."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    L.append_plain(_plain_rows(spark, sf), "ledger", "o", "json", path)
    return L.integrity(L.lines(spark, path))


def _polled(spark: SparkSession, sf: str) -> str:
    """Where the figures of ledgers of orders are kept, polled after each of three appends."""
    at = f"{shared_folder(spark)}/polled-{uuid.uuid4().hex}"
    rows = _plain_rows(spark, sf).withColumn("json", F.regexp_replace("json", "\\}$", F.concat(F.lit(',"risk_level":"'), F.when(F.col("o") % 7 == 0, "HIGH").otherwise("LOW"), F.lit('"}'))))
    for part in range(3):
        state = L.chain_state(L.lines(spark, f"{at}/ledgers"))
        L.append(L.chained(rows.filter(F.col("o") % 3 == part), "ledger", "o", "json", state), f"{at}/ledgers")
        R.poll(spark, f"{at}/ledgers", f"{at}/kept")
    return f"{at}/kept"


def polled_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by risk of a ledger that grows, from figures kept for each append."""
    return R.stats(spark, _polled(spark, sf))


def polled_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return R.integrity(spark, _polled(spark, sf))


def ledger_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last three records before each ledger's first bad line."""
    return L.tail_scan(tampered(spark, sf), 3).select("ledger", "line_no", F.coalesce("seq", F.lit(-1)).alias("seq"))


def step_index(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "events").select(F.col("user_id").alias("trace_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("step_id"), F.col("event_type").alias("action"))
    return flow.numbered_steps(steps).select("trace_id", "step_id", F.col("step_index").cast("bigint"), "last_action")


def runs_by_start(spark: SparkSession, sf: str) -> DataFrame:
    """A pipeline's runs as they started, and each run's place."""
    v = verdicts(spark, sf, rules=("block_pii_leakage",)).filter("pipeline_id = 7").select("audit_id", "started_at", "line_no")
    return report.by_start(v).select("audit_id", "line_no")


def json_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs that are objects are scanned as their JSON."""
    mail = F.concat(F.lit("user"), F.col("o_orderkey").cast("string"), F.lit("@example.com"))
    runs = fixtures.orders_of(spark, sf).select(F.col("o_orderkey").alias("run_id"), F.struct(F.struct(mail.alias("mail"), F.lit(None).cast("string").alias("none")).alias("inner"), F.array(F.lit(True)).alias("flags")).alias("output"))
    return scan.exploded(scan.scan(runs, ("block_pii_leakage",)), "run_id").select("run_id", "severity", "evidence")


def large_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of thresholds from a million on, and of broken ones."""
    runs = fixtures.orders_of(spark, sf).select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("Transfer of $"), (F.col("o_orderkey") + 2_000_000).cast("string"), F.lit(" is due.")).alias("output"))
    parts = [scan.exploded(scan.scan(runs, (rule,), scan.Options(threshold=t)), "run_id").select("run_id", "description") for rule, t in (("block_financial_advice", 1_500_000.0), ("require_human_approval", 12_345.67))]
    return parts[0].unionByName(parts[1])


def lineage_circles(spark: SparkSession, sf: str) -> DataFrame:
    """Parents in circles of three customers each have no root; others are their own."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    parent = F.when(F.col("k") % 7 == 0, F.col("k") - F.col("k") % 7).when(F.col("k") % 2 == 0, F.col("k") + 1 - 2 * (F.floor(F.col("k") / 2) % 2))
    rows = c.select(F.col("k").cast("string").alias("audit_id"), parent.cast("bigint").cast("string").alias("parent_trace_id"))
    return flow.ancestry(rows).filter("root_id is null").select("audit_id")


def lite_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Risk by the lite dialect for runs with a finding."""
    runs = fixtures.runs(spark, sf).withColumn("violations", scan.once(scan.lite_violations(F.col("output")))).filter(F.size("violations") > 0)
    return runs.select("run_id", verdict.lite_risk(F.col("violations")).alias("risk_level"))


def approval_requests(spark: SparkSession, sf: str) -> DataFrame:
    return X.approval_requests(fixtures.runs(spark, sf))


def intercepted_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls: only guarded methods are kept, purchases standing for run and views for query."""
    calls = table(spark, sf, "events").withColumn("action", F.when(F.col("event_type") == "purchase", "run").when(F.col("event_type") == "view", "query").otherwise(F.col("event_type")))
    return X.intercepted(calls).groupBy("action").agg(F.count("*").alias("n"))


def event_ages(spark: SparkSession, sf: str) -> DataFrame:
    """How long ago each event was, as of a fixed time."""
    age = F.unix_timestamp(F.lit("2025-01-01").cast("timestamp")) - F.unix_timestamp("ts")
    return table(spark, sf, "events").select("event_id", report.time_ago(age).alias("ago"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = live.windowed(table(spark, sf, "events"), "ts", "10 minutes", "1 hour", "event_type")
    return w.select(F.col("window.start").cast("string").alias("start"), "event_type", "n")


def _late_stream(spark: SparkSession, sf: str, slide: str | None) -> DataFrame:
    """Events as a stream in three goes: the earlier half but for each tenth event, the later half so, then those tenths."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    half = events.agg(F.expr("timestamp_micros((min(unix_micros(ts)) + max(unix_micros(ts))) div 2)")).first()[0]
    early, tenth = F.col("ts") < F.lit(half), F.col("event_id") % 10 == 0
    for n, part in enumerate((~tenth & early, ~tenth & ~early, tenth)):
        events.filter(part).write.parquet(f"{at}/in/go={n}")
        found = live.windowed(live.files(spark, f"{at}/in/*", "event_id bigint, event_type string, ts timestamp"), "ts", "10 minutes", "1 hour", "event_type", slide=slide)
        live.to_files(found.select(F.col("window.start").alias("start"), "event_type", "n"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint").parquet(f"{at}/out").select(F.col("start").cast("string").alias("start"), "event_type", "n")


def event_windows_late(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that have ended for good, without the rows that came after that."""
    return _late_stream(spark, sf, None)


def event_windows_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _late_stream(spark, sf, "20 minutes")


LATE_SQL = """
WITH w AS (SELECT max(ts) FILTER (WHERE event_id % 10 <> 0) - INTERVAL 10 MINUTE AS before, max(ts) - INTERVAL 10 MINUTE AS after FROM events),
e AS (SELECT event_id, event_type, unnest([time_bucket(INTERVAL '{slide} minutes', ts) - to_minutes({slide} * i) FOR i IN range(60 // {slide})]) AS start FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM e, w
WHERE start + INTERVAL 1 HOUR <= after AND (event_id % 10 <> 0 OR start + INTERVAL 1 HOUR > before) GROUP BY ALL
"""


def _on_verdicts(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: make(verdicts(spark, sf))


FEED = ("audit_id", "blocked", "risk_level")


def custom_rule(spark: SparkSession, sf: str) -> DataFrame:
    flagged = scan.make_rule("no_shipping", lambda t, _: scan.where(F.array(F.regexp_extract(t, "shipped|picnic", 0)), lambda m: scan.violation("no_shipping", F.lit("flagged word"), m, "MEDIUM"), lambda m: m != ""))
    return scan.exploded(scan.scan(fixtures.runs(spark, sf), [flagged, "block_harmful_content"]), "run_id").select("run_id", F.col("ord").cast("int"), "rule", "severity", "evidence")


CUSTOM_SQL = f"""{O.runs(f"h AS ({O.group_rows('block_harmful_content')})")},
v AS (SELECT run_id, 0 AS r, 0 AS g, 'no_shipping' AS rule, 'MEDIUM' AS severity, regexp_extract(output, 'shipped|picnic', 0) AS evidence FROM runs WHERE regexp_matches(output, 'shipped|picnic')
      UNION ALL SELECT run_id, 1, g, 'block_harmful_content', severity, evidence FROM h)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY r, g) - 1 AS INT) AS ord, rule, severity, evidence FROM v"""


def approvals_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    given = orders.select("run_id", F.when(F.col("run_id") % 2 == 0, "phrase").otherwise("amount").alias("kind"), (F.col("run_id") % 3 == 0).alias("approved"))
    return scan.exploded(X.with_approvals(fixtures.runs(spark, sf), given), "run_id").select("run_id", F.col("ord").cast("int"), "severity", "description", "evidence")


APPROVALS_SQL = f"""{O.runs("v AS (" + O.approval_rows("runs", "run_id % 3 = 0 AND run_id % 2 = 0", "run_id % 3 = 0 AND run_id % 2 = 1") + ")")}
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY g) - 1 AS INT) AS ord, severity, description, evidence FROM v"""


def lite_rules_long(spark: SparkSession, sf: str) -> DataFrame:
    runs = fixtures.runs(spark, sf).withColumn("violations", scan.once(scan.lite_violations(F.col("output"))))
    return scan.exploded(runs, "run_id").select("run_id", F.col("ord").cast("int"), "rule", "severity", "description", "evidence")


def _lite_sql() -> str:
    parts = []
    for i, rule in enumerate(C.RULES):
        tests = C.LITE[rule]
        if not tests:
            continue
        hits = [(f"regexp_extract(output, {O.p(t, not exact)}, 0)", d, s) for t, d, s, exact in tests]
        case = lambda k: "CASE " + " ".join(f"WHEN {h[0]} <> '' THEN {O.quoted(h[k])}" for h in hits) + " END"  # noqa: B023, E731
        evidence = "CAST(NULL AS VARCHAR)" if rule in C.LITE_SILENT else "CASE " + " ".join(f"WHEN {h[0]} <> '' THEN substr({h[0]}, 1, 80)" for h in hits) + " END"
        allowed = f" AND NOT regexp_matches(output, {O.quoted(O.any_of(C.LITE_IDENTITY_ALLOWED))})" if rule == "block_ai_identity_deception" else ""
        parts.append(f"SELECT run_id, {i} AS r, {O.quoted(rule)} AS rule, {case(2)} AS severity, {case(1)} AS description, {evidence} AS evidence FROM runs WHERE ({' OR '.join(h[0] + chr(60) + chr(62) + chr(39) * 2 for h in hits)}){allowed}")
    return f"{O.runs('v AS (' + ' UNION ALL '.join(parts) + ')')} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY r) - 1 AS INT) AS ord, rule, severity, description, evidence FROM v"


def explain_block(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).filter("reason is not null").select("audit_id", "reason")


def explain_allow(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).filter("explanation is not null").select("audit_id", "explanation")


def stat_delta(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return report.stat_delta(days, "day", "n").filter("delta is not null")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of runs: their properties are the output."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    events = live.files(spark, sf, schema, "events.parquet")
    return scan.scan(events.withColumn("output", F.concat(F.lit("Event worth $"), F.floor(F.col("value") * 100).cast("string"), F.lit(" "), F.col("event_type"))), ["block_financial_advice", "require_human_approval"])


def stream_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    judged = _stream(spark, sf).select("event_id", verdict.blocks(F.col("violations"), "enforce").alias("blocked"), verdict.max_severity(F.col("violations")).alias("risk_level"))
    live.to_files(judged, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(judged.schema).parquet(f"{at}/out")


def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    judged = _stream(spark, sf).select(verdict.blocks(F.col("violations"), "enforce").alias("blocked"), verdict.max_severity(F.col("violations")).alias("risk_level"))
    live.running_stats(judged, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out")


_STREAM_CTE = """WITH e AS (SELECT event_id, floor(value * 100) AS a FROM events), s AS (SELECT event_id, a >= 1000 AS blocked, CASE WHEN a >= 10000 THEN 'CRITICAL' WHEN a >= 1000 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM e)"""

_REPORT_SQL = {
    "stats": "SELECT risk_level, count(*) AS total, count(*) FILTER (WHERE blocked) AS blocked FROM verdicts GROUP BY 1",
    "block_rate": "SELECT CAST(floor(100 * count(*) FILTER (WHERE blocked) / count(*) + 0.5) AS BIGINT) AS block_rate, CAST(floor(100 * count(*) FILTER (WHERE NOT blocked) / count(*) + 0.5) AS BIGINT) AS allow_rate FROM verdicts",
    "risk_distribution": "SELECT risk_level, count(*) AS n, CAST(floor(100 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent FROM verdicts GROUP BY 1",
    "outcomes": "SELECT count(*) FILTER (WHERE NOT blocked) AS allowed, count(*) FILTER (WHERE blocked) AS blocked, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical, count(*) FILTER (WHERE risk_level = 'HIGH') AS high FROM verdicts",
    "recent": "SELECT audit_id, blocked, risk_level FROM verdicts ORDER BY line_no DESC LIMIT 20",
    "blocked_recent": "SELECT audit_id, blocked, risk_level FROM verdicts WHERE blocked ORDER BY line_no DESC LIMIT 50",
    "by_id": "SELECT audit_id, blocked, risk_level FROM verdicts WHERE audit_id = 'run-33'",
    "by_pipeline": "SELECT audit_id, blocked, risk_level FROM verdicts WHERE pipeline_id = 7",
    "activity8": "SELECT 'T' || row_number() OVER (ORDER BY line_no) AS label, (NOT blocked)::INT AS allowed, blocked::INT AS blocked FROM (SELECT * FROM verdicts ORDER BY line_no DESC LIMIT 8)",
    "feed6": "SELECT audit_id, first_rule AS rule FROM verdicts WHERE blocked AND n_violations > 0 ORDER BY line_no DESC LIMIT 6",
    "search": "SELECT audit_id, risk_level FROM verdicts WHERE risk_level = 'HIGH' AND (contains(lower(audit_id), 'advice') OR contains(lower(coalesce(agent_name, '')), 'advice') OR contains(lower(action), 'advice') OR len(list_filter(rules, lambda r: contains(r, 'advice'))) > 0 OR run_id IN (SELECT run_id FROM vd WHERE contains(lower(description), 'advice')))",
    "action_label": "SELECT audit_id, coalesce(nullif(agent_name, ''), nullif(replace(regexp_replace(first_rule, 'block_', ''), '_', ' '), ''), nullif(action, ''), 'Agent run') AS label, coalesce(array_to_string(rules[1:2], ' '), '') || CASE WHEN n_violations > 2 THEN ' +' || (n_violations - 2) ELSE '' END AS chips, CASE WHEN length(audit_id) > 9 THEN substr(audit_id, 1, 8) || '…' ELSE audit_id END AS short FROM verdicts",
    "explain_allow": "SELECT audit_id, 'Agent completed task in ' || n_steps || ' step(s). All accountability rules passed.' AS explanation FROM verdicts WHERE n_violations = 0",
    "explain_block": "SELECT audit_id, '⛔ AGENT ACTION BLOCKED' || chr(10) || 'Violated rule(s): ' || quoted_rules || chr(10) || 'Highest severity: ' || risk_level || chr(10) || 'Action attempted: \"' || action || '\"' || chr(10) || 'Audit ID: ' || audit_id || chr(10) || 'No action was taken. Human review required.' AS reason FROM verdicts WHERE n_violations > 0",
    "with_summary": "SELECT audit_id, short_circuited, blocked_at FROM verdicts JOIN summ USING (pipeline_id)",
}
_SUMM = """, mm AS (SELECT *, coalesce(max(blocked::INT) OVER (PARTITION BY pipeline_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM verdicts),
summ AS (SELECT pipeline_id, bool_or(blocked) AS short_circuited, first(audit_id ORDER BY line_no) FILTER (WHERE blocked) AS blocked_at FROM mm WHERE before = 0 GROUP BY 1)"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "document_verdicts": document_verdicts,
        "pii_counts": _pii_counts("documents", "doc_id", "text"),
        "pii_counts_pages": _pii_counts("pages", "page_id", "html"),
        "luhn_cards": luhn_cards,
        **{name: _rule(rule) for name, rule in SHORT.items()},
        "all_rules_long": _long(C.RULES),
        **{f"bundle_{b.lower()}": _long(rules) for b, rules in C.BUNDLES.items() if b != "FINTECH"},
        "bundle_fintech_aliased": _long(tuple(C.ALIASES.get(r, r) for r in C.BUNDLES["FINTECH"])),
        **{f"verdict_{m}": _verdict(m) for m in verdict.MODES},
        "base_risk": base_risk,
        "input_check": input_check,
        "claim_sentences": claim_sentences,
        "grounding_steps": grounding_steps,
        "temporal_mismatch": _step("bad_years > 0", "bad_years"),
        "numeric_ungrounded": _step("bad_nums > 0", "bad_nums"),
        "negation_flip": _step("flip", "flip"),
        "overlap_score": _step("not supported", "score"),
        "grounding_violations": grounding_violations,
        "grounding_by_context": grounding_by_context,
        "grounding_by_document": grounding_by_document,
        "rules_per_run": rules_per_run,
        "unknown_rules": unknown_rules,
        "short_circuit": short_circuit,
        "skipped_stages": skipped_stages,
        "lineage_hops": lineage_hops,
        "lineage_recursive": lineage_recursive,
        "lineage_table": lineage_table,
        "pipeline_summary": pipeline_summary,
        **{f"entities_{k}": _entities(k) for k in E.WEIGHTS},
        "contradictions": contradictions,
        "consistency_report": consistency_report,
        "ledger_chain": ledger_chain,
        "ledger_verify": ledger_verify,
        "ledger_faults": ledger_faults,
        "chain_tail": chain_tail,
        "ledger_roundtrip": ledger_roundtrip,
        "stats": _on_verdicts(report.stats),
        "api_stats": api_stats,
        "block_rate": _on_verdicts(report.block_rate),
        "risk_distribution": _on_verdicts(report.risk_distribution),
        "outcomes": _on_verdicts(report.outcomes),
        "recent": _on_verdicts(lambda v: report.recent(v).select(*FEED)),
        "blocked_recent": _on_verdicts(lambda v: report.blocked_recent(v).select(*FEED)),
        "by_id": _on_verdicts(lambda v: report.by_id(v, "run-33").select(*FEED)),
        "by_pipeline": _on_verdicts(lambda v: report.by_pipeline(v, "7").select(*FEED)),
        "with_summary": with_summary,
        "activity8": _on_verdicts(report.activity),
        "feed6": _on_verdicts(lambda v: report.violation_feed(v).select("audit_id", "rule")),
        "search": _on_verdicts(lambda v: report.search(v, "advice", "HIGH").select("audit_id", "risk_level")),
        "action_label": _on_verdicts(lambda v: v.select("audit_id", report.action_label().alias("label"), report.chips().alias("chips"), report.short_id("audit_id").alias("short"))),
        "stat_delta": stat_delta,
        "stream_verdicts": stream_verdicts,
        "stream_stats": stream_stats,
        "explain_block": explain_block,
        "explain_allow": explain_allow,
        "custom_rule": custom_rule,
        "approvals_join": approvals_join,
        "lite_rules_long": lite_rules_long,
        "lite_verdicts": lite_verdicts,
        "approval_requests": approval_requests,
        "intercepted_calls": intercepted_calls,
        "event_ages": event_ages,
        "event_windows": event_windows,
        "event_windows_late": event_windows_late,
        "event_windows_sliding": event_windows_sliding,
        "ledger_append_twice": ledger_append_twice,
        "ledger_mixed": ledger_mixed,
        "ledger_many_files": ledger_many_files,
        "ledger_reordered_keys": ledger_reordered_keys,
        "ledger_plain": ledger_plain,
        "polled_stats": polled_stats,
        "polled_integrity": polled_integrity,
        "ledger_tail": ledger_tail,
        "step_index": step_index,
        "runs_by_start": runs_by_start,
        "json_outputs": json_outputs,
        "large_thresholds": large_thresholds,
        "lineage_circles": lineage_circles,
        "pipeline_feed": pipeline_feed,
        "rule_filter": _on_verdicts(lambda v: report.with_rule(v, "block_pii_leakage").select("audit_id")),
    }
    return found


def oracle_sql() -> dict[str, str]:
    verdict_cols = "SELECT audit_id, blocked, degraded, risk_level, n_violations, NOT blocked AS has_result FROM verdicts"
    described = ", vd AS (" + " UNION ALL ".join(f"SELECT run_id, description FROM ({O.rule_rows(r)})" for r in C.RULES if r != "block_hallucination") + ")"
    reports = {k: O.on_verdicts(sql) for k, sql in _REPORT_SQL.items()}
    reports["with_summary"] = O.verdict_ctes() + _SUMM + _REPORT_SQL["with_summary"]
    reports["search"] = O.verdict_ctes() + described + " " + _REPORT_SQL["search"]
    return {
        "document_verdicts": DOCUMENT_VERDICTS_SQL,
        "pii_counts": _pii_sql("documents", "doc_id", "text"),
        "pii_counts_pages": _pii_sql("pages", "page_id", "html"),
        "luhn_cards": LUHN_SQL,
        **{name: O.rule_query(rule) for name, rule in SHORT.items()},
        "all_rules_long": O.long_query(),
        **{f"bundle_{b.lower()}": O.long_query(rules) for b, rules in C.BUNDLES.items() if b != "FINTECH"},
        "bundle_fintech_aliased": O.long_query(tuple(C.ALIASES.get(r, r) for r in C.BUNDLES["FINTECH"])),
        **{f"verdict_{m}": O.on_verdicts(verdict_cols, m) for m in verdict.MODES},
        "base_risk": BASE_RISK_SQL,
        "input_check": INPUT_SQL,
        "claim_sentences": f"{O.runs(O.grounding_ctes())} SELECT run_id, n, s AS sentence FROM claims",
        "grounding_steps": f"{O.runs(O.grounding_ctes())} SELECT run_id, n, bad_years, bad_nums, flip, round(score, 6) AS score, supported FROM scored",
        "grounding_violations": f"{O.runs(O.grounding_ctes())} SELECT run_id, g, severity, evidence, confidence FROM grounded",
        "grounding_by_context": GROUNDING_BY_CONTEXT_SQL,
        "grounding_by_document": O.grounding_by_table("documents", "doc_id", "benchmark"),
        "rules_per_run": _rules_per_run_sql(),
        "unknown_rules": "SELECT o_orderkey AS run_id, 'no_such_rule' AS name FROM orders WHERE o_orderkey % 5 = 1",
        "short_circuit": f"WITH {STAGED} SELECT pipeline_id, ord, stage, audit_id, blocked, risk_level FROM ran",
        "skipped_stages": f"WITH {STAGED} SELECT pipeline_id, ord, stage FROM m WHERE before = 1",
        "lineage_hops": f"WITH {STAGED}, l AS (SELECT audit_id, stage, lag(audit_id) OVER w AS parent_trace_id, lag(stage) OVER w AS parent_stage FROM ran WINDOW w AS (PARTITION BY pipeline_id ORDER BY ord)) SELECT audit_id, parent_trace_id, parent_stage FROM l",
        "lineage_recursive": f"WITH RECURSIVE {STAGED}, l AS (SELECT audit_id, lag(audit_id) OVER (PARTITION BY pipeline_id ORDER BY ord) AS parent FROM ran), r AS (SELECT audit_id, audit_id AS root_id, 0 AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.audit_id, r.root_id, r.depth + 1 FROM r JOIN l ON l.parent = r.audit_id) SELECT audit_id, root_id, CAST(depth AS BIGINT) AS depth FROM r",
        "lineage_table": f"WITH {STAGED} SELECT pipeline_id, CAST(row_number() OVER (PARTITION BY pipeline_id ORDER BY ord) AS INT) AS number, stage, audit_id, lag(audit_id) OVER (PARTITION BY pipeline_id ORDER BY ord) AS parent_trace_id, blocked, risk_level, duration_ms FROM ran",
        "pipeline_summary": f"WITH {STAGED} SELECT pipeline_id, count(*) AS n_stages, string_agg(stage, ',' ORDER BY ord) AS stage_names, bool_or(blocked) AS short_circuited, first(stage ORDER BY ord) FILTER (WHERE blocked) AS blocked_at, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM ran GROUP BY pipeline_id",
        **{f"entities_{k}": f"{O.entity_ctes()} SELECT pipeline_id, stage, value, raw FROM ents WHERE type = '{k}'" for k in E.WEIGHTS},
        "contradictions": f"{O.contradiction_ctes()} SELECT * FROM pairs",
        "consistency_report": f"""{O.contradiction_ctes()} SELECT s.pipeline_id, s.n AS n_stages, coalesce(e.n, 0) AS n_entities, coalesce(c.n, 0) AS n_contradictions, coalesce(c.n, 0) = 0 AS consistent
            FROM (SELECT pipeline_id, count(*) AS n FROM stages GROUP BY 1) s LEFT JOIN (SELECT pipeline_id, count(*) AS n FROM ents GROUP BY 1) e USING (pipeline_id) LEFT JOIN (SELECT pipeline_id, count(*) AS n FROM pairs GROUP BY 1) c USING (pipeline_id)""",
        "ledger_chain": f"WITH {CHAIN} SELECT ledger, seq, prev_hash, row_hash FROM c",
        "ledger_verify": LEDGER_VERIFY_SQL,
        "ledger_faults": FAULTS + "SELECT ledger, CAST(line_no AS INT) AS line_no, coalesce(last.s + line_no - last.n, line_no) AS expected_seq, corrupt, gap, bad_link, bad_hash FROM f WHERE corrupt OR gap OR bad_link OR bad_hash",
        "chain_tail": f"WITH {CHAIN} SELECT ledger, arg_max(row_hash, seq) AS prev_hash, max(seq) + 1 AS seq FROM c GROUP BY 1",
        "ledger_roundtrip": LEDGER_ROUNDTRIP_SQL,
        "lite_verdicts": _lite_sql().replace("SELECT run_id, CAST(row_number()", "SELECT run_id, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level FROM v GROUP BY 1 --"),
        "approval_requests": f"{O.runs('v AS (' + O.approval_rows() + ')')} SELECT run_id, CASE g WHEN 0 THEN 'phrase' ELSE 'amount' END AS kind, description FROM v",
        "intercepted_calls": "SELECT CASE event_type WHEN 'purchase' THEN 'run' WHEN 'view' THEN 'query' END AS action, count(*) AS n FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1",
        "event_ages": "WITH a AS (SELECT event_id, epoch(TIMESTAMP '2025-01-01') - floor(epoch(ts)) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's ago' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS ago FROM a",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "event_windows_late": LATE_SQL.format(slide=60),
        "event_windows_sliding": LATE_SQL.format(slide=20),
        "temporal_mismatch": f"{O.runs(O.grounding_ctes())} SELECT run_id, n, bad_years FROM scored WHERE bad_years > 0",
        "numeric_ungrounded": f"{O.runs(O.grounding_ctes())} SELECT run_id, n, bad_nums FROM scored WHERE bad_nums > 0",
        "negation_flip": f"{O.runs(O.grounding_ctes())} SELECT run_id, n, flip FROM scored WHERE flip",
        "overlap_score": f"{O.runs(O.grounding_ctes())} SELECT run_id, n, round(score, 6) AS score FROM scored WHERE NOT supported",
        **reports,
        "api_stats": O.verdict_ctes() + _SUMM + " SELECT count(*) AS total, count(*) FILTER (WHERE blocked) AS blocked, count(*) FILTER (WHERE NOT blocked) AS allowed, " + ", ".join(f"count(*) FILTER (WHERE risk_level = '{r}') AS {r.lower()}" for r in report.RISKS) + ", (SELECT count(*) FROM summ) AS pipelines, (SELECT count(*) FILTER (WHERE short_circuited) FROM summ) AS short_circuited FROM verdicts",
        "stat_delta": "WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM d QUALIFY lag(n) OVER (ORDER BY day) IS NOT NULL",
        "stream_verdicts": f"{_STREAM_CTE} SELECT event_id, blocked, risk_level FROM s",
        "stream_stats": f"{_STREAM_CTE} SELECT risk_level, count(*) AS total, count(*) FILTER (WHERE blocked) AS blocked FROM s GROUP BY 1",
        "ledger_append_twice": f"SELECT {_LEDGER_KEY} AS ledger, count(*) AS total_records, CAST(0 AS BIGINT) AS legacy_records, CAST(0 AS BIGINT) AS broken_links, CAST(0 AS BIGINT) AS sequence_gaps, true AS intact FROM orders GROUP BY 1",
        "ledger_many_files": LEDGER_MANY_SQL.format(key=_LEDGER_KEY),
        "ledger_reordered_keys": f"WITH {CHAIN} SELECT ledger, seq AS line_no, seq % 5 IN (2, 4) AS bad_hash, false AS bad_link, false AS gap FROM c",
        "ledger_plain": f"SELECT {_LEDGER_KEY} AS ledger, count(*) AS total_records, count(*) AS legacy_records, CAST(0 AS BIGINT) AS broken_links, CAST(0 AS BIGINT) AS sequence_gaps, true AS intact FROM orders GROUP BY 1",
        "polled_stats": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS blocked FROM orders GROUP BY 1",
        "polled_integrity": f"SELECT {_LEDGER_KEY} AS ledger, count(*) AS total_records, CAST(0 AS BIGINT) AS legacy_records, CAST(0 AS BIGINT) AS broken_links, CAST(0 AS BIGINT) AS sequence_gaps, true AS intact FROM orders GROUP BY 1",
        "ledger_mixed": f"SELECT {_LEDGER_KEY} AS ledger, count(*) + 1 AS total_records, true AS intact, count(*) AS traces, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS blocked, 'p-' || {_LEDGER_KEY} AS pipeline_id, count(*) AS summarised FROM orders GROUP BY 1, 6",
        "ledger_tail": FAULTS + ", b AS (SELECT ledger, min(line_no) FILTER (WHERE corrupt) AS bad FROM f GROUP BY 1) SELECT ledger, CAST(line_no AS INT) AS line_no, coalesce(sq, -1) AS seq FROM f JOIN b USING (ledger) WHERE b.bad IS NULL OR line_no < b.bad QUALIFY row_number() OVER (PARTITION BY ledger ORDER BY line_no DESC) <= 3",
        "step_index": "SELECT user_id AS trace_id, event_id AS step_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_index, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_action FROM events",
        "runs_by_start": "SELECT 'run-' || o_orderkey AS audit_id, o_orderkey AS line_no FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate, o_orderkey",
        "json_outputs": "SELECT o_orderkey AS run_id, 'HIGH' AS severity, 'use***@example.com' AS evidence FROM orders",
        "large_thresholds": "SELECT o_orderkey AS run_id, 'Output references transaction of $' || (o_orderkey + 2000000) || ' which exceeds threshold of $1500000' AS description FROM orders UNION ALL SELECT o_orderkey, 'Transaction amount $' || format('{:,}', o_orderkey + 2000000) || ' exceeds approval threshold of $12,345.67' FROM orders",
        "lineage_circles": "WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_custkey WHEN c_custkey % 2 = 0 THEN c_custkey + 1 - 2 * ((c_custkey // 2) % 2) END AS up FROM customer), r AS (SELECT k FROM c WHERE up IS NULL OR up NOT IN (SELECT k FROM c) UNION SELECT c.k FROM r JOIN c ON c.up = r.k) SELECT CAST(k AS VARCHAR) AS audit_id FROM c WHERE k NOT IN (SELECT k FROM r)",
        "pipeline_feed": O.verdict_ctes() + _SUMM + " SELECT m.pipeline_id, count(*) AS n_stages, any_value(s.short_circuited) AS short_circuited, any_value(s.blocked_at) AS blocked_at FROM mm m JOIN summ s USING (pipeline_id) WHERE before = 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 6",
        "rule_filter": O.on_verdicts("SELECT audit_id FROM verdicts WHERE list_contains(rules, 'block_pii_leakage')"),
        "custom_rule": CUSTOM_SQL,
        "approvals_join": APPROVALS_SQL,
        "lite_rules_long": _lite_sql(),
    }
