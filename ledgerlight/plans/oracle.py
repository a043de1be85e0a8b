"""The queries' meaning in SQL, for comparison by another engine on the same tables."""

from __future__ import annotations

from ..functions import catalog as C
from ..functions.patterns import any_of, quoted, translate
from . import fixtures as X


def p(pattern: str, ignore_case: bool = False) -> str:
    return quoted(translate(pattern, "re2", ignore_case))


def first(text: str, patterns, exact=frozenset()) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {p(x, i not in exact)}, 0), '')" for i, x in enumerate(patterns)) + ", '')"


def group_rows(rule: str, source: str = "runs", text: str = "output") -> str:
    """(run_id, g, severity, description, evidence) for the groups of a rule."""
    allowed = f" AND NOT regexp_matches(lower({text}), {quoted(any_of([a.lower() for a in C.IDENTITY_ALLOWED]))})" if rule == "block_ai_identity_deception" else ""
    parts = []
    for i, g in enumerate(C.GROUPS[rule]):
        cut = f"substr(m, 1, {g.cut})" if g.cut else "m"
        parts.append(f"SELECT run_id, {i} AS g, {quoted(g.severity)} AS severity, {quoted(g.description)} AS description, {cut} AS evidence FROM (SELECT run_id, {first(text, g.patterns, g.exact)} AS m FROM {source} WHERE true{allowed}) WHERE m <> ''")
    return " UNION ALL ".join(parts)


LUHN = "list_sum([CASE WHEN (len({n}) - i) % 2 = 1 THEN CASE WHEN 2 * CAST({n}[i] AS INT) > 9 THEN 2 * CAST({n}[i] AS INT) - 9 ELSE 2 * CAST({n}[i] AS INT) END ELSE CAST({n}[i] AS INT) END FOR i IN range(1, len({n}) + 1)]) % 10 = 0"


def matches(kind: str, text: str) -> str:
    found = f"regexp_extract_all({text}, {p(C.PII[kind])}, 0)"
    return f"list_filter({found}, lambda c: {LUHN.format(n='c')})" if kind == "cc" else found


def pii_rows(source: str = "runs", text: str = "output", key: str = "run_id") -> str:
    parts = []
    for i, (kind, (name, severity, fixed)) in enumerate(C.PII_TEXTS.items()):
        masked = "list_transform(m[1:2], lambda e: regexp_replace(e, '^(.{3}).+@', '\\1***@'))" if kind == "email" else "list_transform(m[1:2], lambda e: '***-***-****')"
        evidence = quoted(fixed) if fixed else f"array_to_string({masked}, ', ')"
        parts.append(f"SELECT {key}, {i} AS g, {quoted(severity)} AS severity, 'Output contains ' || len(m) || {quoted(' ' + name)} AS description, {evidence} AS evidence FROM (SELECT {key}, {matches(kind, text)} AS m FROM {source}) WHERE len(m) > 0")
    return " UNION ALL ".join(parts)


AMOUNT = "coalesce(try_cast(regexp_extract(regexp_replace({a}, '[^0-9.]', '', 'g'), '^\\d*\\.?\\d*', 0) AS DOUBLE), 0)"


def financial_rows() -> str:
    return f"""
SELECT run_id, 0 AS g, 'HIGH' AS severity, 'Output contains financial advice language: "' || array_to_string(m[1:2], '", "') || '"' AS description, array_to_string(m[1:3], ', ') AS evidence
FROM (SELECT run_id, regexp_extract_all(output, {p(any_of(C.FINANCIAL_PHRASES), True)}, 0) AS m FROM runs) WHERE len(m) > 0
UNION ALL
SELECT run_id, 1, CASE WHEN {AMOUNT.format(a='a')} >= 10000 THEN 'CRITICAL' ELSE 'HIGH' END, 'Output references transaction of ' || a || ' which exceeds threshold of $1000', a
FROM (SELECT run_id, list_filter(regexp_extract_all(output, {p(C.TRANSACTION)}, 0), lambda x: {AMOUNT.format(a='x')} >= 1000)[1] AS a FROM runs) WHERE a IS NOT NULL
"""


WRITTEN = "regexp_replace(regexp_replace(format('{{:,.3f}}', a), '0+$', ''), '\\.$', '')"


def approval_rows(source: str = "runs", phrase_ok: str = "false", amount_ok: str = "false") -> str:
    return f"""
SELECT run_id, 0 AS g, 'HIGH' AS severity, 'High-impact action detected: "' || m || '". Human approval required.' AS description, m AS evidence
FROM (SELECT run_id, regexp_extract(output, {p(any_of(C.APPROVAL_PHRASES), True)}, 0) AS m, {phrase_ok} AS ok FROM {source}) WHERE m <> '' AND NOT ok
UNION ALL
SELECT run_id, 1, CASE WHEN a >= 10000 THEN 'CRITICAL' ELSE 'HIGH' END, 'Transaction amount $' || {WRITTEN.format()} || ' exceeds approval threshold of $1,000', '$' || {WRITTEN.format()}
FROM (SELECT run_id, coalesce(list_max(list_transform(regexp_extract_all(output, {p(C.APPROVAL_AMOUNT, True)}, 1), lambda x: coalesce(try_cast(replace(x, ',', '') AS DOUBLE), 0))), 0) AS a, {amount_ok} AS ok FROM {source}) WHERE a >= 1000 AND NOT ok
"""


def numbers(text: str) -> str:
    value = "coalesce(try_cast(replace({n}, ',', '') AS DOUBLE), 0)"
    d, u = p(C.DOLLARS), p(C.WITH_UNIT, True)
    dollars = f"list_transform(list_zip(regexp_extract_all({text}, {d}, 0), regexp_extract_all({text}, {d}, 1)), lambda z: {{'value': {value.format(n='z[2]')}, 'unit': 'usd', 'raw': trim(z[1])}})"
    units = f"list_transform(list_zip(regexp_extract_all({text}, {u}, 0), regexp_extract_all({text}, {u}, 1), regexp_extract_all({text}, {u}, 2)), lambda z: {{'value': {value.format(n='z[2]')}, 'unit': regexp_replace(lower(z[3]), 's$', ''), 'raw': trim(z[1])}})"
    return f"list_filter(list_concat({dollars}, {units}), lambda e: e.value > 0)"


def grounding_ctes(context: tuple[str, ...] = X.CONTEXT) -> str:
    """sent (claims and all), judged (one row for each claim with what each step says)."""
    c = quoted(" ".join(context))
    stop = ", ".join(map(quoted, C.STOPWORDS))
    return f"""
ctx AS (SELECT {c} AS c, lower({c}) AS lc, list_transform(regexp_extract_all({c}, {p(C.YEAR)}, 1), lambda y: CAST(y AS INT)) AS years, {numbers(c)} AS nums,
        regexp_matches({c}, {p(C.OBLIGATION, True)}) AS obliged, regexp_matches({c}, {p(C.QUANTITY, True)}) AS limited),
split AS (SELECT run_id, list_filter(list_transform(string_split_regex(output, '[.!?;]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM runs),
sent AS (SELECT run_id, generate_subscripts(ss, 1) - 1 AS n, unnest(ss) AS s FROM split),
claims AS (SELECT *, {numbers('s')} AS nums, list_distinct(list_transform(regexp_extract_all(s, {p(C.CUED_YEAR, True)}, 1), lambda y: CAST(y AS INT))) AS years,
           list_filter(string_split_regex(regexp_replace(lower(s), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2 AND w NOT IN ({stop})) AS tok
           FROM sent WHERE regexp_matches(s, {p(any_of(C.CLAIM_MARKERS), True)})),
steps AS (SELECT run_id, n, s, tok, claims.nums, claims.years,
          len(list_filter(claims.years, lambda y: NOT list_contains(ctx.years, y))) AS bad_years,
          len(list_filter(claims.nums, lambda x: len(list_filter(ctx.nums, lambda k: k.unit = x.unit AND abs(k.value - x.value) / greatest(k.value, x.value, 1) <= 0.01)) = 0)) AS bad_nums,
          regexp_matches(s, {p(any_of(C.NEGATIONS), True)}) AND ((obliged AND (regexp_matches(s, {p(C.NEGATED_OBLIGATION[0], True)}) OR regexp_matches(s, {p(C.NEGATED_OBLIGATION[1], True)}))) OR (limited AND regexp_matches(s, {p(C.NEGATED_LIMIT, True)}))) AS flip,
          CASE WHEN len(tok) > 1 THEN len(list_filter([tok[i] || ' ' || tok[i + 1] FOR i IN range(1, len(tok))], lambda b: contains(lc, b)))::DOUBLE / (len(tok) - 1) END AS pairs,
          CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda w: contains(lc, w)))::DOUBLE / len(tok) END AS singles FROM claims, ctx),
scored AS (SELECT *, CASE WHEN len(tok) = 0 THEN 1.0 WHEN len(tok) >= 4 AND pairs >= 0.55 THEN pairs ELSE singles END AS score,
           CASE WHEN len(tok) = 0 THEN true WHEN len(tok) >= 4 THEN pairs >= 0.55 OR singles >= 0.60 ELSE singles >= 0.55 END AS supported FROM steps),
found AS (SELECT run_id, n, substr(s, 1, 200) AS evidence, CASE WHEN bad_years > 0 THEN 'temporal' WHEN bad_nums > 0 THEN 'numeric' WHEN flip THEN 'negation' WHEN NOT supported THEN 'overlap' END AS step, score FROM scored),
grounded AS (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY n) - 1 AS INT) AS g, CASE WHEN step = 'numeric' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, evidence,
             CASE step WHEN 'temporal' THEN 0.9 WHEN 'numeric' THEN 0.98 WHEN 'negation' THEN 0.85 ELSE round(least(0.75, greatest(0.45, (1 - score) * 0.75)), 2) END AS confidence
             FROM found WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n) <= 3)"""


TRIM = r"^\s+|\s+$"


def grounding_by_table(name: str, key: str, context: str) -> str:
    """(key, n, bad_years, bad_nums, flip, score, supported): claims of a table against all texts of another, one by one."""
    stop = ", ".join(map(quoted, C.STOPWORDS))
    return f"""
WITH k AS (SELECT text, lower(text) AS lower, list_transform(regexp_extract_all(text, {p(C.YEAR)}, 1), lambda y: CAST(y AS INT)) AS years, {numbers('text')} AS nums FROM {context} WHERE text IS NOT NULL),
states AS (SELECT coalesce(bool_or(regexp_matches(text, {p(C.OBLIGATION, True)})), false) AS obliged, coalesce(bool_or(regexp_matches(text, {p(C.QUANTITY, True)})), false) AS limited, flatten(list(years)) AS years, flatten(list(nums)) AS nums, list(lower) AS lowers FROM k),
split AS (SELECT {key}, list_filter(list_transform(string_split_regex(text, '[.!?;]+'), lambda s: regexp_replace(s, {p(TRIM)}, '', 'g')), lambda s: s <> '') AS ss FROM {name}),
sent AS (SELECT {key}, generate_subscripts(ss, 1) - 1 AS n, unnest(ss) AS s FROM split),
claims AS (SELECT *, {numbers('s')} AS own, list_distinct(list_transform(regexp_extract_all(s, {p(C.CUED_YEAR, True)}, 1), lambda y: CAST(y AS INT))) AS said,
           list_filter(string_split_regex(regexp_replace(lower(s), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2 AND w NOT IN ({stop})) AS tok FROM sent WHERE regexp_matches(s, {p(any_of(C.CLAIM_MARKERS), True)})),
tokens AS (SELECT DISTINCT unnest(tok) AS t FROM claims), pairs AS (SELECT DISTINCT unnest([tok[i] || ' ' || tok[i + 1] FOR i IN range(1, len(tok))]) AS t FROM claims),
held AS (SELECT t FROM (SELECT * FROM tokens UNION SELECT * FROM pairs), states WHERE len(list_filter(lowers, lambda l: contains(l, t))) > 0),
shares AS (SELECT {key}, n, count(h.t) AS single FROM (SELECT {key}, n, unnest(tok) AS t FROM claims) c LEFT JOIN held h ON c.t = h.t GROUP BY ALL),
two AS (SELECT {key}, n, count(h.t) AS held_pairs FROM (SELECT {key}, n, unnest([tok[i] || ' ' || tok[i + 1] FOR i IN range(1, len(tok))]) AS t FROM claims) c LEFT JOIN held h ON c.t = h.t GROUP BY ALL),
steps AS (SELECT {key}, n, tok, len(list_filter(said, lambda y: NOT coalesce(list_contains(states.years, y), false))) AS bad_years,
  len(list_filter(own, lambda x: coalesce(len(list_filter(states.nums, lambda k: k.unit = x.unit AND abs(k.value - x.value) / greatest(k.value, x.value, 1) <= 0.01)), 0) = 0)) AS bad_nums,
  regexp_matches(s, {p(any_of(C.NEGATIONS), True)}) AND ((obliged AND (regexp_matches(s, {p(C.NEGATED_OBLIGATION[0], True)}) OR regexp_matches(s, {p(C.NEGATED_OBLIGATION[1], True)}))) OR (limited AND regexp_matches(s, {p(C.NEGATED_LIMIT, True)}))) AS flip,
  coalesce(held_pairs, 0) / nullif(len(tok) - 1, 0) AS by_pair, coalesce(single, 0) / nullif(len(tok), 0) AS by_word FROM claims LEFT JOIN shares USING ({key}, n) LEFT JOIN two USING ({key}, n), states)
SELECT {key}, n, bad_years, bad_nums, flip, round(CASE WHEN len(tok) = 0 THEN 1.0 WHEN len(tok) >= 4 AND by_pair >= 0.55 THEN by_pair ELSE by_word END, 6) AS score,
  CASE WHEN len(tok) = 0 THEN true WHEN len(tok) >= 4 THEN by_pair >= 0.55 OR by_word >= 0.60 ELSE by_word >= 0.55 END AS supported FROM steps"""


def runs(*more: str) -> str:
    return "WITH " + ", ".join([f"runs AS ({X.RUNS_SQL})", *more])


def rule_rows(rule: str) -> str:
    """(run_id, g, severity, description, evidence) of any rule but grounding."""
    return {"block_pii_leakage": pii_rows, "block_financial_advice": financial_rows, "require_human_approval": approval_rows}.get(rule, lambda: group_rows(rule))()


def rule_query(rule: str) -> str:
    return f"{runs(f'v AS ({rule_rows(rule)})')} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY g) - 1 AS INT) AS ord, severity, description, evidence FROM v"


def all_rows(rules: tuple[str, ...] = C.RULES) -> str:
    """CTEs up to ``v``: (run_id, r, g, rule, severity, evidence) of all the rules."""
    parts = [f"SELECT run_id, {i} AS r, g, {quoted(rule)} AS rule, severity, evidence FROM ({rule_rows(rule) if rule != 'block_hallucination' else 'SELECT run_id, g, severity, evidence FROM grounded'})" for i, rule in enumerate(rules)]
    return ", ".join([*([grounding_ctes()] if "block_hallucination" in rules else []), f"v AS ({' UNION ALL '.join(parts)})"])


def long_query(rules: tuple[str, ...] = C.RULES) -> str:
    return f"{runs(all_rows(rules))} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY r, g) - 1 AS INT) AS ord, rule, severity, evidence FROM v"


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


def verdict_ctes(mode: str = "enforce", rules: tuple[str, ...] = C.RULES) -> str:
    """CTEs up to ``verdicts``."""
    block = {"enforce": "nv > 0", "shadow": "false", "degraded": "coalesce(top, 0) >= 3"}[mode]
    return f"""{runs(all_rows(rules))},
agg AS (SELECT run_id, count(*) AS nv, max({RANK}) AS top, string_agg('"' || rule || '"', ', ' ORDER BY r, g) AS quoted_rules, first(rule ORDER BY r, g) AS first_rule, list(rule ORDER BY r, g) AS rules FROM v GROUP BY run_id),
verdicts AS (SELECT runs.*, 'run-' || CAST(runs.run_id AS VARCHAR) AS audit_id, runs.run_id AS line_no, coalesce(nv, 0) AS n_violations, quoted_rules, first_rule, rules,
             CASE WHEN nv > 0 THEN ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][top] WHEN n_steps > 10 OR total_ms > 30000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
             coalesce({block}, false) AND coalesce(nv, 0) > 0 AS blocked, {"coalesce(nv, 0) > 0 AND NOT (" + block + ")" if mode == "degraded" else "false"} AS degraded
             FROM runs LEFT JOIN agg ON runs.run_id = agg.run_id)"""


def on_verdicts(select: str, mode: str = "enforce", rules: tuple[str, ...] = C.RULES) -> str:
    return f"{verdict_ctes(mode, rules)} {select}"


def entity_ctes() -> str:
    """CTEs up to ``ents``: (pipeline_id, stage, stage_ord, k, i, type, value, number, unit, raw)."""

    def groups(kind: str, n: int) -> str:
        pattern, ci = C.ENTITIES[kind]
        return ", ".join(f"unnest(regexp_extract_all(text, {p(pattern, ci)}, {i})) AS g{i}" for i in range(n + 1)) + f", generate_subscripts(regexp_extract_all(text, {p(pattern, ci)}, 0), 1) AS i"

    number = "coalesce(try_cast(replace(g1, ',', '') AS DOUBLE), 0)"
    plain = r"regexp_replace(regexp_replace(regexp_replace(replace(g1, ',', ''), '^0+([0-9])', '\1'), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"
    unit = "regexp_replace(lower(g2), 's$', '')"
    pad = lambda c: f"CASE WHEN len({c}) < 2 THEN lpad({c}, 2, '0') ELSE {c} END"
    none = "CAST(NULL AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS unit"
    rows = [
        ("person", 2, "person", f"lower(g1) || ' ' || lower(g2) AS value, {none}", "true"),
        ("dollars", 1, "amount", f"{plain} || ':usd' AS value, {number} AS number, 'usd' AS unit", f"{number} > 0"),
        ("unit", 2, "amount", f"{plain} || ':' || {unit} AS value, {number} AS number, {unit} AS unit", f"{number} > 0"),
        ("iso", 1, "date", f"g1 AS value, {none}", "true"),
        ("human", 3, "date", f"g3 || '-' || lower(substr(g1, 1, 3)) || '-' || {pad('g2')} AS value, {none}", "true"),
        ("dmy", 3, "date", f"g3 || '-' || {pad('g2')} || '-' || {pad('g1')} AS value, {none}", "true"),
        ("id", 1, "id", f"upper(g1) AS value, {none}", "true"),
        ("org", 1, "org", f"lower(g1) AS value, {none}", "true"),
    ]
    parts = [f"SELECT pipeline_id, stage, ord AS stage_ord, {k} AS k, i, '{t}' AS type, {v}, trim(g0) AS raw FROM (SELECT *, {groups(kind, n)} FROM stages) WHERE {where}" for k, (kind, n, t, v, where) in enumerate(rows)]
    return f"WITH stages AS ({X.STAGES_SQL}), ents AS ({' UNION ALL '.join(parts)})"


def contradiction_ctes() -> str:
    return f"""{entity_ctes()},
once AS (SELECT pipeline_id, type, coalesce(unit, '') AS unit, stage, stage_ord, value, first(raw ORDER BY k, i) AS raw, first(number ORDER BY k, i) AS number FROM ents GROUP BY ALL),
pairs AS (SELECT a.pipeline_id, a.type, a.stage AS stage_a, a.value AS value_a, a.raw AS raw_a, b.stage AS stage_b, b.value AS value_b, b.raw AS raw_b,
          CASE a.type WHEN 'amount' THEN 0.95 WHEN 'person' THEN 0.88 WHEN 'date' THEN 0.90 WHEN 'id' THEN 0.92 ELSE 0.75 END AS confidence,
          CASE WHEN a.type IN ('amount', 'id') THEN 'CRITICAL' WHEN a.type IN ('person', 'date') THEN 'HIGH' ELSE 'MEDIUM' END AS severity
          FROM once a JOIN once b ON a.pipeline_id = b.pipeline_id AND a.type = b.type AND a.unit = b.unit AND a.stage_ord < b.stage_ord
          WHERE CASE a.type WHEN 'amount' THEN abs(a.number - b.number) / greatest(a.number, b.number, 1) > 0.01 WHEN 'person' THEN string_split(a.value, ' ')[-1] <> string_split(b.value, ' ')[-1] ELSE a.value <> b.value END)"""
