"""Rule scan: text in, ordered violations out, as native column expressions.

A violation is a struct (rule, description, evidence, severity, remediation, confidence). Every rule is one narrow
projection, so a scan of any number of rules is one stage without a shuffle. Patterns run only on texts that hold
one of their literal stems; which stems of all the rules a text holds is found in one pass over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as C
from ..functions.patterns import any_of, translate
from ..functions.stems import held, held_any, holds_any, stems_of

VIOLATION = "struct<rule:string,description:string,evidence:string,severity:string,remediation:string,confidence:double>"
REMEDIATION = {
    "block_pii_leakage": "Redact or tokenise personal data before the output leaves the agent.",
    "block_special_category_data": "Redact special category data unless there is a documented legal basis.",
    "block_manipulation": "State the facts without pressure.",
    "block_medical_advice": "Refer to a qualified healthcare professional.",
    "block_legal_advice": "Refer to a qualified lawyer.",
    "block_discriminatory_output": "Decide without regard to protected characteristics and log for a bias audit.",
    "block_prompt_injection": "Sanitise external inputs and review the run.",
    "block_system_prompt_leakage": "Keep prompts and configuration out of outputs.",
    "block_ai_identity_deception": "Disclose that the speaker is an AI.",
    "block_hallucination": "Check the claim against the source documents.",
}


@dataclass(frozen=True)
class Options:
    """What rules may be told: the amount from which approval is due, and the context documents for grounding."""

    threshold: float = 1000.0
    context: tuple[str, ...] = ()
    #: What ``held`` found of a vocabulary of stems, and that, where a scan of many rules has looked for them all at once.
    stems: tuple[Column, frozenset[str]] | None = field(default=None, repr=False, compare=False)


@dataclass(frozen=True)
class Rule:
    """A custom rule: ``check(text, options)`` gives an array of violations."""

    name: str
    check: Callable[[Column, Options], Column] = field(repr=False)
    description: str = ""


def java(pattern: str, ignore_case: bool = False) -> str:
    return translate(pattern, "java", ignore_case)


def violation(rule: str, description: Column | str, evidence: Column | None, severity: Column | str, confidence: Column | None = None, remediation: str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(rule).alias("rule"),
        lit(description).alias("description"),
        (evidence if evidence is not None else F.lit(None)).cast("string").alias("evidence"),
        lit(severity).alias("severity"),
        F.lit(remediation or REMEDIATION.get(rule)).cast("string").alias("remediation"),
        (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
    )


def where(values: Column, make: Callable[[Column], Column], test: Callable[[Column], Column]) -> Column:
    """The violations that ``make`` gives for the elements that pass ``test``; a value is computed once."""
    return F.transform(F.filter(values, test), make)


def nothing() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def likely(text: Column, patterns: Iterable[str], o: Options | None = None) -> Column | None:
    """Whether one of the patterns may match ``text``; None if there is no telling."""
    some = stems_of(tuple(patterns))
    if some is None or o is None or o.stems is None or not some <= o.stems[1]:
        return None if some is None else holds_any(text, some)
    return held_any(*o.stems, some)


def if_likely(text: Column, patterns: Iterable[str], found: Column, o: Options | None = None) -> Column:
    """``found``, worked out only where one of the patterns may match ``text``, else nothing."""
    test = likely(text, patterns, o)
    return found if test is None else F.when(test, found).otherwise(nothing())


def all_matches(text: Column, pattern: str, ignore_case: bool = False, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group))


def first_match(text: Column, patterns: Sequence[str], exact: Iterable[int] = (), o: Options | None = None) -> Column:
    """The first pattern's match in the order of the list, not of the text; empty if none matches."""
    found = [F.nullif(F.regexp_extract(text, java(p, i not in exact), 0), F.lit("")) for i, p in enumerate(patterns)]
    if len(patterns) > 1 and o is not None and o.stems is not None:  # a list is likely for one of its patterns mostly
        tests = [likely(text, (p,), o) for p in patterns]
        found = [f if t is None else F.when(t, f) for t, f in zip(tests, found, strict=True)]
    return F.coalesce(*found, F.lit(""))


def group_rule(rule: str) -> Callable[[Column, Options], Column]:
    def check(text: Column, o: Options) -> Column:
        def one(group: C.Group) -> Column:
            cut = (lambda m: m) if group.cut is None else (lambda m: F.substring(m, 1, group.cut))
            found = where(F.array(first_match(text, group.patterns, group.exact, o)), lambda m: violation(rule, group.description, cut(m), group.severity), lambda m: m != "")
            return if_likely(text, group.patterns, found, o)

        found = F.concat(*[one(g) for g in C.GROUPS[rule]])
        if rule == "block_ai_identity_deception":
            allowed = F.lower(text).rlike(any_of([a.lower() for a in C.IDENTITY_ALLOWED]))
            return if_likely(text, [p for g in C.GROUPS[rule] for p in g.patterns], F.when(allowed, nothing()).otherwise(found), o)
        return found

    return check


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the Luhn test."""
    digits = F.reverse(F.split(F.regexp_replace(number, r"\D", ""), ""))
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    worth = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, double(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mask_email(email: Column) -> Column:
    """Keeps three characters and what follows the last @; a local part of at most three stays as it is."""
    return F.regexp_replace(email, r"(?<=.{3}).+(?=@)", "***")


def pii_matches(text: Column, kind: str, o: Options | None = None) -> Column:
    found = all_matches(text, C.PII[kind])
    found = F.filter(found, luhn) if kind == "cc" else found
    test = likely(text, (C.PII[kind],), o)
    return found if test is None else F.when(test, found).otherwise(F.array().cast("array<string>"))


def _pii_kind(text: Column, kind: str, o: Options) -> Column:
    name, severity, fixed = C.PII_TEXTS[kind]
    masked = mask_email if kind == "email" else lambda _: F.lit("***-***-****")

    def report(m: Column) -> Column:
        evidence = F.lit(fixed) if fixed else F.array_join(F.transform(F.slice(m, 1, 2), masked), ", ")
        return violation("block_pii_leakage", F.concat(F.lit("Output contains "), F.size(m).cast("string"), F.lit(f" {name}")), evidence, severity)

    return where(F.array(pii_matches(text, kind, o)), report, lambda m: F.size(m) > 0)


def pii(text: Column, o: Options) -> Column:
    return F.concat(*[_pii_kind(text, kind, o) for kind in C.PII_TEXTS])


def amount_of(raw: Column) -> Column:
    """The number in a money text as a double: other characters dropped, 0 if nothing parses (a second point ends it)."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(raw, "[^0-9.]", ""), r"^\d*\.?\d*", 0).try_cast("double"), F.lit(0.0))


def financial(text: Column, o: Options) -> Column:
    rule = "block_financial_advice"
    words = where(
        F.array(all_matches(text, any_of(C.FINANCIAL_PHRASES), True)),
        lambda m: violation(rule, F.concat(F.lit('Output contains financial advice language: "'), F.array_join(F.slice(m, 1, 2), '", "'), F.lit('"')), F.array_join(F.slice(m, 1, 3), ", "), "HIGH"),
        lambda m: F.size(m) > 0,
    )
    large = F.slice(F.filter(all_matches(text, C.TRANSACTION), lambda a: amount_of(a) >= o.threshold), 1, 1)
    money = F.transform(large, lambda a: violation(rule, F.concat(F.lit("Output references transaction of "), a, F.lit(f" which exceeds threshold of ${plain(o.threshold)}")), a, F.when(amount_of(a) >= 10_000, "CRITICAL").otherwise("HIGH")))
    return F.concat(if_likely(text, [any_of(C.FINANCIAL_PHRASES)], words, o), if_likely(text, [C.TRANSACTION], money, o))


def largest_amount(text: Column) -> Column:
    amounts = F.transform(all_matches(text, C.APPROVAL_AMOUNT, True, 1), lambda a: F.coalesce(F.regexp_replace(a, ",", "").try_cast("double"), F.lit(0.0)))
    return F.coalesce(F.array_max(amounts), F.lit(0.0))


def approval(text: Column, o: Options, approved_phrase: Column | None = None, approved_amount: Column | None = None) -> Column:
    """Needs of approval that nobody has granted yet; the two columns say what has been."""
    rule = "require_human_approval"
    pending = lambda given: F.lit(True) if given is None else ~F.coalesce(given, F.lit(False))
    phrase = where(F.array(F.regexp_extract(text, java(any_of(C.APPROVAL_PHRASES), True), 0)), lambda m: violation(rule, F.concat(F.lit('High-impact action detected: "'), m, F.lit('". Human approval required.')), m, "HIGH"), lambda m: (m != "") & pending(approved_phrase))
    written = lambda a: F.call_function("format_number", a, F.lit("#,##0.###"))
    amount = where(
        F.array(largest_amount(text)),
        lambda a: violation(rule, F.concat(F.lit("Transaction amount $"), written(a), F.lit(f" exceeds approval threshold of ${grouped(o.threshold)}")), F.concat(F.lit("$"), written(a)), F.when(a >= 10_000, "CRITICAL").otherwise("HIGH")),
        lambda a: (a >= o.threshold) & pending(approved_amount),
    )
    # No amount counts as zero, which reaches a threshold of zero.
    return F.concat(if_likely(text, [any_of(C.APPROVAL_PHRASES)], phrase, o), amount if o.threshold <= 0 else if_likely(text, [C.APPROVAL_AMOUNT], amount, o))


def _grounding(text: Column, o: Options) -> Column:
    from .grounding import hallucination

    return hallucination(text, o)


CHECKS: dict[str, Callable[[Column, Options], Column]] = {
    "block_pii_leakage": pii,
    "block_financial_advice": financial,
    "block_hallucination": _grounding,
    "require_human_approval": approval,
} | {name: group_rule(name) for name in C.GROUPS}
#: The lists of patterns that each rule may ask ``likely`` of.
PATTERNS: dict[str, list[tuple[str, ...]]] = {
    "block_pii_leakage": [(p,) for p in C.PII.values()],
    "block_financial_advice": [(any_of(C.FINANCIAL_PHRASES),), (C.TRANSACTION,)],
    "block_hallucination": [(any_of(C.CLAIM_MARKERS),)],
    "require_human_approval": [(any_of(C.APPROVAL_PHRASES),), (C.APPROVAL_AMOUNT,)],
} | {name: [*(g.patterns for g in groups), *((p,) for g in groups for p in g.patterns), tuple(p for g in groups for p in g.patterns)] for name, groups in C.GROUPS.items()}
#: From how many stems on one pass for all is less work than a search for each.
MANY_STEMS = 32


def _vocabulary(rules: Iterable[Rule]) -> frozenset[str]:
    each = [stems_of(patterns) for r in rules if r.check is CHECKS.get(r.name) for patterns in PATTERNS[r.name]]
    return frozenset().union(*[some for some in each if some is not None])


def _with_stems(text: Column, rules: list[Rule], options: Options | None, make: Callable[[Options], Column]) -> Column:
    """What ``make`` gives with options that tell the stems ``text`` holds; bound in a lambda, so that they are found once."""
    options, vocabulary = options or Options(), _vocabulary(rules)
    if len(vocabulary) < MANY_STEMS:
        return make(options)
    return F.element_at(F.transform(F.array(held(text, vocabulary)), lambda found: make(replace(options, stems=(found, vocabulary)))), 1)


def checked(rule: Rule, text: Column, o: Options) -> Column:
    """A rule's violations; where a text's stems are known, the whole rule is left out if none of its patterns may match."""
    built_in = rule.check is CHECKS.get(rule.name) and not (rule.name == "require_human_approval" and o.threshold <= 0)
    if o.stems is None or not built_in:
        return rule.check(text, o)
    return if_likely(text, [p for patterns in PATTERNS[rule.name] for p in patterns], rule.check(text, o), o)


def resolve_rules(rules: Iterable[str | Rule], aliases: bool = False) -> list[Rule]:
    """Names and custom rules to rules; raises on unknown names and on things that aren't rules."""
    found = []
    for r in rules:
        if isinstance(r, str):
            name = C.ALIASES.get(r, r) if aliases else r
            if name not in CHECKS:
                raise ValueError(f"unknown rule {r!r}; known are {', '.join(C.RULES)}")
            found.append(Rule(name, CHECKS[name]))
        elif isinstance(getattr(r, "name", None), str) and callable(getattr(r, "check", None)):
            found.append(r)
        else:
            raise ValueError("a custom rule needs a name and a check(text, options)")
    return found


def make_rule(name: str, check: Callable[[Column, Options], Column], description: str = "") -> Rule:
    return Rule(name, check, description)


def scanned_text(output: str | Column = "output") -> Column:
    """A null output is scanned as the text null."""
    return F.coalesce((F.col(output) if isinstance(output, str) else output).cast("string"), F.lit("null"))


def output_text(runs: DataFrame, output: str = "output") -> Column:
    """What is scanned of a column: a text as it is, an object or list as its JSON, null as the text null."""
    nested = isinstance(runs.schema[output].dataType, (T.StructType, T.MapType, T.ArrayType))
    return scanned_text(F.to_json(F.col(output), {"ignoreNullFields": "false"}) if nested else output)


def plain(number: float) -> str:
    """A number as texts write it: without an exponent or needless decimals."""
    return str(int(number)) if number == int(number) else repr(float(number))


def grouped(number: float) -> str:
    """With groups of thousands and up to three decimals."""
    return f"{number:,.3f}".rstrip("0").rstrip(".")


def once(column: Column) -> Column:
    """``column``, as a generator of one value: what reads it later, filters above all, doesn't work it out again."""
    return F.explode_outer(F.array(column))


def violations_of(text: Column, rules: Iterable[str | Rule], options: Options | None = None) -> Column:
    """All rules' violations over ``text``, in the order of the rules."""
    rules = resolve_rules(rules)
    return _with_stems(text, rules, options, lambda o: F.concat(*[checked(r, text, o) for r in rules])) if rules else nothing()


def scan(runs: DataFrame, rules: Iterable[str | Rule], options: Options | None = None, output: str = "output") -> DataFrame:
    """``runs`` with a column ``violations``."""
    return runs.withColumn("__text", output_text(runs, output)).withColumn("violations", once(violations_of(F.col("__text"), rules, options))).drop("__text")


def catalog_table(spark: SparkSession) -> DataFrame:
    """(name, rule, ord, bundles): every name that a rule may be asked for by, and the bundles that hold the rule."""
    names = {r: r for r in C.RULES} | C.ALIASES
    rows = [(n, r, C.RULES.index(r), sorted(b for b, own in C.BUNDLES.items() if n in own or r in own)) for n, r in names.items()]
    return spark.createDataFrame(rows, "name string, rule string, ord int, bundles array<string>")


def named_rules(runs: DataFrame, *keys: str, names: str = "rules", more: Iterable[Rule] = ()) -> DataFrame:
    """(keys, pos, name, rule): what each run asks for, and the rule that answers to it; null if none does."""
    known = catalog_table(runs.sparkSession).select("name", "rule")
    own = [(r.name, r.name) for r in more]
    known = known.unionByName(runs.sparkSession.createDataFrame(own, "name string, rule string")) if own else known
    asked = runs.select(*keys, F.posexplode_outer(names).alias("pos", "name")).filter("pos is not null")
    return asked.join(F.broadcast(known), "name", "left").select(*keys, "pos", "name", "rule")  # the catalog: a row for each name


def unknown_names(runs: DataFrame, *keys: str, names: str = "rules", more: Iterable[Rule] = ()) -> DataFrame:
    """(keys, name): names that no rule answers to."""
    return named_rules(runs, *keys, names=names, more=more).filter("rule is null").select(*keys, "name")


def scan_named(runs: DataFrame, names: str = "rules", options: Options | None = None, output: str = "output", more: Iterable[Rule] = ()) -> DataFrame:
    """``runs`` with a column ``violations`` by the rules that each run names itself, in its order.

    Names may be aliases; those that no rule answers to find nothing (``unknown_names`` tells them), nor does a null list.
    Still one projection: a rule is worked out only on the runs that name it.
    """
    book = [*resolve_rules(C.RULES), *more]
    aliases = F.create_map(*[F.lit(x) for pair in C.ALIASES.items() for x in pair])
    asked = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.coalesce(F.element_at(aliases, n), n))
    made = runs.withColumns({"__text": output_text(runs, output), "__asked": asked})
    found = lambda o: F.array(*[F.when(F.array_contains("__asked", r.name), r.check(F.col("__text"), o)).otherwise(nothing()) for r in book])
    by_rule = F.map_from_arrays(F.array(*[F.lit(r.name) for r in book]), _with_stems(F.col("__text"), book, options, found))
    # Bound in a lambda, so that the map is made once for a run and not for each of its names.
    every = F.element_at(F.transform(F.array(by_rule), lambda m: F.flatten(F.transform("__asked", lambda n: F.coalesce(F.element_at(m, n), nothing())))), 1)
    return made.withColumn("violations", once(every)).drop("__text", "__asked")


def exploded(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row for each violation: keys, ord (from 0), and the violation's fields.

    The outer form, as for the inner one the optimizer puts a filter on the array's size below, which scans all texts twice.
    """
    return scanned.select(*keys, F.posexplode_outer("violations").alias("ord", "v")).filter("ord is not null").select(*keys, "ord", "v.*")


def lite_violations(text: Column, rules: Iterable[str] = C.RULES) -> Column:
    """The lite dialect: fewer patterns, one finding for each rule, evidence unmasked."""
    parts = []
    for rule in rules:
        if rule not in C.LITE:
            raise ValueError(f"unknown rule {rule!r}")
        if not C.LITE[rule]:
            continue
        tests = [(F.regexp_extract(text, java(p, not exact), 0), d, s) for p, d, s, exact in C.LITE[rule]]
        hit = F.coalesce(*[F.when(m != "", violation(rule, d, None if rule in C.LITE_SILENT else F.substring(m, 1, 80), s, remediation="")) for m, d, s in tests])
        found = F.filter(F.array(hit), lambda v: v.isNotNull())
        if rule == "block_ai_identity_deception":
            found = F.when(text.rlike(any_of(C.LITE_IDENTITY_ALLOWED)), nothing()).otherwise(found)
        parts.append(if_likely(text, [p for p, *_ in C.LITE[rule]], found))
    return F.concat(*parts) if parts else nothing()
