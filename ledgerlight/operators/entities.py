"""Entities in stage outputs, and contradictions between the stages of a pipeline.

Extraction is a narrow projection of arrays. Contradictions are an equi-join on (pipeline, type, unit), with distinct
values of a stage joined instead of all their mentions: the pairs are told apart by stage and value only, so later
mentions add nothing and a value that is named a thousand times costs as much as one.

Where only their number is wanted no pairs are made: it is all pairs of stages less those that agree, both from counts of
equal groups. Amounts agree within one per cent, so they are counted by windows over the logarithm in buckets of that
width, and only amounts just at the edge are compared one by one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import ENTITIES
from ..functions.stems import holds_any, stems_of
from ..sources.storage import checkpointed
from .scan import all_matches

#: type: (confidence, severity) of a contradiction.
WEIGHTS = {"amount": (0.95, "CRITICAL"), "person": (0.88, "HIGH"), "date": (0.90, "HIGH"), "id": (0.92, "CRITICAL"), "org": (0.75, "MEDIUM")}


def _groups(text: Column, kind: str, n: int) -> Column:
    """The matches of a kind by their groups, searched for only in texts that hold one of the pattern's stems."""
    pattern, ignore_case = ENTITIES[kind]
    found = F.arrays_zip(*[all_matches(text, pattern, ignore_case, i).alias(f"g{i}") for i in range(n + 1)])
    some = stems_of((pattern,))
    none = F.array().cast(f"array<struct<{','.join(f'g{i}:string' for i in range(n + 1))}>>")
    return found if some is None else F.when(holds_any(text, some), found).otherwise(none)


def _entity(kind: str, raw: Column, value: Column, number: Column | None = None, unit: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        value.alias("value"),
        (number if number is not None else F.lit(None)).cast("double").alias("number"),
        (unit if unit is not None else F.lit(None)).cast("string").alias("unit"),
        F.trim(raw).alias("raw"),
    )


def _number(text: Column) -> Column:
    """The number as it is written: no trailing zeros, never in exponents below 10^15."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ",", ""), r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def entities_of(text: Column) -> Column:
    """array<struct<type,value,number,unit,raw>> in the order persons, dollars, units, dates (ISO, written, D/M/Y), ids, organisations."""
    pad = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    unit = lambda c: F.regexp_replace(F.lower(c), "s$", "")
    amount = lambda g, u: _entity("amount", g["g0"], F.concat(_number(g["g1"]), F.lit(":"), u), number(g["g1"]), u)
    positive = lambda a: F.filter(a, lambda e: e["number"] > 0)
    return F.concat(
        F.transform(_groups(text, "person", 2), lambda g: _entity("person", g["g0"], F.concat(F.lower(g["g1"]), F.lit(" "), F.lower(g["g2"])))),
        positive(F.transform(_groups(text, "dollars", 1), lambda g: amount(g, F.lit("usd")))),
        positive(F.transform(_groups(text, "unit", 2), lambda g: amount(g, unit(g["g2"])))),
        F.transform(_groups(text, "iso", 1), lambda g: _entity("date", g["g0"], g["g1"])),
        F.transform(_groups(text, "human", 3), lambda g: _entity("date", g["g0"], F.concat_ws("-", g["g3"], F.lower(F.substring(g["g1"], 1, 3)), pad(g["g2"])))),
        F.transform(_groups(text, "dmy", 3), lambda g: _entity("date", g["g0"], F.concat_ws("-", g["g3"], pad(g["g2"]), pad(g["g1"])))),
        F.transform(_groups(text, "id", 1), lambda g: _entity("id", g["g0"], F.upper(g["g1"]))),
        F.transform(_groups(text, "org", 1), lambda g: _entity("org", g["g0"], F.lower(g["g1"]))),
    )


def stage_outputs(stages: DataFrame, pipeline: str = "pipeline_id", stage: str = "stage", text: str = "text", order: str = "ord") -> DataFrame:
    """One row for each stage of a pipeline: the last text given, at the place where the stage came first; nulls are skipped."""
    given = stages.filter(F.col(text).isNotNull())
    return given.groupBy(F.col(pipeline).alias("pipeline_id"), F.col(stage).alias("stage")).agg(F.max_by(text, order).alias("text"), F.min(order).alias("ord"))


def extract(outputs: DataFrame) -> DataFrame:
    """Rows (pipeline_id, stage, stage_ord, pos, type, value, number, unit, raw) from stage_outputs."""
    found = outputs.select("pipeline_id", "stage", F.col("ord").alias("stage_ord"), F.posexplode_outer(entities_of(F.col("text"))).alias("pos", "e"))
    return found.filter("pos is not null").select("pipeline_id", "stage", "stage_ord", "pos", "e.*")


def _apart(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.greatest(x, y, F.lit(1.0)) > 0.01


def _differ(a: str, b: str) -> Column:
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    kind = x("type")
    apart = _apart(x("number"), y("number"))
    surname = lambda c: F.element_at(F.split(c, " "), -1)
    return F.when(kind == "amount", apart).when(kind == "person", surname(x("value")) != surname(y("value"))).otherwise(x("value") != y("value"))


def once_a_stage(entities: DataFrame) -> DataFrame:
    """(pipeline_id, type, unit, stage, stage_ord, value, raw, number, mentions): the distinct values of each stage."""
    first = F.min(F.struct("pos", "raw", "number"))
    once = entities.groupBy("pipeline_id", "type", F.coalesce("unit", F.lit("")).alias("unit"), "stage", "stage_ord", "value").agg(first.alias("f"), F.count("*").alias("mentions"))
    return once.select("pipeline_id", "type", "unit", "stage", "stage_ord", "value", "f.raw", "f.number", "mentions")


def contradictions(entities: DataFrame) -> DataFrame:
    """(pipeline_id, type, stage_a, value_a, raw_a, stage_b, value_b, raw_b, confidence, severity); a comes before b."""
    once = once_a_stage(entities).drop("mentions")
    pair = (F.col("a.pipeline_id") == F.col("b.pipeline_id")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.unit") == F.col("b.unit")) & (F.col("a.stage_ord") < F.col("b.stage_ord"))
    both = once.alias("a").join(once.alias("b"), pair & _differ("a", "b"))
    weigh = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, w in WEIGHTS.items() for x in (k, w[i])]), F.col("a.type"))
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("stage", "value", "raw")]
    return both.select(F.col("a.pipeline_id").alias("pipeline_id"), F.col("a.type").alias("type"), *side("a"), *side("b"), weigh(0).alias("confidence"), weigh(1).alias("severity"))


def _unequal_pairs(rows: DataFrame) -> DataFrame:
    """(pipeline_id, twice): twice the pairs of different stages and different ``key``, by squares of the groups' sizes."""
    group = ["pipeline_id", "type", "unit"]
    sizes = rows.groupingSets([group, [*group, "stage_ord"], [*group, "key"], [*group, "stage_ord", "key"]], *group, "stage_ord", "key")
    sizes = sizes.agg(F.count("*").alias("n"), F.grouping("stage_ord").alias("no_stage"), F.grouping("key").alias("no_key"))
    sign = F.when(F.col("no_stage") == F.col("no_key"), 1).otherwise(-1)
    return sizes.groupBy("pipeline_id").agg(F.sum(sign * F.col("n") * F.col("n")).alias("twice"))


#: Width of a bucket of the logarithm, in which amounts within one per cent of each other lie at most one apart; how near the
#: edge a pair is compared by itself.
_PERCENT, _EDGE = -math.log(0.99), 1e-9


def _near_pairs(amounts: DataFrame, *group: str) -> DataFrame:
    """(pipeline_id, twice): twice the pairs of amounts within one per cent, or within 0.01 if both are below one."""
    values = amounts.groupBy(*group, "number").agg(F.count("*").alias("n"))

    def counted(rows: DataFrame, place: Column, own: Column) -> DataFrame:
        placed = rows.withColumns({"h": place, "own": own}).withColumn("bucket", F.floor("h"))
        # Each bucket also sees the amounts of the one below.
        both = placed.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"bucket": F.col("bucket") + F.col("d"), "own": F.col("own") & (F.col("d") == 0)})
        over = lambda what, frame: F.expr(f"{what} OVER (PARTITION BY {', '.join(group)}, bucket ORDER BY h RANGE BETWEEN {frame})")
        seen = both.withColumns(
            {
                "inside": over("sum(n)", f"{1 - 2 * _EDGE}D PRECEDING AND CURRENT ROW"),
                "equal": over("sum(n)", "CURRENT ROW AND CURRENT ROW"),
                "edge": over("collect_list(struct(h, number, n))", f"{1 + _EDGE}D PRECEDING AND {1 - 2 * _EDGE}D PRECEDING"),
            }
        ).filter("own")
        at_edge = F.aggregate(F.filter("edge", lambda e: (e["h"] < F.col("h") - F.lit(1 - 2 * _EDGE)) & ~_apart(e["number"], F.col("number"))), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
        return seen.select("pipeline_id", (F.col("n") * (2 * (F.col("inside") - F.col("equal") + at_edge) + F.col("equal") - 1)).alias("twice"))

    number = F.col("number")
    large = counted(values, F.ln(number) / _PERCENT, number >= 1)
    small = counted(values.filter(number < 1), number / 0.01, F.lit(True))
    return large.unionByName(small).groupBy("pipeline_id").agg(F.sum("twice").alias("twice"))


def contradiction_counts(once: DataFrame) -> DataFrame:
    """(pipeline_id, n_contradictions) of ``once_a_stage``, as many as ``contradictions`` has rows, without making pairs."""
    surname = F.element_at(F.split("value", " "), -1)
    named = once.filter("type <> 'amount'").withColumn("key", F.when(F.col("type") == "person", surname).otherwise(F.col("value")))
    amounts = once.filter("type = 'amount'")
    # All pairs of different stages, less the near ones, which those within one stage aren't of.
    parts = [_unequal_pairs(named), _unequal_pairs(amounts.withColumn("key", F.col("stage_ord").cast("string")))]
    parts += [_near_pairs(amounts, "pipeline_id", "unit").withColumn("twice", -F.col("twice")), _near_pairs(amounts, "pipeline_id", "unit", "stage_ord")]
    return reduce(DataFrame.unionByName, parts).groupBy("pipeline_id").agg((F.sum("twice") / 2).cast("bigint").alias("n_contradictions"))


def consistency(outputs: DataFrame) -> DataFrame:
    """One row for each pipeline: stages, entities, contradictions (counts) and consistent."""
    once = checkpointed(once_a_stage(extract(outputs)))  # read by each count; texts are searched once
    stages = outputs.groupBy("pipeline_id").agg(F.count("*").alias("n_stages"))
    n = once.groupBy("pipeline_id").agg(F.sum("mentions").alias("n_entities"))
    all_of = stages.join(n, "pipeline_id", "left").join(contradiction_counts(once), "pipeline_id", "left").fillna(0, ["n_entities", "n_contradictions"])
    return all_of.withColumn("consistent", F.col("n_contradictions") == 0)
