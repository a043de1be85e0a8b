"""Operator 9: license scans, in DataFrame functions only.

A text's units (its lines, and the whole text where it has more than one line) are normalised to lower-case words and
compared with licence templates by the Dice coefficient over their sets of word bigrams. With threshold t, a unit of n
bigrams can only match a template of b bigrams if b * t / (2 - t) <= n <= b * (2 - t) / t: units outside all these
bounds go before their bigrams are made, and each unit meets only the templates whose bounds it is in. By the same bounds a
match has at least t / (2 - t) of a template's bigrams, so texts without any of its few longest ones go first.

Notices that are wrapped over several lines of a longer text are found as blocks: successive lines (those without words
don't count) that together have at most one word more than a template may have bigrams. Only templates of whose bigrams
the whole text has enough are looked for, from lines in which one of them begins; the best block of each first line
counts (of equals the shortest), unless a better block of the licence overlaps it (of equals the shorter, then the
earlier). A block of one line, or of all lines, is reported as that line or as the whole text.

Defined results: null and empty texts have no licence; ties between templates go to the smaller name, between units to
the earlier one; repeated rows give a row each; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, text_or_empty

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
#: First lines that are looked at together, so that a long text is never copied for each of its lines.
CHUNK_LINES = 64
#: Licence notices and short licence texts by name. Their wording is that of the licences.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    import re

    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Numbers of bigrams that a unit may have to reach the threshold with a template of ``n`` bigrams."""
    low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return int(-(-(low - 1e-9) // 1)), int((high + 1e-9) // 1)


def telling(pairs: list[str], threshold: float = THRESHOLD) -> list[str]:
    """The longest bigrams of a template, as many as a match can't all lack: it has at least t / (2 - t) of them."""
    needed = size_bounds(len(pairs), threshold)[0]
    return sorted(pairs, key=lambda p: (-len(p), p))[: len(pairs) - needed + 1]


def words_of(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), "[^a-z0-9]+"), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def template_sets(threshold: float, templates: dict[str, str] | None) -> tuple[dict[str, list[str]], dict[str, tuple[int, int]], str]:
    """Bigrams and size bounds of each template, and a pattern that any matching unit has to meet."""
    known = {k: template_bigrams(v) for k, v in sorted((templates or TEMPLATES).items())}
    bounds = {k: size_bounds(len(v), threshold) for k, v in known.items()}
    hint = "(?<![a-z0-9])(?:" + "|".join(sorted({p.replace(" ", "[^a-z0-9]+") for v in known.values() for p in telling(v, threshold)})) + ")(?![a-z0-9])"
    return known, bounds, hint


def literal(texts: list[str]) -> Column:
    return F.array(*map(F.lit, texts))


def unit_matches(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each line or whole text that matches: doc_id, unit (line from 1; 0: the whole text), license, dice.

    No shuffle. A unit's number of bigrams is below its number of words; repeated bigrams only lessen it, so the lower
    bound on words holds before they are made and the upper one after.
    """
    known, bounds, hint = template_sets(threshold, templates)
    least = min(low for low, _ in bounds.values())
    body = text_or_empty(text)
    lines = F.split(body, "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(body), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    unit = docs.filter(F.lower(body).rlike(hint)).select(F.col(id_column).alias("doc_id"), F.posexplode(units).alias("unit", "__text"))
    sized = unit.filter(F.lower("__text").rlike(hint)).select("doc_id", "unit", words_of(F.col("__text")).alias("__words"))
    paired = sized.filter(F.size("__words") > least).select("doc_id", "unit", bigrams_of(F.col("__words")).alias("__pairs"))
    n = F.size("__pairs")

    def dice(name: str) -> Column:
        pairs = known[name]
        inside = n.between(*bounds[name])
        return F.when(inside, F.lit(2.0) * F.size(F.array_intersect("__pairs", literal(pairs))) / (n + len(pairs)))

    scored = F.filter(F.array(*[F.struct(dice(k).alias("dice"), F.lit(k).alias("license")) for k in known]), lambda s: s["dice"] >= threshold - 1e-12)
    return paired.select("doc_id", "unit", F.explode_outer(scored).alias("m")).filter("m is not null").select("doc_id", "unit", F.col("m.license").alias("license"), F.col("m.dice").alias("dice"))


def block_matches(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each block of two or more lines, but not all, that matches: doc_id, unit (first line), last_unit, license, dice.

    Blocks that match are shuffled by text and licence, to keep the best of those that overlap; texts aren't shuffled.
    """
    known, bounds, hint = template_sets(threshold, templates)
    most = max(high for _, high in bounds.values()) + 1  # words of a block, so lines too
    body = text_or_empty(text)
    worded = F.filter(F.transform(F.split(body, "\n"), lambda x, i: F.named_struct(F.lit("no"), i + 1, F.lit("w"), words_of(x))), lambda s: F.size(s["w"]) > 0)
    lined = docs.filter(F.lower(body).rlike(hint)).select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), worded.alias("lines")).filter(F.size("lines") > 2)
    all_pairs = bigrams_of(F.flatten(F.transform("lines", lambda s: s["w"])))
    met = lined.withColumn("met", F.array_intersect(all_pairs, literal(sorted({p for v in known.values() for p in v}))))
    enough = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("met", literal(v))) >= bounds[k][0], F.struct(F.lit(k).alias("license"), literal(v).alias("pairs"), F.lit(bounds[k][1] + 1).alias("most"))) for k, v in known.items()]))
    # Chunks of lines with as many more as a block of their last line may reach.
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(CHUNK_LINES))
    chunks = F.transform(starts, lambda i: F.named_struct(F.lit("at"), i, F.lit("lines"), F.slice("lines", i, F.lit(CHUNK_LINES + most))))
    some = met.select("row", "doc_id", F.size("lines").alias("n_lines"), chunks.alias("chunks"), F.explode(enough).alias("t"))
    chunk = some.select("row", "doc_id", "n_lines", "t", F.explode("chunks").alias("c")).select("row", "doc_id", "n_lines", "t", F.col("c.at").alias("at"), F.col("c.lines").alias("lines"))

    def begins(i: Column) -> Column:  # a bigram of the template begins in line i
        here = F.element_at("lines", i)["w"]
        after = F.coalesce(F.slice(F.try_element_at("lines", i + 1)["w"], 1, 1), F.array().cast("array<string>"))
        return F.arrays_overlap(bigrams_of(F.concat(here, after)), F.col("t.pairs"))

    firsts = F.filter(F.sequence(F.lit(1), F.least(F.size("lines"), F.lit(CHUNK_LINES))), begins)
    ahead = F.transform(firsts, lambda i: F.named_struct(F.lit("pos"), F.col("at") + i - 1, F.lit("lines"), F.slice("lines", i, F.col("t.most"))))
    first = chunk.select("row", "doc_id", "n_lines", "t", F.explode(ahead).alias("a")).select("row", "doc_id", "n_lines", "t", F.col("a.pos").alias("pos"), F.col("a.lines").alias("lines"))

    def block(k: Column) -> Column:
        words = F.flatten(F.transform(F.slice("lines", 1, k), lambda s: s["w"]))
        return F.transform(F.array(bigrams_of(words)), lambda p: F.named_struct(F.lit("dice"), F.lit(2.0) * F.size(F.array_intersect(p, F.col("t.pairs"))) / (F.size(p) + F.size("t.pairs")), F.lit("less"), -k))[0]

    ends = F.aggregate(F.transform("lines", lambda s: F.size(s["w"])), F.named_struct(F.lit("words"), F.lit(0), F.lit("n"), F.lit(0)), lambda a, x: F.named_struct(F.lit("words"), a["words"] + x, F.lit("n"), F.when(a["words"] + x <= F.col("t.most"), a["n"] + 1).otherwise(a["n"])))["n"]
    sized = first.withColumn("ends", ends).filter("ends > 0")
    best = sized.withColumn("best", F.array_max(F.transform(F.sequence(F.lit(1), F.col("ends")), block))).filter(F.col("best.dice") >= threshold - 1e-12)
    k = -F.col("best.less")
    flat = best.select("row", "doc_id", "n_lines", F.col("t.license").alias("license"), "pos", (F.col("pos") + k - 1).alias("end"), F.element_at("lines", F.lit(1))["no"].alias("unit"), F.element_at("lines", k)["no"].alias("last_unit"), F.col("best.dice").alias("dice"))
    near = Window.partitionBy("row", "doc_id", "license").orderBy("pos").rangeBetween(-most, most)
    seen = flat.withColumn("near", F.collect_list(F.struct("dice", "pos", "end")).over(near))
    length = F.col("end") - F.col("pos")
    shorter = lambda o: ((o["end"] - o["pos"]) < length) | (((o["end"] - o["pos"]) == length) & (o["pos"] < F.col("pos")))
    beaten = F.exists("near", lambda o: (o["pos"] <= F.col("end")) & (o["end"] >= F.col("pos")) & ((o["dice"] > F.col("dice")) | ((o["dice"] == F.col("dice")) & shorter(o))))
    return seen.filter(~beaten & (length > 0) & (length + 1 < F.col("n_lines"))).select("doc_id", "unit", "last_unit", "license", "dice")


def matches(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each line, whole text or block of lines that matches: doc_id, unit (its first line; 0: the whole text),
    last_unit (its last line), license, dice.

    Texts that meet the pattern are written once, as lines and blocks are looked at apart and the pattern is the dear part."""
    hint = template_sets(threshold, templates)[2]
    few = docs.filter(F.lower(text_or_empty(text)).rlike(hint)).select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    docs, text, id_column = materialise(few, "op9-hinted"), "text", "doc_id"
    units = unit_matches(docs, text, id_column, threshold, templates).select("doc_id", "unit", F.col("unit").alias("last_unit"), "license", "dice")
    return units.unionByName(block_matches(docs, text, id_column, threshold, templates))


def best_license(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row for each id with a match: the best one, and how many units match."""
    found = matches(docs, text, id_column)
    best = F.min(F.struct((-F.col("dice")).alias("d"), F.col("unit").alias("u"), F.col("license").alias("l")))
    return found.groupBy("doc_id").agg(best.alias("b"), F.count_distinct("unit").alias("n_units")).select("doc_id", F.col("b.l").alias("license"), (-F.col("b.d")).alias("dice"), F.col("b.u").alias("unit"), "n_units")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit and block of every document that matches a template; documents without a licence have no row."""
    found = matches(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "unit", "last_unit", "license", F.round("dice", 6).alias("dice"))


def _sql() -> str:
    rows = ", ".join(f"('{k}', [{', '.join(repr(p) for p in template_bigrams(v))}])" for k, v in TEMPLATES.items())
    most = max(size_bounds(len(template_bigrams(v)))[1] for v in TEMPLATES.values()) + 1
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    return rf"""
WITH t(license, pairs) AS (VALUES {rows}),
s AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT rid, doc_id, 0 AS unit, body AS line FROM s WHERE len(lines) > 1
      UNION ALL SELECT rid, doc_id, generate_subscripts(lines, 1) AS unit, unnest(lines) AS line FROM s),
w AS MATERIALIZED (SELECT rid, doc_id, unit, {words.format("line")} AS words FROM u),
p AS MATERIALIZED (SELECT rid, doc_id, unit, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS pairs FROM w WHERE len(words) > 1),
d AS (SELECT p.doc_id, p.unit, t.license, 2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice FROM p, t
      WHERE len(p.pairs) BETWEEN len(t.pairs) * {THRESHOLD} / {2 - THRESHOLD} - 1e-9 AND len(t.pairs) * {2 - THRESHOLD} / {THRESHOLD} + 1e-9),
tp AS (SELECT license, unnest(pairs) AS pair FROM t),
c AS (SELECT rid, license FROM (SELECT rid, unnest(pairs) AS pair FROM p WHERE unit = 0) JOIN tp USING (pair) GROUP BY rid, license),
e AS MATERIALIZED (SELECT c.rid, c.license, t.pairs, floor(len(t.pairs) * {2 - THRESHOLD} / {THRESHOLD} + 1e-9) + 1 AS most
      FROM c JOIN t USING (license) JOIN p ON p.rid = c.rid AND p.unit = 0
      WHERE len(list_intersect(p.pairs, t.pairs)) >= len(t.pairs) * {THRESHOLD} / {2 - THRESHOLD} - 1e-9),
l AS MATERIALIZED (SELECT rid, doc_id, unit, words, row_number() OVER o AS pos, sum(len(words)) OVER o AS upto, lead(words[1]) OVER o AS next_word, count(*) OVER (PARTITION BY rid) AS n_lines
      FROM w WHERE unit > 0 AND len(words) > 0 AND rid IN (SELECT rid FROM e) WINDOW o AS (PARTITION BY rid ORDER BY unit)),
b AS MATERIALIZED (SELECT l.*, e.license, e.pairs AS tpairs, e.most FROM l JOIN e USING (rid)
      WHERE len(list_intersect([(words || [next_word])[i] || ' ' || (words || [next_word])[i + 1] for i in range(1, len(words) + 1)], e.pairs)) > 0),
k AS (SELECT b.rid, b.doc_id, b.license, b.tpairs, b.n_lines, b.pos, l.pos AS fin, b.unit, l.unit AS last_unit, full_words.words[b.upto - len(b.words) + 1 : l.upto] AS words
      FROM b JOIN l ON l.rid = b.rid AND l.pos BETWEEN b.pos AND b.pos + {most} AND l.upto - b.upto + len(b.words) <= b.most
      JOIN w AS full_words ON full_words.rid = b.rid AND full_words.unit = 0),
q AS (SELECT * EXCLUDE (words), list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS pairs FROM k),
g AS (SELECT * EXCLUDE (pairs, tpairs), 2.0::DOUBLE * len(list_intersect(pairs, tpairs)) / (len(pairs) + len(tpairs)) AS dice FROM q),
h AS MATERIALIZED (SELECT * FROM g WHERE dice >= {THRESHOLD} - 1e-12 QUALIFY row_number() OVER (PARTITION BY rid, license, pos ORDER BY dice DESC, fin) = 1),
r AS (SELECT * FROM h WHERE fin > pos AND fin - pos + 1 < n_lines AND NOT EXISTS (SELECT 1 FROM h AS x WHERE x.rid = h.rid AND x.license = h.license AND x.pos <= h.fin AND x.fin >= h.pos
      AND (x.dice > h.dice OR (x.dice = h.dice AND (x.fin - x.pos < h.fin - h.pos OR (x.fin - x.pos = h.fin - h.pos AND x.pos < h.pos))))))
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(unit AS INTEGER) AS last_unit, license, round(dice, 6) AS dice FROM d WHERE dice >= {THRESHOLD} - 1e-12
UNION ALL SELECT doc_id, CAST(unit AS INTEGER), CAST(last_unit AS INTEGER), license, round(dice, 6) FROM r
"""


OP9_SQL = _sql()
