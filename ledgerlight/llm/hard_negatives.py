"""Operator 12: hard negatives by dual-tree search over integer inner products.

A tree over the candidates deals them out to leaves: its splits come from a bounded sample, and each leaf has a ball around
its sample's mean that holds all of its rows. Anchors are dealt out by the same tree, into groups of at most
``GROUP_ANCHORS``. What an anchor wants are the k best candidates with scores in an interval: its positives are the best
ones of its own label, and each positive's negatives those of other labels in the band under the positive's score.

For two balls all inner products lie within ra * |cc| + rc * |ca| + ra * rc of the product of the centres. So

1. a whole group of anchors skips a leaf whose interval lies outside all that the group still wants;
2. where a group meets a leaf, trees over both are descended together, and pairs of nodes are dropped in the same way;
3. pairs of end nodes that are left are scored exactly, the most promising first, while what an anchor has found raises what
   it wants.

Each search looks into the anchors' own leaves first, so that the visits to all others start from a bound. Leaves beyond
``BLOCK_ROWS`` are cut by hash into blocks of which a task holds one; many groups of one block go in slices. On vectors
without any structure balls overlap and little is dropped; the results are exact all the same.

Defined results: rows without id or label, and vectors that are null, of another length than most, or with null or
non-finite components take no part, nor do those with a component of 2^24 or more in units of 1 / ``SCALE``, whose products
might not fit 64 bits; zero vectors take part; of the rows of one id the one with the smallest label and vector takes part,
so repeated rows count once; ties go to smaller ids; an anchor without positives, and a positive without negatives, have no
rows; an empty table gives an empty table; only id, label and vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table
from .neighbours import Tree

#: Components are floor(SCALE * x).
SCALE, LARGEST = 256, 1 << 24
#: Rows (and bytes) from which the tree takes its splits, in the mean; leaves get 64 of them at least.
SAMPLE_ROWS, SAMPLE_BYTES = 32_768, 64 << 20
#: Aimed-at rows of a leaf, rows of a block of a leaf, and of an end node inside it.
LEAF_ROWS, BLOCK_ROWS, CELL_ROWS = 4096, 8192, 64
#: Anchors of a group and of an end node, groups of a slice of a block, and end nodes of candidates scored at once.
GROUP_ANCHORS, CELL_ANCHORS, SLICE_GROUPS, TOGETHER = 512, 16, 1024, 16
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Balls:
    """A balanced tree of balls over the rows of a matrix: ``order`` sorts them by end nodes; for each level the nodes' bounds
    in that order, centres, radii and the centres' norms."""

    def __init__(self, rows: np.ndarray, end_rows: int):
        n = len(rows)
        self.order, self.depth = np.arange(n), max(0, math.ceil(math.log2(max(1, n / end_rows))))
        self.levels, cuts = [], np.array([0, n])
        for level in range(self.depth + 1):
            own = rows[self.order]
            sizes = np.diff(cuts)
            centres = np.add.reduceat(own, cuts[:-1]) / sizes[:, None]
            apart = np.sqrt(np.square(own - np.repeat(centres, sizes, axis=0)).sum(1))
            self.levels.append((cuts, centres, np.maximum.reduceat(apart, cuts[:-1]), np.sqrt(np.square(centres).sum(1))))
            if level < self.depth:
                middles = (cuts[:-1] + cuts[1:]) // 2
                for a, mid, b in zip(cuts, middles, cuts[1:]):
                    at = self.order[a:b]
                    d = int(np.argmax(rows[at].max(0) - rows[at].min(0)))
                    self.order[a:b] = at[np.argpartition(rows[at, d], mid - a)]
                cuts = np.sort(np.concatenate([cuts, middles]))


def interval(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) inner product for each pair of balls (centres, radii, norms), a little wider against rounding."""
    (ca, ra, na), (cb, rb, nb) = a, b
    middle = ca @ cb.T
    spread = ra[:, None] * nb + na[:, None] * rb + ra[:, None] * rb
    spread = spread + 1 + 1e-9 * (np.abs(middle) + spread)
    return middle - spread, middle + spread


def met_ends(a: Balls, b: Balls, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of end nodes (of a, of b, highest product) where a row of ``a`` may have a product within its [low, high]."""
    i = j = np.zeros(1, int)
    for level in range(max(a.depth, b.depth) + 1):
        cuts, *own = a.levels[min(level, a.depth)]
        _, *other = b.levels[min(level, b.depth)]
        least, most = interval(own, other)
        keep = (most[i, j] >= np.minimum.reduceat(low[a.order], cuts[:-1])[i]) & (least[i, j] <= np.maximum.reduceat(high[a.order], cuts[:-1])[i])
        i, j = i[keep], j[keep]
        if level < a.depth:
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
        if level < b.depth:
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
    return i, j, most[i, j]


class Block:
    """Candidates of one block and their tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.tree = Balls(rows, CELL_ROWS)
        self.ids, self.labels, self.rows = ids[self.tree.order], labels[self.tree.order], rows[self.tree.order]
        self.largest = np.abs(rows).max()

    def products(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact integer products: by doubles where they hold every sum."""
        if np.abs(rows).max() * self.largest * rows.shape[1] < 1 << 53:
            return (rows @ self.rows[at].T).astype(np.int64)
        return rows.astype(np.int64) @ self.rows[at].astype(np.int64).T

    def best(self, group: dict, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(want, id, score) of the k best of each want of a group that are in this block, and how many products it took."""
        wants = {c: group[c] for c in ("at", "anchor", "label", "low", "high")}
        tree = Balls(group["rows"], CELL_ANCHORS)
        low, high = np.full(len(group["rows"]), HIGHEST), np.full(len(group["rows"]), LOWEST)
        np.minimum.at(low, wants["at"], wants["low"])
        np.maximum.at(high, wants["at"], wants["high"])
        i, j, most = met_ends(tree, self.tree, low, high)
        place = np.empty(len(tree.order), int)
        place[tree.order] = np.arange(len(tree.order))
        cell = np.searchsorted(tree.levels[-1][0], place[wants["at"]], side="right") - 1
        cuts, found, scored = self.tree.levels[-1][0], [], 0
        for node in np.unique(i):
            own = np.flatnonzero(cell == node)
            anchors, row = np.unique(wants["at"][own], return_inverse=True)
            floor, pool = wants["low"][own].copy(), np.zeros((0, 3), np.int64)
            order = np.flatnonzero(i == node)
            order = order[np.argsort(-most[order], kind="stable")]
            for at in range(0, len(order), TOGETHER):
                some = order[at : at + TOGETHER]
                some = j[some[most[some] >= floor.min()]]
                if not len(some):
                    break
                some = np.concatenate([np.arange(cuts[c], cuts[c + 1]) for c in some])
                scores = self.products(group["rows"][anchors], some)[row]
                scored += len(anchors) * len(some)
                fits = (scores >= floor[:, None]) & (scores <= wants["high"][own, None]) & (self.ids[some] != wants["anchor"][own, None])
                fits &= (self.labels[some] == wants["label"][own, None]) == same
                if len(some) > k:  # the k best and what ties with them
                    held = np.where(fits, scores, LOWEST)
                    fits &= scores >= np.partition(held, -k, axis=1)[:, -k][:, None]
                w, c = np.nonzero(fits)
                pool = np.concatenate([pool, np.stack([w, self.ids[some[c]], scores[w, c]], 1)])
                pool = pool[np.lexsort((pool[:, 1], -pool[:, 2], pool[:, 0]))]
                nth = np.arange(len(pool)) - np.searchsorted(pool[:, 0], pool[:, 0])
                pool = pool[nth < k]
                full = pool[nth[nth < k] == k - 1]
                floor[full[:, 0]] = np.maximum(floor[full[:, 0]], full[:, 2])
            found.append(np.stack([own[pool[:, 0]], pool[:, 1], pool[:, 2]], 1))
        return *np.concatenate([np.zeros((0, 3), np.int64), *found]).T, scored


def _matrix(values: pa.Array, dimension: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


class Index:
    """Candidates dealt out by a tree: ``points`` (leaf, part, id, label, vector) in a written table, and the leaves' balls."""

    def __init__(self, rows: DataFrame, dimension: int, total: int):
        self.dimension, self.tree = dimension, None
        sample_rows = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dimension)))
        share = F.lit(math.ceil(min(1.0, sample_rows / total) * (1 << 30)))
        sample = rows.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < share).select("vector").toArrow()
        drawn = _matrix(sample.column(0).combine_chunks().flatten(), dimension)
        self.tree = Tree(drawn, math.ceil(total / LEAF_ROWS))
        leaves, at = 1 << self.tree.depth, self.tree.leaf(drawn)
        self.centres = np.zeros((leaves, dimension))
        np.add.at(self.centres, at, drawn)
        self.centres /= np.maximum(1, np.bincount(at, minlength=leaves))[:, None]
        shared, centres = rows.sparkSession.sparkContext.broadcast(self.tree), self.centres

        def deal(batches):
            for batch in batches:
                own = _matrix(batch.column(2).flatten(), dimension)
                leaf = shared.value.leaf(own)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64()), pa.array(np.sqrt(np.square(own - centres[leaf]).sum(1)))], names=["id", "label", "vector", "leaf", "apart"])

        self.points = materialise(rows.select("id", "label", "vector").mapInArrow(deal, "id long, label long, vector array<int>, leaf long, apart double"), "op12-points")
        found = self.points.groupBy("leaf").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()  # a row for each leaf
        self.radii, self.parts = np.zeros(leaves), np.zeros(leaves, np.int64)
        for r in found:
            self.radii[r["leaf"]], self.parts[r["leaf"]] = r["radius"], -(-r["n"] // BLOCK_ROWS)
        parts = F.element_at(F.array(*[F.lit(int(max(1, p))) for p in self.parts]), (F.col("leaf") + 1).cast("int"))
        self.blocks = self.points.select("leaf", F.pmod(F.xxhash64("id"), parts).alias("part"), "id", "label", "vector")

    def groups(self, wants: DataFrame, home: bool) -> DataFrame:
        """Wants (leaf, anchor, no, label, low, high, vector) to rows (leaf, part, group...) for each block that a group meets:
        the first of its own leaf at home, else all blocks of each leaf that its ball doesn't rule out."""
        dimension = self.dimension
        shared = wants.sparkSession.sparkContext.broadcast((self.centres, self.radii, self.parts))
        sizes = wants.groupBy("leaf").agg(F.ceil(F.count_distinct("anchor") / GROUP_ANCHORS).cast("long").alias("slices"))
        sliced = wants.join(materialise(sizes, "op12-slices"), "leaf").withColumn("nth", F.pmod(F.xxhash64("anchor"), "slices"))
        columns = ["leaf", "nth", "anchor", "no", "label", "low", "high"]

        def run(batches):
            centres, radii, parts = shared.value
            balls = (centres, radii, np.sqrt(np.square(centres).sum(1)))
            key, held = None, []

            def done():
                numbers, rows = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                anchors, first, at = np.unique(numbers[:, 2], return_index=True, return_inverse=True)
                rows = rows[first]
                if home:
                    visits = [(int(numbers[0, 0]), 0)]
                else:
                    centre = rows.mean(0, keepdims=True)
                    ball = (centre, np.sqrt(np.square(rows - centre).sum(1).max(keepdims=True)), np.sqrt(np.square(centre).sum(1)))
                    least, most = interval(ball, balls)
                    near = (most[0] >= numbers[:, 5].min()) & (least[0] <= numbers[:, 6].max()) & (parts > 0)
                    visits = [(int(leaf), p) for leaf in np.flatnonzero(near) for p in range(int(parts[leaf]))]
                number = int(numbers[0, 0]) << 32 | int(numbers[0, 1])
                lists = [numbers[:, c].tolist() for c in (2, 3, 4, 5, 6)] + [at.tolist()]
                return pa.RecordBatch.from_arrays(
                    [pa.array([[{"leaf": a, "part": b} for a, b in visits]], pa.list_(pa.struct([("leaf", pa.int64()), ("part", pa.int64())]))), pa.array([number])]
                    + [pa.array([c], pa.list_(pa.int64())) for c in lists] + [pa.array([rows.ravel().astype(np.int32)], pa.list_(pa.int32()))],
                    names=["visits", "group", "anchors", "nos", "labels", "lows", "highs", "ats", "vector"],
                )

            for batch in batches:
                if not batch.num_rows:
                    continue
                numbers = np.stack([batch.column(c).to_numpy() for c in range(7)], 1)
                rows = _matrix(batch.column(7).flatten(), dimension)
                cuts = [0, *(np.flatnonzero((numbers[1:, :2] != numbers[:-1, :2]).any(1)) + 1).tolist(), len(numbers)]
                for a, b in zip(cuts, cuts[1:]):
                    if tuple(numbers[a, :2]) != key and held:
                        yield done()
                    key = tuple(numbers[a, :2])
                    held.append((numbers[a:b], rows[a:b]))
            if held:
                yield done()

        kinds = "visits array<struct<leaf:long,part:long>>, group long, anchors array<long>, nos array<long>, labels array<long>, lows array<long>, highs array<long>, ats array<long>, vector array<int>"
        made = sliced.select(*columns, "vector").repartition("leaf", "nth").sortWithinPartitions("leaf", "nth").mapInArrow(run, kinds)
        return materialise(made, "op12-groups")

    def visit(self, wants: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        """(anchor, no, id, score): for each want and block at most k candidates."""
        dimension, groups = self.dimension, self.groups(wants, home)
        visits = materialise(groups.select("group", F.explode("visits").alias("v")).select("v.*", "group"), "op12-visits")
        slices = materialise(visits.groupBy("leaf", "part").agg(F.ceil(F.count("*") / SLICE_GROUPS).cast("long").alias("slices")), "op12-block-slices")
        points = self.blocks.join(slices, ["leaf", "part"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        asked = visits.join(slices, ["leaf", "part"]).withColumn("slice", F.pmod(F.xxhash64("group"), "slices")).join(groups.drop("visits"), "group")
        lists = ["anchors", "nos", "labels", "lows", "highs", "ats"]
        none = [F.lit(None).cast("array<long>").alias(c) for c in lists]
        names = ["leaf", "part", "slice", "kind", "id", "label", "vector", *lists]
        points = points.select("leaf", "part", "slice", F.lit(0).alias("kind"), "id", "label", "vector", *none)
        asked = asked.select("leaf", "part", "slice", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), "vector", *lists)

        def run(batches):
            key, held, block = None, [], None
            for whole in batches:
                if not whole.num_rows:
                    continue
                head = np.stack([whole.column(c).to_numpy() for c in range(4)], 1)
                cuts = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1).tolist(), len(head)]
                for a, b in zip(cuts, cuts[1:]):
                    if tuple(head[a, :3]) != key:
                        key, held, block = tuple(head[a, :3]), [], None
                    some = whole.slice(a, b - a)
                    if head[a, 3] == 0:
                        held.append((some.column(4).to_numpy(), some.column(5).to_numpy(), _matrix(some.column(6).flatten(), dimension)))
                        continue
                    if not held:
                        continue
                    block = block or Block(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    for n in range(b - a):
                        anchor, no, label, low, high, at = (some.column(c)[n].values.to_numpy(zero_copy_only=False) for c in range(7, 13))
                        group = {"anchor": anchor, "label": label, "low": low, "high": high, "at": at, "rows": _matrix(some.column(6)[n].values, dimension)}
                        want, ids, scores, _ = block.best(group, k, same)
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[want]), pa.array(no[want]), pa.array(ids), pa.array(scores)], names=["anchor", "no", "id", "score"])

        keys = ["leaf", "part", "slice"]
        dealt = points.unionByName(asked).select(names).repartition(*keys).sortWithinPartitions(*keys, "kind")
        return dealt.mapInArrow(run, "anchor long, no long, id long, score long")

    def best(self, wants: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, no, rank, id, score): the k best candidates of each want (leaf, anchor, no, label, low, high, vector)."""

        def first(found: DataFrame) -> DataFrame:
            order = Window.partitionBy("anchor", "no").orderBy(F.desc("score"), "id")
            return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        known = first(self.visit(wants, k, same, home=True)).filter(F.col("rank") == k).select("anchor", "no", F.col("score").alias("known"))
        raised = wants.join(materialise(known, "op12-known"), ["anchor", "no"], "left").withColumn("low", F.greatest("low", F.coalesce("known", F.lit(LOWEST)))).drop("known")
        return first(self.visit(materialise(raised, "op12-raised"), k, same, home=False)).select("anchor", "no", "rank", "id", "score")


def quantised(vectors: DataFrame, id_column: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector of integers): one row for each id that takes part."""
    v = F.col("v")
    some = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE))
    some = some.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(fits)
    rows = some.select("id", "label", F.transform(v, lambda x: F.floor(x * SCALE).cast("int")).alias("vector"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return materialise(one.select("id", "r.label", "r.vector"), "op12-rows")


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int, n_negatives: int, band: tuple[int, int], id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` reads the column ``id``. Negatives score between ``band`` percents of their positive's score.
    """
    rows = quantised(vectors, id_column, label, vector)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.filter(F.size("vector") == sizes["n"])
    index = Index(rows, sizes["n"], sizes["count"])
    anchors = materialise(index.points.filter(is_anchor).select("leaf", F.col("id").alias("anchor"), "label", "vector"), "op12-anchors")
    wanted = anchors.withColumns({"no": F.lit(0).cast("long"), "low": F.lit(LOWEST), "high": F.lit(HIGHEST)})
    positives = materialise(index.best(wanted, n_positives, same=True), "op12-positives")
    score = F.col("score")
    down = lambda by: F.expr(f"(score * {by} - pmod(score * {by}, 100L)) div 100")
    banded = positives.select("anchor", F.col("rank").cast("long").alias("no"), (-down(-band[0])).alias("low"), down(band[1]).alias("high"))
    wanted = materialise(banded.filter("low <= high").join(anchors, "anchor"), "op12-wanted")
    negatives = index.best(wanted, n_negatives, same=False)
    of = positives.select("anchor", F.col("rank").cast("long").alias("no"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    return negatives.join(of, ["anchor", "no"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("id") % 100 == 0, 5, 10, (30, 90))


OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT id, label, unnest(c) AS x, generate_subscripts(c, 1) AS d FROM v),
s AS (SELECT a.id AS anchor, b.id AS id, any_value(a.label) = any_value(b.label) AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.d = b.d AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY ALL),
p AS (SELECT anchor, id AS positive, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
