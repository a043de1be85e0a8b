"""Operator 8: approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Gaussian (2-stable) projections to ``PROJECTED`` dimensions keep distances up to a chi-square factor: for two vectors at
distance d the squared projected distance divided by d^2 follows a chi-square law. A kd-tree over the projected vectors,
its splits taken from bounded samples and its boxes from all rows, deals every vector out to a leaf. A larger index has
two levels: each leaf of the first is split by a tree from a sample of its own. A query first looks into its own leaf,
then goes to the leaves in which, by the chi-square test against its k-th distance so far, a nearer vector may still lie
with more than probability ``MISS``. Inside a leaf, a tree of small cells is visited in the order of projected distance
until the same test holds. Eight projected dimensions tell little of a single vector, so each vector of a cell that is
visited is tested by itself, on ``FINE`` projections and with probability ``FINE_MISS``, before it is verified on all
dimensions. Leaves beyond BLOCK_ROWS (from some 10^9 vectors on,
when both levels are full) are cut by hash into blocks that are all visited; many queries of one block go in slices.

Equal vectors are one point of the index with their smallest ids (no result can hold more of them), so a vector that many
rows share costs as much as any other. Defined results: vectors that are null, of another length than most, zero, or with
null or non-finite components take no part, neither as queries nor as candidates; ties go to smaller ids; of the rows of
one id that may take part the one with the smallest vector does (the first component decides, then the next), and the id
asks if any of its rows does; an empty table gives an empty table; only id and vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

PROJECTED, MISS = 8, 0.005
FINE, FINE_MISS = 32, 0.1
#: Rows from which a tree takes its splits, first in hash order; leaves get about 64 of them at least. So a tree has at
#: most 512 leaves, both levels together at most 262,144: their boxes, the most that is broadcast, take 32 MB.
SAMPLE_ROWS, SAMPLE_LEAF = 32_768, 64
#: Aimed-at rows of a leaf, rows of a block of a leaf, and of a cell inside it.
LEAF_ROWS, BLOCK_ROWS, CELL_ROWS = 2048, 4096, 64
#: Queries of a block that are looked up together, and those of a slice, which one task takes.
TOGETHER, SLICE_QUERIES = 512, 65_536


def chi_square_radius(dimensions: int = PROJECTED, miss: float = MISS) -> float:
    """x with P(chi-square > x) = miss, for an even number of dimensions."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > miss else (low, mid)
    return high


def projection(dimension: int, seed: int = 41) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension, PROJECTED))


def fine_projection(dimension: int, seed: int = 43) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension, FINE))


class Tree:
    """Median splits, the widest dimension first: ``split[node]`` (dimension, value) of a complete binary tree."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(1, min(leaves, len(sample) // SAMPLE_LEAF)))))
        self.dims, self.values = np.zeros(1 << self.depth, int), np.full(1 << self.depth, np.inf)
        self._split(1, sample)

    @classmethod
    def of(cls, dims: np.ndarray, values: np.ndarray) -> Tree:
        tree = cls(np.zeros((0, PROJECTED)), 1)
        tree.depth, tree.dims, tree.values = len(dims).bit_length() - 1, dims, values
        return tree

    def _split(self, node: int, rows: np.ndarray) -> None:
        if node < 1 << self.depth and len(rows):
            d = int(np.argmax(rows.max(0) - rows.min(0)))
            self.dims[node], self.values[node] = d, np.median(rows[:, d])
            right = rows[:, d] > self.values[node]
            self._split(2 * node, rows[~right])
            self._split(2 * node + 1, rows[right])

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), int)
        for _ in range(self.depth):
            node = 2 * node + (rows[np.arange(len(rows)), self.dims[node]] > self.values[node])
        return node - (1 << self.depth)


class TwoLevels:
    """A tree of trees: each leaf of ``top`` has one of its own in ``below``; their leaves are numbered through."""

    def __init__(self, top: Tree, below: list[Tree]):
        self.top, self.below = top, below
        self.first = np.cumsum([0, *(1 << t.depth for t in below)])

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        at = self.top.leaf(rows)
        out = self.first[at]
        for t in np.unique(at):
            here = at == t
            out[here] += self.below[t].leaf(rows[here])
        return out

    def within(self, rows: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) whose squared distance is within the row's bound: by the boxes of the first level, then theirs."""
        starts, some = self.first[:-1], np.isfinite(low).all(1)[:, None]
        wide_low = np.minimum.reduceat(np.where(some, low, np.inf), starts)
        wide_high = np.maximum.reduceat(np.where(some, high, -np.inf), starts)
        near, found = box_distance(rows, wide_low, wide_high) <= bounds[:, None], []
        for t in np.flatnonzero(near.any(0)):
            who, a, b = np.flatnonzero(near[:, t]), self.first[t], self.first[t + 1]
            row, leaf = np.nonzero(box_distance(rows[who], low[a:b], high[a:b]) <= bounds[who, None])
            found.append((who[row], a + leaf))
        row, leaf = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        return row, leaf


def cells(rows: np.ndarray) -> list[np.ndarray]:
    """Row numbers of a local kd-tree's cells of at most CELL_ROWS rows."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        at = todo.pop()
        if len(at) <= CELL_ROWS:
            out.append(at)
            continue
        d = int(np.argmax(rows[at].max(0) - rows[at].min(0)))
        order = at[np.argsort(rows[at, d], kind="stable")]
        todo += [order[len(at) // 2 :], order[: len(at) // 2]]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes) of squared distances to boxes."""
    return np.square(np.maximum(0, np.maximum(low[None] - points[:, None], points[:, None] - high[None]))).sum(2)


class Block:
    """Vectors of one block and their local tree; counts the vectors that were verified on all dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray):
        low_dim, self.fine_project = vectors @ project, fine_projection(vectors.shape[1])
        parts, fine = cells(low_dim), vectors @ self.fine_project
        self.low = np.array([low_dim[c].min(0) for c in parts])
        self.high = np.array([low_dim[c].max(0) for c in parts])
        self.ids, self.vectors, self.fine, self.project = [ids[c] for c in parts], [vectors[c] for c in parts], [fine[c] for c in parts], project
        self.verified = 0

    def nearest(self, queries: np.ndarray, bounds: np.ndarray, k: int, radius: float):
        """For each query (ids, distances) of its k nearest here, verified until the tests hold."""
        fine_radius = chi_square_radius(FINE, FINE_MISS)
        reach = box_distance(queries @ self.project, self.low, self.high)
        for q, bound, far, fine in zip(queries, bounds, reach, queries @ self.fine_project, strict=True):
            ids, dist = np.zeros(0, "i8"), np.zeros(0)
            for c in np.argsort(far, kind="stable"):
                limit = min(bound, dist[k - 1] if len(dist) >= k else np.inf) ** 2
                if far[c] > radius * limit:
                    break
                near = np.square(self.fine[c] - fine).sum(1) <= fine_radius * limit
                self.verified += int(near.sum())
                ids = np.concatenate([ids, self.ids[c][near]])
                dist = np.concatenate([dist, np.sqrt(np.square(self.vectors[c][near] - q).sum(1))])
                order = np.lexsort((ids, dist))[:k]
                ids, dist = ids[order], dist[order]
            yield ids, dist


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def search_blocks(points: DataFrame, queries: DataFrame, dimension: int, k: int) -> DataFrame:
    """Points (leaf, part, slice, id, vector) and queries (also bound) to (query, id, dist): k for each visit.

    A task holds one block of points at a time and lets its queries stream past.
    """
    project, radius = projection(dimension), chi_square_radius()
    names = ["leaf", "part", "slice", "kind", "id", "vector", "bound"]
    both = points.withColumns({"kind": F.lit(0), "bound": F.lit(0.0)}).select(names).unionByName(queries.withColumn("kind", F.lit(1)).select(names))

    def run(batches):
        key, ids, vectors, block = None, [], [], None
        for whole in batches:
            head = np.stack([whole.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1).tolist(), len(head)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tuple(head[a, :3]) != key:
                    key, ids, vectors, block = tuple(head[a, :3]), [], [], None
                some = whole.slice(a, b - a)
                if head[a, 3] == 0:
                    ids.append(some.column(4).to_numpy())
                    vectors.append(_matrix(some.column(5), dimension))
                    continue
                if not ids:
                    continue
                block = block or Block(np.concatenate(ids), np.concatenate(vectors), project)
                for at in range(0, b - a, TOGETHER):
                    part = some.slice(at, TOGETHER)
                    found = list(block.nearest(_matrix(part.column(5), dimension), part.column(6).to_numpy(), k, radius))
                    n = [len(i) for i, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(4).to_numpy(), n)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([d for _, d in found]))], names=["query", "id", "dist"])

    dealt = both.repartition("leaf", "part", "slice").sortWithinPartitions("leaf", "part", "slice", "kind")
    return dealt.mapInArrow(run, "query long, id long, dist double")


def _looked_up(blocks: DataFrame, asked: DataFrame, visits: DataFrame, dimension: int, k: int, name: str) -> DataFrame:
    """The k nearest that each of ``visits`` (leaf, part, id, bound) finds; blocks that nobody visits stay out."""
    visits = materialise(visits, f"op8-{name}")
    slices = F.ceil(F.count("*") / SLICE_QUERIES).cast("long").alias("slices")
    slices = materialise(visits.groupBy("leaf", "part").agg(slices), f"op8-{name}-slices")
    points = blocks.join(slices, ["leaf", "part"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    queries = visits.join(slices, ["leaf", "part"]).withColumn("slice", F.pmod(F.xxhash64("id"), "slices"))
    return search_blocks(points, queries.join(asked.select("id", "vector"), "id"), dimension, k)


def _visits(queries: DataFrame, dimension: int, tree: TwoLevels, boxes: tuple, home: bool) -> DataFrame:
    """Rows (leaf, part, id, bound) for the blocks that each query looks into: its own leaf's first block at first,
    afterwards all blocks of every leaf that passes the test."""
    project, radius = projection(dimension), chi_square_radius()
    shared = queries.sparkSession.sparkContext.broadcast((tree, *boxes))

    def run(batches):
        tree, low, high, parts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                low_dim = _matrix(batch.column(1), dimension) @ project
                bound = batch.column(2).to_numpy()
                if home:
                    row, leaf = np.arange(len(low_dim)), tree.leaf(low_dim)
                    part = np.zeros(len(row), int)
                else:
                    row, leaf = tree.within(low_dim, radius * bound**2, low, high)
                    row, leaf = row[parts[leaf] > 0], leaf[parts[leaf] > 0]
                    part = np.concatenate([np.arange(n) for n in parts[leaf]]) if len(leaf) else np.zeros(0, int)
                    row, leaf = np.repeat(row, parts[leaf]), np.repeat(leaf, parts[leaf])
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(part, pa.int64()), pa.array(batch.column(0).to_numpy()[row], pa.int64()), pa.array(bound[row], pa.float64())], names=["leaf", "part", "id", "bound"])

    return queries.select("id", "vector", "bound").mapInArrow(run, "leaf long, part long, id long, bound double")


def _below(points: DataFrame, top: Tree, dimension: int, total: int) -> list[Tree]:
    """A tree for each leaf of ``top``, by a sample of its rows: SAMPLE_ROWS of a leaf in the mean, drawn by hash."""
    leaves, project = 1 << top.depth, projection(dimension)
    trees = [Tree(np.zeros((0, PROJECTED)), 1)] * leaves
    if total <= leaves * LEAF_ROWS:
        return trees
    share = min(1.0, leaves * SAMPLE_ROWS / total)
    drawn = points.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector")
    shared = points.sparkSession.sparkContext.broadcast(top)

    def deal(batches):
        for batch in batches:
            low_dim = _matrix(batch.column(0), dimension) @ project
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.leaf(low_dim), pa.int64()), *[pa.array(low_dim[:, i]) for i in range(PROJECTED)]], names=["leaf", *[f"p{i}" for i in range(PROJECTED)]])

    def split(key, rows):
        tree = Tree(rows.drop(columns="leaf").to_numpy(), math.ceil(len(rows) / share / LEAF_ROWS))
        return pd.DataFrame({"leaf": [key[0]], "dims": [tree.dims], "levels": [tree.values]})

    coordinates = ", ".join(f"p{i} double" for i in range(PROJECTED))
    grown = drawn.mapInArrow(deal, f"leaf long, {coordinates}").groupBy("leaf").applyInPandas(split, "leaf long, dims array<long>, levels array<double>")
    for r in grown.collect():  # a row for each leaf of ``top``, as long as its sample is large
        trees[r["leaf"]] = Tree.of(np.array(r["dims"], int), np.array(r["levels"]))
    return trees


def valid(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has the most common length, finite components and not only zeros."""
    v = F.col(vector)
    lengths = vectors.filter(v.isNotNull() & (F.size(v) > 0)).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = lengths["n"] if lengths else 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(v.isNotNull() & (F.size(v) == n) & finite & F.exists(v, lambda x: x != 0)).withColumn(vector, v.cast("array<double>"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, dist): the k nearest of each row for which ``is_query`` holds, among all others."""
    spark = vectors.sparkSession
    rows = valid(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("id is not null"), "vector")
    # -0.0 and 0.0 are equal components, so they hash alike.
    same = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"), F.bool_or("is_query").alias("is_query"))
    rows = materialise(rows.withColumns({"a": F.xxhash64(same), "b": F.xxhash64(F.lit(7), same)}), "op8-rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, id long, dist double")
    dimension = rows.select(F.size("vector").alias("n")).first()["n"]
    # Of equal vectors k + 1 ids at most can come up: those of each salt first, then of all.
    salted = Window.partitionBy("a", "b", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.select("a", "b", "id").withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).filter(F.col("n") <= k + 1)
    few = materialise(few.select("a", "b", "id", "n"), "op8-ids")
    points = rows.join(few.filter("n = 1").select("id", "a", "b"), ["id", "a", "b"]).select("id", "a", "b", "vector")
    project, n_leaves = projection(dimension), math.ceil(total / LEAF_ROWS)
    sample = points.select("vector", F.xxhash64("id").alias("o")).orderBy("o").limit(SAMPLE_ROWS).toArrow()
    top = Tree(_matrix(sample.column(0).combine_chunks(), dimension) @ project, n_leaves)
    tree = TwoLevels(top, _below(points, top, dimension, total))
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches):
        for batch in batches:
            low_dim = _matrix(batch.column(1), dimension) @ project
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf(low_dim)), *[pa.array(low_dim[:, i]) for i in range(PROJECTED)]], names=["id", "vector", "a", "b", "leaf", *[f"p{i}" for i in range(PROJECTED)]])

    coordinates = ", ".join(f"p{i} double" for i in range(PROJECTED))
    leafed = materialise(points.select("id", "vector", "a", "b").mapInArrow(deal, f"id long, vector array<double>, a long, b long, leaf long, {coordinates}"), "op8-points")
    found = leafed.groupBy("leaf").agg(F.count("*").alias("n"), *[f(f"p{i}").alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(PROJECTED)]).collect()  # bounded by the samples
    leaves = int(tree.first[-1])
    low, high, parts = np.full((leaves, PROJECTED), np.inf), np.full((leaves, PROJECTED), -np.inf), np.zeros(leaves, int)
    for r in found:
        low[r["leaf"]], high[r["leaf"]] = [r[f"min{i}"] for i in range(PROJECTED)], [r[f"max{i}"] for i in range(PROJECTED)]
        parts[r["leaf"]] = -(-r["n"] // BLOCK_ROWS)
    boxes = (low, high, parts)
    part_of = materialise(leafed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("parts")), "op8-parts")
    blocks = leafed.join(part_of, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "vector")
    asked = rows.filter("is_query").select("a", "b").distinct()
    asked = materialise(leafed.join(asked, ["a", "b"]).select("id", "vector", F.lit(float("inf")).alias("bound")), "op8-asked")
    near = _looked_up(blocks, asked, _visits(asked, dimension, tree, boxes, home=True), dimension, k + 1, "home")
    bound = near.groupBy("query").agg(F.when(F.count("*") >= k + 1, F.max("dist")).otherwise(F.lit(float("inf"))).alias("found"))
    bounded = asked.join(materialise(bound, "op8-bounds"), F.col("id") == F.col("query"), "left").select("id", "vector", F.coalesce("found", F.lit(float("inf"))).alias("bound"))
    all_near = _looked_up(blocks, asked, _visits(materialise(bounded, "op8-bounded"), dimension, tree, boxes, home=False), dimension, k + 1, "visits")
    best = all_near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))).filter(F.col("n") <= k + 1)
    best = materialise(best.select("query", F.col("id").alias("point"), "dist"), "op8-best")
    # Points stand for their ids again, and query points for the rows that asked.
    keys = leafed.select(F.col("id").alias("point"), "a", "b")
    ids = keys.join(few, ["a", "b"]).select("point", F.col("id").alias("candidate"))
    listed = best.join(ids, "point").withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("dist", "candidate"))).filter(F.col("n") <= k + 1)
    listed = materialise(listed.select(F.col("query").alias("point"), "candidate", "dist"), "op8-listed")
    asking = rows.filter("is_query").select(F.col("id").alias("query_id"), "a", "b").join(materialise(keys, "op8-keys"), ["a", "b"]).select("query_id", "point")
    pairs = asking.join(listed, "point").filter("candidate <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "candidate")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("candidate").alias("id"), "dist")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    found = nearest(rows, F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("dist").alias("score"))
