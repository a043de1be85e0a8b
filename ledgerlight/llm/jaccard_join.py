"""Operator 10: n-gram Jaccard join with Bayesian candidate pruning.

1. One pass over the texts gives each its set of five-word shingles as a digest and a MinHash signature. Texts with one
   and the same shingle set form a node; only one representative of it goes on, so copies cost nothing.
2. Representatives that share a band of their signatures are candidates of each other. The members of a bucket meet in
   blocks, by their signatures alone. Signatures are compared some hashes at a time; a pair is dropped as soon as the
   posterior probability of a similarity at or above the threshold falls below the tolerance. A block returns a forest
   over the pairs that are left; pairs that it joins already aren't compared, so near copies cost one look along them.
   Buckets of the same members are looked at once, and members travel with one byte of each hash: hashes that agree still
   do, so no pair is dropped that whole hashes would leave.
3. Connected components over these forests are coarse groups: no pair that passed lies across two of them, and texts that
   share a band but are unlike don't chain. Only members of a group fetch their texts. They meet in blocks, pairs are
   pruned in the same way, and the exact Jaccard similarity of the shingle sets decides on the rest. A block returns,
   for each member, its number of links, and a forest that joins linked members; pairs aren't emitted.
4. Connected components over these forests are the result's classes.

A text's shingles: words are maximal runs of letters, digits and underscores of the lower-case text; a text of one to
four words is one shingle. Defined results: null texts and texts without words have no shingles and match nothing, each
is its own class; repeated rows count as copies; an id with several texts takes part with each of them; null ids are rows
like others, but never a class's or set's smallest id unless it has no other; an empty table gives an empty table; only id and text are read.

What may be missed: a pair just at similarity 0.8 shares none of the 24 bands of 4 hashes with a chance of 3e-6, and less
above; pruning errs with at most the tolerance for each comparison.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoGenerations, frugal, materialise, read_table, slices, text_or_empty
from .exact_dedup import filter_of, maybe_in

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Hashes compared before pairs are judged again, and the posterior probability under which a pair is dropped.
STEP, TOLERANCE = 16, 1e-9
#: Members of a block; a group of m members meets in pairs of ceil(m / BLOCK) blocks.
BLOCK = 1024
_WORDS = re.compile(r"\w+").findall
_r = np.random.default_rng(20240229)
_MULTIPLY = _r.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _r.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = _r.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
#: Most shingles whose hashes are held at once.
CHUNK = 1 << 15


class Shingler:
    """Shingle sets of texts as sorted arrays of 64-bit hashes, by cached hashes of words."""

    def __init__(self):
        self.words = TwoGenerations(lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little"))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            words = _WORDS(t.lower())
            h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
            k = min(SHINGLE_WORDS, len(h))
            if not k:
                out.append(h)
                continue
            s = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                s = (s ^ (h[i : len(h) - k + 1 + i] * _MIX[i])) * _MULTIPLY[0]
                s ^= s >> np.uint64(29)
            out.append(np.unique(s))
        self.words.turn()
        return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) of unsigned 32-bit minima; sets must not be empty."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= CHUNK):
            n += len(sets[j])
            j += 1
        all_in = np.concatenate(sets[i:j])
        at = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        for k in range(HASHES):
            v = ((all_in * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[i:j, k] = np.minimum.reduceat(v, at)
        i = j
    return out


def _beta_tail(agree: int, of: int, threshold: float) -> float:
    """P(similarity >= threshold | ``agree`` of ``of`` hashes agree), uniform prior: a binomial sum for the Beta tail."""
    n, a = of + 1, agree + 1
    return sum(math.comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(a))


def least_agreement(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of hashes compared the least number that must agree."""
    return {n: next((a for a in range(n + 1) if _beta_tail(a, n, threshold) >= tolerance), n + 1) for n in range(STEP, HASHES + 1, STEP)}


#: What tells rows apart: the id and 128 bits of the text.
ROW = ["doc_id", "text_a", "text_b"]


def row_key(text: str = "text", id_column: str = "doc_id") -> list[Column]:
    body = text_or_empty(text)
    return [F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_a"), F.xxhash64(F.lit(1), body).alias("text_b")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_a"] == b["text_a"]) & (a["text_b"] == b["text_b"])


def maybe_among(rows: DataFrame) -> Column:
    """Whether a row's key (ROW) may be one of those of ``rows``, by a Bloom filter of bounded size: false spares its text the
    shuffle of a join, true decides nothing."""
    words, bits = filter_of(rows.select(F.xxhash64(*ROW).alias("digest")))
    return maybe_in(words, rows.sparkSession, F.xxhash64(*ROW), bits)


def first_row() -> Column:
    """Of rows the key of the one with the smallest id, null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *ROW))


def signed(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text_a, text_b, set_digest, n_shingles, signature) for each row; digest and signature are null without shingles."""

    def run(batches):
        shingler = Shingler()
        for whole in batches:
            for batch in slices(whole, 3):
                sets = shingler.sets(batch.column(3).to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                digests, sig = [None] * len(sets), [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full]) if full else [], strict=True):
                    digests[i], sig[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), row.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], names=[*ROW, "set_digest", "n_shingles", "signature"])

    return docs.select(*row_key(text, id_column), text_or_empty(text).alias("text")).mapInArrow(frugal(run), "doc_id long, text_a long, text_b long, set_digest binary, n_shingles long, signature binary")


def banded(representatives: DataFrame) -> DataFrame:
    """(band, doc_id): BANDS hashes for each signature."""

    def run(batches):
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(salt, sig.shape[:2]).copy()
            for r in range(ROWS):
                h = (h ^ sig[:, :, r]) * _MIX[r]
                h ^= h >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["band", "doc_id"])

    return representatives.select("doc_id", "signature").mapInArrow(frugal(run), "band long, doc_id long")


def sketched(representatives: DataFrame) -> DataFrame:
    """(doc_id, signature): the lowest byte of each hash, a quarter of the signature's bytes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, HASHES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in low], pa.binary())], names=["doc_id", "signature"])

    return representatives.select("doc_id", "signature").mapInArrow(frugal(run), "doc_id long, signature binary")


def distinct_buckets(bands: DataFrame) -> DataFrame:
    """(band, m) of buckets of m > 1 members, one of those that hold the same: near copies share most of their bands."""
    who = [F.bit_xor(F.xxhash64("doc_id")).alias("who_a"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("who_b")]
    buckets = bands.groupBy("band").agg(F.count("*").alias("m"), *who).filter("m > 1")
    return buckets.groupBy("m", "who_a", "who_b").agg(F.min("band").alias("band")).select("band", "m")


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node of each connected component of edges (a, b); nodes without edges aren't listed.

    Large and small stars in turn: each round hangs a node's neighbours on its smallest one, until nothing moves. Every
    round is written to the shared folder; a hot node's neighbours are aggregated or joined, never gathered.
    """
    links = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), f"{name}-large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = materialise(small.filter("a <> b").distinct(), f"{name}-links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return materialise(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), f"{name}-components")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _likely(i: int, j: np.ndarray, sig: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Those of ``j`` whose pair with ``i`` stays above the tolerance at every step."""
    agree = np.zeros(len(j), np.int64)
    for k in range(0, HASHES, STEP):
        if not len(j):
            break
        agree += (sig[j, k : k + STEP] == sig[i, k : k + STEP]).sum(1)
        alive = agree >= least[k + STEP]
        j, agree = j[alive], agree[alive]
    return j


def _likely_forest(sides: np.ndarray, sig: np.ndarray, least: dict[int, int]) -> list[tuple[int, int]]:
    """A forest over the likely pairs inside one block (side 0), or between two (sides 1 and 2)."""
    n, tree, out = len(sides), np.arange(len(sides)), []
    across, other = bool(sides.any()), np.flatnonzero(sides == 2)
    for i in np.flatnonzero(sides == 1).tolist() if across else range(n - 1):
        j = other if across else np.arange(i + 1, n)
        j = _likely(i, j[tree[j] != tree[i]], sig, least)
        if len(j):
            joined, first = np.unique(tree[j], return_index=True)
            out.extend((i, int(x)) for x in j[first])
            tree[np.isin(tree, joined)] = tree[i]
    return out


def _compare(ids: np.ndarray, sides: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], least: dict[int, int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each member, forest): pairs inside one block (side 0), or between two (sides 1 and 2)."""
    n = len(ids)
    links, forest, kept = np.zeros(n, np.int64), _Forest(n), []
    sizes = np.array([len(s) for s in sets])
    across, other = bool(sides.any()), np.flatnonzero(sides == 2)
    index = {}
    for i in np.flatnonzero(sides == 1).tolist() if across else range(n - 1):
        j = other if across else np.arange(i + 1, n)
        j = j[np.minimum(sizes[i], sizes[j]) >= THRESHOLD * np.maximum(sizes[i], sizes[j]) - 1e-9]
        j = _likely(i, j, sig, least)
        if not len(j):
            continue
        if not index:
            values, place = np.unique(np.concatenate(sets), return_inverse=True)
            index.update(ends=np.cumsum(sizes), place=place, mark=np.zeros(len(values), bool))
            index["starts"] = index["ends"] - sizes
        mark, place = index["mark"], index["place"]
        own = place[index["starts"][i] : index["ends"][i]]
        mark[own] = True
        if len(j) > n // 8:  # many: one look over all members' shingles
            seen = np.concatenate([[0], np.cumsum(mark[place])])
            common = seen[index["ends"][j]] - seen[index["starts"][j]]
        else:
            common = np.array([np.count_nonzero(mark[place[index["starts"][x] : index["ends"][x]]]) for x in j])
        mark[own] = False
        linked = j[common >= THRESHOLD * (sizes[i] + sizes[j] - common) - 1e-9]
        links[i] += len(linked)
        links[linked] += 1
        kept.extend((i, int(x)) for x in linked if forest.join(i, int(x)))
    return links, kept


def in_blocks(members: DataFrame) -> DataFrame:
    """Members (doc_id, m, ...) of groups of m, in a row for each pair (lo, hi) of their group's blocks that they meet in.

    A block meets itself and every other block of its group once. ``side`` is 0 inside a block, 1 in the lower and 2 in
    the higher of two.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumns({"__own": F.pmod(F.xxhash64("doc_id"), blocks).cast("int"), "__all": F.sequence(F.lit(0), blocks - 1)})
    paired = dealt.withColumn("__other", F.explode("__all"))
    lo, hi = F.least("__own", "__other"), F.greatest("__own", "__other")
    side = F.when(lo == hi, 0).when(F.col("__own") == lo, 1).otherwise(2)
    return paired.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long"), "side": side.cast("long")}).drop("__own", "__all", "__other", "m")


def likely_links(shared: DataFrame) -> DataFrame:
    """Rows (band, doc_id, m, signature) of buckets of m members, by their sketches, to (a, b): forests over the pairs that pruning leaves.

    Tasks get their blocks sorted and hold the signatures of one block at a time: two times BLOCK members at most.
    """
    least = least_agreement()

    def run(batches):
        key, kept = None, []

        def done():
            ids, sides, sig = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, int),) * 3
            kept.clear()
            return [(int(ids[i]), int(ids[j])) for i, j in _likely_forest(sides, sig, least)]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            ids, sides = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, HASHES)
            cuts, found = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1).tolist(), len(head)], []
            for a, b in zip(cuts, cuts[1:]):
                if tuple(head[a]) != key:
                    found += done()
                    key = tuple(head[a])
                kept.append((ids[a:b], sides[a:b], sig[a:b]))
            yield rows(found)
        yield rows(done())

    dealt = in_blocks(shared).select("band", "lo", "hi", "doc_id", "side", "signature")
    return dealt.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(frugal(run), "a long, b long")


def coarse_groups(representatives: DataFrame) -> DataFrame:
    """(node, component) of representatives (doc_id, signature) that have a likely partner."""
    bands = materialise(banded(representatives), "op10-bands")
    buckets = materialise(distinct_buckets(bands), "op10-buckets")
    shared = bands.join(buckets, "band").join(sketched(representatives), "doc_id")
    return components(materialise(likely_links(shared), "op10-likely"), "op10-coarse")


def meet(members: DataFrame) -> DataFrame:
    """Rows (block, side, doc_id, signature, text) to (doc_id, links, other): counts, and forest edges where ``other`` isn't null.

    Tasks get their blocks sorted and hold one block at a time: two times BLOCK members at most.
    """
    least = least_agreement()

    def run(batches):
        shingler, held, block = Shingler(), [], None

        def done():
            ids = np.array([r[0] for r in held])
            sides = np.array([r[1] for r in held])
            sig = np.frombuffer(b"".join(r[2] for r in held), np.uint32).reshape(len(held), HASHES)
            links, forest = _compare(ids, sides, sig, [r[3] for r in held], least)
            rows = [(int(d), int(n), None) for d, n in zip(ids, links, strict=True) if n] + [(int(ids[i]), 0, int(ids[j])) for i, j in forest]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["doc_id", "links", "other"])

        for whole in batches:
            for batch in slices(whole, 4):
                blocks, sides, ids, signs, texts = (c.to_pylist() for c in batch.columns)
                for at, *member in zip(blocks, ids, sides, signs, shingler.sets(texts), strict=True):
                    if at != block:
                        if held:
                            yield done()
                        block = at
                    held.append(tuple(member))
        if held:
            yield done()

    dealt = members.select("block", "side", "doc_id", "signature", "text").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(frugal(run), "doc_id long, links long, other long")


def near_rows(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Columns ROW, class_node (a number of the row's class; null without shingles) and those of ``near_classes`` for each row."""
    signs = materialise(signed(docs, text, id_column), "op10-signed")
    whole = signs.filter("set_digest is not null")
    sets = whole.groupBy("set_digest").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("n_copies"), first_row().alias("first"), F.min("signature").alias("signature"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "op10-sets")  # written, so numbers stay
    member = materialise(whole.select(*ROW, "set_digest").join(sets.select("set_digest", "node", "set_id", "n_copies"), "set_digest").drop("set_digest"), "op10-members")
    reps = sets.select(F.col("node").alias("doc_id"), "signature")
    coarse = coarse_groups(reps)
    counts = materialise(coarse.groupBy("component").agg(F.count("*").alias("m")), "op10-counts")
    with_sign = materialise(coarse.join(counts, "component").join(sets.select("node", "signature", "first.*"), "node"), "op10-grouped")
    texts = docs.select(*row_key(text, id_column), text_or_empty(text).alias("text")).filter(maybe_among(with_sign))
    firsts = texts.join(with_sign, same_row(texts, with_sign)).select("node", "component", "m", "signature", "text")
    firsts = materialise(firsts.dropDuplicates(["node"]).withColumnRenamed("node", "doc_id"), "op10-candidates")
    paired = in_blocks(firsts).withColumn("block", F.concat_ws("/", "component", "lo", "hi"))
    met = materialise(meet(paired), "op10-met")
    linked = met.filter("other is null").groupBy(F.col("doc_id").alias("node")).agg(F.sum("links").alias("n_links"))
    groups = components(met.filter("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b")), "op10-classes")
    by_node = materialise(groups.join(linked, "node").join(sets.select("node", "set_id"), "node"), "op10-by-node")
    least = materialise(by_node.groupBy("component").agg(F.min("set_id").alias("class_id")), "op10-least")
    by_node = materialise(by_node.join(least, "component").select("node", "component", "class_id", "n_links"), "op10-by-set")
    found = member.join(by_node, "node", "left").select(*ROW, F.coalesce("component", "node").alias("class_node"), F.coalesce("class_id", "set_id").alias("class_id"), "set_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = signs.filter("set_digest is null").select(*ROW, F.lit(None).cast("long").alias("class_node"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def near_classes(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (smallest id linked to it, over any number of steps), set_id
    (smallest id with the same shingle set), n_copies (rows of that set) and n_links (other sets at 0.8 or above)."""
    return near_rows(docs, text, id_column).select("doc_id", "class_id", "set_id", "n_copies", "n_links")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))
