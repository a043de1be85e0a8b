"""Operator 13: near-duplicates by SimHash, found with multi-index hashing.

1. One narrow pass over the texts gives each its fingerprint. Rows with one and the same fingerprint are one print from
   here on, so copies cost nothing.
2. Fingerprints are cut into ``SEGMENTS`` parts of equal width, each with a table keyed by the part's value. Two prints
   within ``DISTANCE`` bits differ in at most DISTANCE // SEGMENTS = 1 bit of one part at least, so the ball of that
   radius around a part meets the other's entry in its table. Of two parts one bit apart one has a zero there, so each
   print probes only with its zeros set, and the other's entry answers: half a ball finds every pair once.
3. Probes of values that nobody has go in a join with the tables' key counts. What is left of a key, its entries and the
   probes that met it, is verified on all 64 bits in a task; a key with more than ``BLOCK`` of them is cut into blocks that
   meet in pairs. A block returns a forest over the linked pairs; pairs aren't emitted.
4. Connected components over these forests are the result.

Words are maximal runs of what isn't ASCII white space, A-Z lower-cased; shingles of three words, repeats included; a text
of one or two words is one shingle. Defined results: null and empty texts and those of white space alone have fingerprint
zero, which is linked like any other; repeated rows and ids with several texts are rows of their own; null ids are rows
like others but never the smallest id of a component unless it has no other; an empty table gives an empty table; only id
and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialise, read_table, slices
from .jaccard_join import components

SHINGLE_WORDS, SEED, DISTANCE = 3, 42, 3
SEGMENTS, WIDTH = 2, 32
#: Prints of a block of a key; a key of m prints meets in pairs of ceil(m / BLOCK) blocks. Prints compared at once.
BLOCK, TOGETHER = 4096, 256
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text in UTF-8."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    total, bits = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        some = words[at : at + CHUNK + size - 1]
        joined = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts, stops = np.concatenate([[0], ends[:-1]])[: len(some) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist()
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, print) for each row, the print as a signed long."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("body")).mapInArrow(frugal(run), "doc_id long, print long")


def part_of(fingerprint: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fingerprint, WIDTH * segment).bitwiseAND(F.lit((1 << WIDTH) - 1))


def entries(prints: DataFrame) -> DataFrame:
    """(segment, value, print): what the tables hold, one entry of each print in each."""
    parts = F.array(*[F.struct(F.lit(s).alias("segment"), part_of(F.col("print"), s).alias("value")) for s in range(SEGMENTS)])
    return prints.select("print", F.explode(parts).alias("e")).select("e.segment", "e.value", "print")


def probes(table: DataFrame) -> DataFrame:
    """(segment, value, print): the half of each part's ball of radius one that sets one of its zeros, without the part itself."""
    flips = F.array(*[F.lit(1 << b).cast("long") for b in range(WIDTH)])
    free = F.filter(flips, lambda f: F.col("value").bitwiseAND(f) == 0)
    return table.select("segment", F.explode(free).alias("flip"), "value", "print").select("segment", F.col("value").bitwiseOR(F.col("flip")).alias("value"), "print")


def block_links(prints: np.ndarray, entry: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(edges, 2) of prints: a forest over the linked pairs of an entry and an entry or probe of one key.

    ``high`` tells the second of two blocks; inside one block it is false throughout. A print's links to a tree that it is
    part of already aren't followed, so a dense group costs one look along it for each print.
    """
    across, edges = high.any(), []
    nodes, place = np.unique(prints, return_inverse=True)
    tree = np.arange(len(nodes))
    for a, b in ((entry & ~high, high), (~entry & ~high, entry & high)) if across else ((entry, entry), (entry, ~entry)):
        left, right = np.flatnonzero(a), np.flatnonzero(b)
        for at in range(0, len(left), TOGETHER):
            some = left[at : at + TOGETHER]
            near = np.bitwise_count(prints[some, None] ^ prints[None, right]) <= DISTANCE
            near &= tree[place[some]][:, None] != tree[place[right]][None]
            for n in np.flatnonzero(near.any(1)):
                own, others = place[some[n]], place[right[near[n]]]
                joined, first = np.unique(tree[others], return_index=True)
                new = joined != tree[own]
                edges += [(own, others[f]) for f in first[new]]
                tree[np.isin(tree, joined[new])] = tree[own]
    return nodes[np.array(edges, np.int64).reshape(-1, 2)].view(np.int64)


def verified(met: DataFrame) -> DataFrame:
    """Rows (segment, value, print, entry, m) of keys with m rows to edges (a, b) of linked prints."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    dealt = met.withColumns({"own": F.pmod(F.xxhash64("print"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    dealt = dealt.select("segment", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("top"), "print", "entry", (F.col("own") > F.col("other")).alias("high"))

    def run(batches):
        key, held = None, []

        def done():
            prints, entry, high = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return block_links(prints.view(np.uint64), entry, high)

        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            body = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, 7)]
            cuts, found = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1).tolist(), len(head)], [np.zeros((0, 2), np.int64)]
            for a, b in zip(cuts, cuts[1:]):
                if tuple(head[a]) != key and held:
                    found.append(done())
                key = tuple(head[a])
                held.append([c[a:b] for c in body])
            found = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        if held:
            found = done()
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    keys = ["segment", "value", "low", "top"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(frugal(run), "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between prints (distinct) within DISTANCE bits that join all that are linked."""
    table = materialise(entries(prints), "op13-entries")
    counts = materialise(table.groupBy("segment", "value").agg(F.count("*").alias("n")), "op13-counts")
    met = materialise(probes(table).join(counts.select("segment", "value"), ["segment", "value"]), "op13-met")
    probed = met.groupBy("segment", "value").agg(F.count("*").alias("p"))
    sizes = counts.join(probed, ["segment", "value"], "left").select("segment", "value", (F.col("n") + F.coalesce("p", F.lit(0))).alias("m")).filter("m > 1")
    rows = table.withColumn("entry", F.lit(True)).unionByName(met.withColumn("entry", F.lit(False)))
    return verified(rows.join(materialise(sizes, "op13-sizes"), ["segment", "value"]))


def near_prints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, print, component_id) for each row: the smallest id that links of prints reach."""
    rows = materialise(fingerprints(docs, text, id_column), "op13-rows")
    prints = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "op13-prints")
    found = components(materialise(links(prints.select("print")), "op13-links"), "op13")
    named = materialise(found.join(prints, found["node"] == prints["print"]).select("component", "print", "least"), "op13-named")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    grouped = named.join(materialise(smallest, "op13-smallest"), "component").select("print", "smallest")
    ids = materialise(prints.join(grouped, "print", "left").select("print", F.coalesce("smallest", "least").alias("component_id")), "op13-ids")
    return rows.join(ids, "print").select("doc_id", "print", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_prints(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
