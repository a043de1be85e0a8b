"""Operator 2: best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than the capacity are cut into full pieces and a rest. Pieces above a third of the capacity fit at
most twice into a sequence; greedy matching pairs each, longest first, with the longest that still fits. Smaller pieces
follow, longest first, each into the tightest gap that takes it. Only lengths matter for that, so the plan is made from
the histogram of lengths (as many rows as the capacity at most, however large the corpus) in runs of equal sequences;
pieces then find their places by their rank among pieces of their length, which salted counts give without a hot task.

Defined results: a null or empty text is a document of its end token alone; repeated rows are packed each; an empty
table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialise, read_table, slices, text_or_empty
from .words import loaded, read_definition

#: Salts for each length when ranking: keeps a common length from flooding a task.
SALTS = 256


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each row; no shuffle."""
    data, key = read_definition(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast(data)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = loaded(key, shared)
        for whole in batches:
            for batch in slices(whole, 1):
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(tokenizer.ids(batch.column(1).to_pylist())):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                number = np.array(piece, "i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(number * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(frugal(run, holds=True), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Runs of equal placements: pieces of one length from a rank on, so many to each sequence, from one offset on."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.ranked: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces each, offset
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: [(first sequence, sequences)]
        self.sizes: list[int] = []  # gaps that some sequence has, sorted

    def open(self, n: int) -> tuple[int, int]:
        self.sequences += n
        return self.sequences - n, n

    def gap(self, size: int, first: int, n: int) -> None:
        if n and size:
            if not self.gaps[size]:
                insort(self.sizes, size)
            self.gaps[size].append((first, n))

    def place(self, length: int, pieces: int, first: int, each: int, offset: int) -> None:
        self.runs.append((length, self.ranked[length], first, each, offset))
        self.ranked[length] += pieces

    def match_large(self, left: dict[int, int]) -> None:
        """Pair pieces above a third: the longest with the longest that fits beside it."""
        sizes = sorted(left)
        while sizes:
            length = sizes[-1]
            at = bisect_left(sizes, self.capacity - length + 1) - 1
            partner = sizes[at] if at >= 0 else None
            if partner == length and left[length] == 1:
                partner = sizes[at - 1] if at > 0 else None
            n = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            first, n = self.open(n)
            if partner == length:
                self.place(length, 2 * n, first, 2, 0)
                left[length] -= 2 * n
            else:
                self.place(length, n, first, 1, 0)
                left[length] -= n
                if partner is not None:
                    self.place(partner, n, first, 1, length)
                    left[partner] -= n
            self.gap(self.capacity - length - (partner or 0), first, n)
            for x in {length, partner} - {None}:
                if not left[x]:
                    sizes.remove(x)

    def fit_small(self, length: int, pieces: int) -> None:
        """Best fit: the tightest gaps first, new sequences when none is wide enough."""
        while pieces:
            at = bisect_left(self.sizes, length)
            if at == len(self.sizes):
                each = self.capacity // length
                first, n = self.open(-(-pieces // each))
                self.gap(self.capacity, first, n)
                continue
            size = self.sizes[at]
            first, n = self.gaps[size].pop()
            if not self.gaps[size]:
                self.sizes.pop(at)
            each = size // length
            full = min(n, pieces // each)
            if not full:
                each, full = pieces, 1
            self.place(length, full * each, first, each, self.capacity - size)
            pieces -= full * each
            self.gap(size - each * length, first, full)
            self.gap(size, first + full, n - full)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces each, offset), sorted; from counts of lengths alone."""
    made = _Plan(capacity)
    made.match_large({n: c for n, c in histogram.items() if 3 * n > capacity and c})
    for n in sorted((n for n in histogram if 3 * n <= capacity), reverse=True):
        made.fit_small(n, histogram[n])
    return np.array(sorted(made.runs), "i8").reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: a number from 0 for each piece among those of its length. Salts first, then their offsets."""
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    salted = salted.withColumn("__in_salt", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1)
    counts = pieces.groupBy("length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int").alias("__salt")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A row for each length and salt: their number is bounded by the capacity, whatever the corpus.
    return salted.join(F.broadcast(before.drop("__n")), ["length", "__salt"]).withColumn("rank", F.col("__before") + F.col("__in_salt")).drop("__before", "__in_salt", "__salt")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a column ``length`` of 1 to ``capacity`` and keys doc_id, piece."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs = shared.value
        wide = int(runs[:, 1].max(initial=0)) + int(rank.max() if len(rank) else 0) + 1
        at = np.searchsorted(runs[:, 0] * wide + runs[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        run = runs[at]
        nth = rank.to_numpy() - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": run[:, 4] + nth % run[:, 3] * run[:, 0]})

    placed = ranked(pieces).withColumn("__at", place("length", "rank"))
    return placed.select(*pieces.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(materialise(pieces_of(docs, tokenizer_path, capacity, end_id), "op2-pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
