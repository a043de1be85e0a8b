"""Operator 1: byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token that is itself a token; any other
pre-token is merged by a heap over a linked list of its bytes, lowest rank first and leftmost among equals, which
is the order that rank files define. Each worker keeps a bounded cache of what it has encoded.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows give repeated results;
an empty table gives an empty table; columns of the input that clash with the result's names are replaced by them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoGenerations, frugal, held, read_table, slices, text_or_empty

#: White space as the rank file's own splitter has it (Unicode White_Space). Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GOLD, _M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1
_NONE = 1 << 30


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank from the lines ``base64 rank`` of a rank file."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * _GOLD)) & _M64
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _M64
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """Minimal perfect hash by displacement: a bucket's displacement sends each of its keys to a slot of its own.

    ``displacement[bucket]`` is negative where a bucket has one key: then it names the slot outright.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.displacement, self.rank_at = [0] * self.buckets, [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = iter(())
        for b in order:
            if len(members[b]) > 1:
                d = 0
                while True:
                    slots = [_slot(hashes[i], d, n) for i in members[b]]
                    if len(set(slots)) == len(slots) and all(self.rank_at[s] < 0 for s in slots):
                        break
                    d += 1
                self.displacement[b] = d
                for i, s in zip(members[b], slots, strict=True):
                    self.rank_at[s] = i
        free = iter([s for s in range(n) if self.rank_at[s] < 0])
        for b in order:
            if len(members[b]) == 1:
                s = next(free)
                self.displacement[b], self.rank_at[s] = -s - 1, members[b][0]

    def candidate(self, key: bytes) -> int:
        """The one rank that ``key`` may have; the caller compares the token itself."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        return self.rank_at[-d - 1 if d < 0 else _slot(h, d, self.n)]


class ByteBPE:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str, table: PerfectHash | None = None):
        self.tokens = read_ranks(ranks)
        self.table = table or PerfectHash(self.tokens)
        space = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(space).findall
        #: A pre-token never goes on from other characters into white space, so texts fall into pieces there.
        self.pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        ids = {token: i for i, token in enumerate(self.tokens)}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.words = TwoGenerations(self._pretoken)
        self.cache = TwoGenerations(self._piece)

    def merge(self, data: bytes) -> list[int]:
        """Heap over linked bytes; entries whose pair has changed meanwhile are skipped when they come up."""
        n, get = len(data), self.pairs.get
        byte_ids = self.byte_ids
        ids = [byte_ids[b] for b in data]
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        now.append(_NONE)
        heap = [r << 32 | i for i, r in enumerate(now) if r != _NONE]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if now[i] != rank:
                continue
            gone = after[i]
            nxt = after[gone]
            ids[i], after[i], now[gone] = rank, nxt, -1
            if nxt < n:
                before[nxt] = i
                r = now[i] = get(rank << 20 | ids[nxt], _NONE)
                if r != _NONE:
                    heappush(heap, r << 32 | i)
            else:
                now[i] = _NONE
            p = before[i]
            if p >= 0:
                r = now[p] = get(ids[p] << 20 | rank, _NONE)
                if r != _NONE:
                    heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _pretoken(self, word: str) -> bytes:
        data = word.encode()
        rank = self.table.candidate(data)
        ids = [rank] if self.tokens[rank] == data else self.merge(data)
        return array("I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.split(piece)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def turn(self) -> None:
        self.words.turn()
        self.cache.turn()


def _over(df: DataFrame, ranks_path: str, pattern: str, source: Column, keep: list[str] | None, added: list[str], kernel) -> DataFrame:
    """The columns ``keep`` (all, if None) and binary ones that ``kernel(codec, value)`` makes from ``source``; no shuffle.

    The vocabulary, which doesn't grow with the data, goes to the tasks as one broadcast.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern, PerfectHash(read_ranks(ranks))))
    fields = [f for f in df.schema.fields if f.name.lower() not in {a.lower() for a in added} and (keep is None or f.name in keep)]
    names = [f.name for f in fields]

    def run(batches):
        codec = held(f"bpe {key}", lambda: ByteBPE(*shared.value))
        for whole in batches:
            for batch in slices(whole, len(names)):
                made = [kernel(codec, v) for v in batch.column(len(names)).to_pylist()]
                codec.turn()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([m[k] for m in made], pa.binary()) for k in range(len(added))]], names=[*names, *added])

    plan = df.select(*[F.col(f"`{n}`") for n in names], source.alias("__source"))
    return plan.mapInArrow(frugal(run, holds=True), T.StructType([*fields, *[T.StructField(a, T.BinaryType()) for a in added]]))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``token_ids``: the tokens of column ``text`` as binary, little-endian unsigned 32-bit integers."""
    return _over(df, ranks_path, pattern, text_or_empty(text), keep, ["token_ids"], lambda c, v: (c.encode(v),))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded``: the bytes that the tokens in column ``ids`` stand for."""
    return _over(df, ranks_path, pattern, F.col(ids), keep, ["decoded"], lambda c, v: (c.decode(v or b""),))


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``token_ids`` and ``decoded`` in one pass over the rows, in one Python worker."""
    return _over(df, ranks_path, pattern, text_or_empty(text), keep, ["token_ids", "decoded"], _both)


def _both(codec: ByteBPE, value: str) -> tuple[bytes, bytes]:
    return (ids := codec.encode(value)), codec.decode(ids)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    both = encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return both.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
