"""Operator 11: ranked lexical search, variable-block-max WAND over sharded postings.

1. One narrow pass over the texts counts each document's terms.
2. Documents are dealt out to shards, by number and never by a key of theirs, so no term and no source makes a shard hot.
   A task turns the documents of a shard into postings: for each term the documents that hold it, with the part of the
   score that doesn't hang on the term's weight. Dynamic programming cuts each list into blocks of variable length such
   that the sum of bound errors (a block's maximum less each posting's own part) and of a cost for each block is least.
   A shard is one row of the index; its size is bounded by ``SHARD_DOCS`` and ``SHARD_POSTINGS`` in the mean.
3. Queries come in blocks of bounded size, which are broadcast, and meet every shard where it is read; nothing is
   shuffled. A query's block maxima add up to a bound for each document of the shard; short lists, whose blocks stretch over
   many documents that they don't hold, count for their documents only, as a pivot would. Documents are scored in the order
   of their bounds, only while a bound reaches the query's k-th best score so far; all others are skipped with their blocks.
   That score is carried from shard to shard within a task, and a task returns k documents for each query.

The index holds all terms; for a query set that is known beforehand and small, terms that no query has can be left out.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Defined results: null
and empty texts have no terms, aren't counted among the documents and are never found; repeated rows are documents of
their own; a null document id is a document like others and comes after all ids among equal scores; of equal rows of
queries one counts, an id with several query texts is one query of all their terms, and so are the queries without an id;
queries without terms find nothing; an empty table on either side gives an empty table; only ids and texts are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialise, read_table, slices

#: Documents and postings of a shard, in the mean.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
#: Most postings of a block, postings up to which a list is one block, and postings of a long list that are cut at once.
BLOCK_POSTINGS, ONE_BLOCK, SEGMENT = 64, 8, 1024
#: What a block costs, in units of bound error (a posting's part is below a million).
BLOCK_COST = 3_000_000
#: Terms of a block of queries, and terms and their bytes up to which an index can be held to those of the queries.
QUERY_TERMS, WANTED_TERMS, WANTED_BYTES = 1 << 20, 200_000, 8 << 20
#: Lists that hold less than one in so many documents of the shard are short.
SHORT = 16
#: Documents scored at first; each further step takes four times as many.
FIRST_SCORED = 64
#: Bytes of a text whose terms are counted at once.
PIECE = 8 << 20
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(text: bytes) -> Counter:
    """The terms of a text in UTF-8, and how often each occurs."""
    found, body, at = Counter(), text.translate(_TERM_BYTES), 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)
        end = len(body) if end < 0 else end
        found.update(body[at:end].split())
        at = end
    return found


def _lists(values: list, lengths: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values, kind))


def term_rows(rows: DataFrame, key: str, text: str, wanted: set[bytes] | None = None) -> DataFrame:
    """(key, n, terms, tfs): all terms of each text counted in ``n``, and the ``wanted`` ones with their occurrences."""
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches):
        only = shared and shared.value
        for whole in batches:
            for batch in slices(whole, 1):
                terms, tfs, lengths, totals = [], [], [], []
                for body in batch.column(1).to_pylist():
                    found = count_terms(body)
                    totals.append(found.total())
                    kept = found if only is None else only.intersection(found)
                    terms.extend(kept)
                    tfs.extend(map(found.__getitem__, kept))
                    lengths.append(len(kept))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), _lists(terms, lengths, pa.binary()), _lists(tfs, lengths, pa.int64())], names=["key", "n", "terms", "tfs"])

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return rows.select(F.col(key).cast("long").alias("key"), body.alias("body")).mapInArrow(frugal(run), "key long, n long, terms array<binary>, tfs array<long>")


def _cut(tops: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(rows, width) of marks where a block ends, for rows of parts of ``lengths``: the cheapest cuts, found for all rows at once."""
    rows, width = tops.shape
    paid = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(tops, 1)], 1)
    cost = np.zeros((rows, width + 1), np.int64)
    back = np.zeros((rows, width), np.int64)
    high = np.zeros((rows, 0), np.int64)
    for j in range(width):  # high[:, k]: the maximum of the block that holds the k postings before j, and j
        own = tops[:, j : j + 1]
        high = np.concatenate([own, np.maximum(high, own)], 1)[:, :BLOCK_POSTINGS]
        n = np.arange(1, high.shape[1] + 1)
        before = slice(j, j - len(n) if j >= len(n) else None, -1)
        total = cost[:, before] + paid[:, before] + n * high
        back[:, j] = np.argmin(total, 1)
        cost[:, j + 1] = total[np.arange(rows), back[:, j]] + BLOCK_COST - paid[:, j + 1]
    ends, at = np.zeros((rows, width), bool), lengths.copy()
    while (alive := np.flatnonzero(at > 0)).size:
        last = at[alive] - 1
        ends[alive, last] = True
        at[alive] = last - back[alive, last]
    return ends


def cut_blocks(counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Where the blocks of posting lists end: a mark for each posting. ``counts`` postings of each list stand in a row."""
    ends, starts = np.zeros(len(parts), bool), np.cumsum(counts) - counts
    ends[np.cumsum(counts) - 1] = True
    long = np.flatnonzero(counts > ONE_BLOCK)
    n = -(-counts[long] // SEGMENT)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(starts[long], n) + nth * SEGMENT
    lengths = np.minimum(SEGMENT, np.repeat(starts[long] + counts[long], n) - first)
    width = ONE_BLOCK
    while width < SEGMENT:
        width *= 2
        some = np.flatnonzero((lengths > width // 2 if width > 2 * ONE_BLOCK else lengths > 0) & (lengths <= width))
        for at in range(0, len(some), max(1, (1 << 18) // width)):
            own = some[at : at + max(1, (1 << 18) // width)]
            place = first[own, None] + np.arange(width)
            inside = np.arange(width) < lengths[own, None]
            marks = _cut(np.where(inside, parts[np.minimum(place, len(parts) - 1)], 0).astype(np.int64), lengths[own])
            ends[place[marks]] = True
    return ends


def _bytes(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


INDEX = "shard long, corpus_docs long, corpus_terms long, ids array<long>, terms array<binary>, counts array<long>, docs binary, parts binary, ends binary, tops binary"


def build_index(docs: DataFrame, wanted: set[bytes] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs``, a row for each shard, written to the shared folder; write it elsewhere to keep it.

    A row holds the document ids in ascending order, the terms with the lengths of their lists, and for all lists in a row
    the documents' places, their parts of the score, where blocks end and each block's maximum. It carries the number of
    documents with terms and the number of all terms of the corpus.
    """
    rows = materialise(term_rows(docs, id_column, text, wanted), "op11-terms")
    known = rows.filter("n > 0")
    size = known.agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    n_docs, n_terms = size["docs"], size["terms"] or 0
    shards = max(1, math.ceil(n_docs / SHARD_DOCS), math.ceil((size["postings"] or 0) / SHARD_POSTINGS))

    def shard_row(shard: int, batches: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("key").combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = np.array([25 + 75 * n * n_docs // n_terms for n in table.column("n").to_pylist()], np.int64)
        lists = table.column("terms").combine_chunks()
        held = lists.flatten().dictionary_encode()
        tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        code = held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.argsort(code * len(ids) + place[doc], kind="stable")
        counts, part, at = np.bincount(code, minlength=len(held.dictionary)), part[by], place[doc[by]]
        marks = np.flatnonzero(cut_blocks(counts, part))
        tops = np.maximum.reduceat(part, np.concatenate([[0], marks[:-1] + 1])) if len(marks) else part
        return shard, n_docs, n_terms, ids.take(pa.array(order)).to_pylist(), held.dictionary.to_pylist(), counts.tolist(), _bytes(at, "<i4"), _bytes(part, "<i4"), _bytes(marks + 1, "<i4"), _bytes(tops, "<i4")

    def run(batches):
        now, held = None, []

        def done():
            row = shard_row(now, held)
            held.clear()
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if shard[a] != now and held:
                        yield done()
                    now = int(shard[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield done()

    # Numbers of rows of a written table stay the same however often a task reads it.
    numbered = known.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    dealt = numbered.select("shard", "key", "n", "terms", "tfs").repartition("shard").sortWithinPartitions("shard")
    return materialise(dealt.mapInArrow(frugal(run), INDEX), "op11-index")


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    n = stops - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Shard:
    """One row of the index as arrays."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.docs, self.parts, self.ends, self.tops = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("docs", "parts", "ends", "tops"))
        self.stop = np.cumsum(row["counts"].to_numpy(zero_copy_only=False))
        self.start = np.concatenate([[0], self.stop[:-1]])
        self.block_stop = np.searchsorted(self.ends, self.stop, side="right")
        self.block_start = np.concatenate([[0], self.block_stop[:-1]])
        self.low = self.docs[np.concatenate([[0], self.ends[:-1]])]
        self.high = self.docs[self.ends - 1]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that each document can score, by the maxima of the blocks that may hold it and the short lists that do."""
        n = len(self.ids)
        short = self.stop[terms] - self.start[terms] < n / SHORT
        out = np.zeros(n, np.int64)
        some = _ranges(self.start[terms[short]], self.stop[terms[short]])
        np.add.at(out, self.docs[some], self.parts[some] * np.repeat(weights[short], self.stop[terms[short]] - self.start[terms[short]]))
        if not short.all():
            terms, weights = terms[~short], weights[~short]
            blocks = _ranges(self.block_start[terms], self.block_stop[terms])
            worth = self.tops[blocks] * np.repeat(weights, self.block_stop[terms] - self.block_start[terms])
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, self.low[blocks], worth)
            np.add.at(steps, self.high[blocks] + 1, -worth)
            out += np.cumsum(steps[:-1])
        return out

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t, w in zip(terms, weights, strict=True):
            a, b = self.start[t], self.stop[t]
            at = np.minimum(a + np.searchsorted(self.docs[a:b], docs), b - 1)
            here = self.docs[at] == docs
            out[here] += w * self.parts[at[here]]
        return out


class Best:
    """The k best documents of one query: scores, descending, and ids, ascending with nulls last among equal scores."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    def least(self) -> int:
        return max(1, -self.found[-1][0]) if len(self.found) >= self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.found = sorted([*self.found, *((-s, i is None, i) for s, i in zip(scores.tolist(), ids, strict=True))], key=lambda f: (f[0], f[1], f[2] or 0))[: self.k]


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds what the shard has to ``best``; returns how many documents it had to score."""
    bound = shard.bounds(terms, weights)
    docs = np.flatnonzero(bound >= best.least())
    docs = docs[np.argsort(-bound[docs], kind="stable")]
    at, step = 0, FIRST_SCORED
    while at < len(docs):
        least = best.least()
        some = docs[at : at + step]
        some = some[bound[some] >= least]
        if not len(some):
            break
        scores = shard.scores(some, terms, weights)
        good = np.flatnonzero(scores >= least)
        if len(good) > best.k:  # ties with the k-th stay: ids decide
            good = good[scores[good] >= np.partition(scores[good], -best.k)[-best.k]]
        best.add(scores[good], [shard.ids[i] for i in some[good]])
        at, step = at + len(some), 4 * step
    return at


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(queries: DataFrame, id_column: str, text: str) -> DataFrame:
    """(item, term, tf) of the queries, written to the shared folder."""
    distinct = queries.select(F.col(id_column).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter("text is not null").distinct()
    found = term_rows(distinct, "item", "text").select(F.col("key").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return materialise(found.groupBy("item", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("tf")), "op11-queries")


def _query_blocks(asked: DataFrame, index: DataFrame, n_docs: int) -> Iterator[list[tuple]]:
    """Blocks of queries (item, {term: weight}) of some QUERY_TERMS terms each; terms without weight or documents are left out."""
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("df"))
    found = held.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = materialise(asked.join(found, "term"), "op11-asked")
    blocks = math.ceil(weighed.count() / QUERY_TERMS)
    for block in range(blocks):
        items: dict = {}
        own = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        for r in own.toLocalIterator():
            w = weight(n_docs, r["df"]) * r["tf"]
            if w > 0:
                items.setdefault(r["item"], {})[bytes(r["term"])] = w
        if items:
            yield list(items.items())


def search(index: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of the index for each of the queries that ``query_terms`` gave."""
    spark = index.sparkSession
    size = index.select("corpus_docs").first()
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for block in _query_blocks(asked, index, size["corpus_docs"]) if size else ():
        found = found.unionByName(_search_block(index, block, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item", "rank", "doc_id", "score")


def _search_block(index: DataFrame, block: list[tuple], k: int) -> DataFrame:
    vocabulary = sorted({t for _, terms in block for t in terms})
    at = {t: i for i, t in enumerate(vocabulary)}
    plain = [(item, np.array([at[t] for t in terms], np.int64), np.array(list(terms.values()), np.int64)) for item, terms in block]
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, plain))

    def run(batches):
        vocabulary, queries = shared.value
        names, best = pa.array(vocabulary, pa.binary()), [Best(k) for _ in queries]
        for batch in batches:
            for n in range(batch.num_rows):
                terms, counts = (batch.column(c)[n].values for c in ("terms", "counts"))
                row = {c: batch.column(c)[n].as_py() for c in ("ids", "docs", "parts", "ends", "tops")}
                shard = Shard(row | {"counts": counts})
                place = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                for (_, words, weights), own in zip(queries, best, strict=True):
                    here = place[words] >= 0
                    if here.any():
                        search_shard(shard, place[words[here]], weights[here], own)
        rows = [(item, i, -s) for (item, _, _), own in zip(queries, best, strict=True) for s, _, i in own.found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return index.select("ids", "terms", "counts", "docs", "parts", "ends", "tops").mapInArrow(frugal(run), "item long, doc_id long, score long")


def wanted_terms(asked: DataFrame) -> set[bytes] | None:
    """All terms of the queries if they are few enough to be broadcast, else None."""
    terms = asked.select("term").distinct()
    size = terms.agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("bytes")).first()
    if size["n"] > WANTED_TERMS or (size["bytes"] or 0) > WANTED_BYTES:
        return None
    return {bytes(r["term"]) for r in terms.toLocalIterator()}


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """(item, rank, doc_id, score) of queries known beforehand: indexed and searched in one go."""
    asked = query_terms(queries, item_column, "text")
    return search(build_index(docs, wanted_terms(asked), id_column), asked, k)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


_WORD_LIST = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_WORD_LIST} AS words FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_WORD_LIST}) AS term FROM benchmark) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY ALL),
weights AS (SELECT item_id, term, tf * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN dfs USING (term), corpus),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM lengths, corpus),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m))) AS BIGINT) AS score FROM weights JOIN posts p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranks WHERE rank <= 10
"""
