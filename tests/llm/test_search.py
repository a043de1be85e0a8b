"""Ranked search, hard negatives and SimHash: against brute force, at the edges of blocks, and on odd input."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlight.llm import hard_negatives, lexical_search, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score long, rank int, term string, print long"
ODD = ["", None, "a", " ", "a  b\n\n c x y's  'S I'm  \t\n", "word " * 3000, "\x1c\x1d x", "ééé İstanbul ΣΑΣ", "\x85a\x85 b", "Same text one", "same  TEXT one", "Same text one", "x" * 5000]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, long texts, ties, repeated rows, a null id and columns with clashing names."""
    rows = [(None if i == 4 else i, t, None, None if i % 3 else "s", None, 1, 2, "x", 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], rows[10]], SCHEMA)


# Ranked search


def search_by_hand(docs, items, k=10):
    """The k best (item, rank, doc_id, score) by plain sums."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    docs = [(d, Counter(words(t))) for d, t in docs]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    asked: dict = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            found.append((-score, d is None, d or 0, d, score))
        out += [(item, i + 1, d, s) for i, (_, _, _, d, s) in enumerate(sorted(x for x in found if x[4] > 0)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,wanted", [(8192, 200_000), (40, 200_000), (40, 1)])
def test_search(spark, odd, monkeypatch, shard, wanted):
    """One shard and several, with the terms of the queries only and with all terms."""
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "WANTED_TERMS", wanted)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    more = spark.createDataFrame([(7001, "same text b x"), (7001, "same text b x"), (7001, "word"), (7002, None), (None, "İstanbul ééé"), (7003, "the the of The")], items.schema)
    docs, items = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), items.unionByName(more)
    got = lexical_search.ranked(docs, items).collect()
    assert sorted(map(tuple, got), key=str) == search_by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_search_of_nothing(spark, odd):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked(none, items).count() == 0
    assert lexical_search.ranked(odd.filter("text = ' '"), items).count() == 0
    assert lexical_search.ranked(odd, items.limit(0)).count() == 0


def test_searches_in_blocks_of_queries(spark, odd, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["same text", "a b", "word x", "one"])], "item_id long, text string")
    whole = sorted(map(tuple, lexical_search.ranked(odd, items).collect()))
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 2)
    assert sorted(map(tuple, lexical_search.ranked(odd, items).collect())) == whole and whole


def least_cost(parts):
    """The cost of the cheapest cuts of one list, by the textbook recursion."""
    best = [0]
    for j in range(1, len(parts) + 1):
        costs = []
        for i in range(max(0, j - lexical_search.BLOCK_POSTINGS), j):
            block = parts[i:j]
            costs.append(best[i] + lexical_search.BLOCK_COST + sum(max(block) - p for p in block))
        best.append(min(costs))
    return best[-1]


def test_blocks_are_cut_at_least_cost():
    r = np.random.default_rng(4)
    counts = np.array([1, 8, 9, 40, 130, 1024, 2100])
    parts = r.integers(200_000, 900_000, counts.sum())
    ends = lexical_search.cut_blocks(counts, parts)
    at = 0
    for n in counts:
        own, marks = parts[at : at + n].tolist(), np.flatnonzero(ends[at : at + n]) + 1
        assert marks[-1] == n
        blocks = [own[a:b] for a, b in zip([0, *marks], marks)]
        cost = sum(lexical_search.BLOCK_COST + sum(max(b) - p for p in b) for b in blocks)
        if n > lexical_search.ONE_BLOCK:
            assert cost == sum(least_cost(own[i : i + lexical_search.SEGMENT]) for i in range(0, n, lexical_search.SEGMENT))
            assert max(map(len, blocks)) <= lexical_search.BLOCK_POSTINGS and (n < 100 or len(set(map(len, blocks))) > 1)
        at += n


@pytest.mark.parametrize("rare,weights", [(40, (10, 9000)), (2000, (100, 300))])
def test_blocks_are_skipped(rare, weights):
    """A rarer term with a heavier weight decides: most documents' bounds never reach the k-th best score."""
    r, n = np.random.default_rng(5), 8000
    lists = [np.arange(n), np.sort(r.choice(n if rare < 100 else n // 2, rare, replace=False))]
    parts = [r.integers(400_000, 500_000, n), np.sort(r.integers(200_000, 800_000, rare))]
    counts = np.array([n, rare])
    marks = np.flatnonzero(lexical_search.cut_blocks(counts, np.concatenate(parts)))
    tops = np.maximum.reduceat(np.concatenate(parts), np.concatenate([[0], marks[:-1] + 1]))

    class Counts:
        def to_numpy(self, zero_copy_only):
            return counts

    pack = lambda x: np.asarray(x, "<i4").tobytes()
    shard = lexical_search.Shard({"ids": list(range(n)), "docs": pack(np.concatenate(lists)), "parts": pack(np.concatenate(parts)), "ends": pack(marks + 1), "tops": pack(tops), "counts": Counts()})
    best, weights = lexical_search.Best(10), np.array(weights)
    scored = lexical_search.search_shard(shard, np.array([0, 1]), weights, best)
    whole = np.zeros(n, np.int64)
    for docs, own, w in zip(lists, parts, weights):
        whole[docs] += own * w
    assert [i for _, _, i in best.found] == np.lexsort((np.arange(n), -whole))[:10].tolist()
    assert scored < n // 4


# Hard negatives


def negatives_by_hand(rows, anchors, positives=5, negatives=10, band=(30, 90)):
    rows = {i: (label, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, label, v in rows}
    out = []
    for a in filter(anchors, rows):
        scores = sorted((-int(rows[a][1] @ v), i, label == rows[a][0]) for i, (label, v) in rows.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            fits = [(n, i) for n, i, same in scores if not same and band[0] * -s <= 100 * -n <= band[1] * -s]
            out += [(a, p, rank + 1, i, -s, -n) for rank, (n, i) in enumerate(fits[:negatives])]
    return sorted(out)


def clustered(n, dimension, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dimension)) * 2
    return [(i, int(r.integers(0, 4)), (centres[i % 8] + 0.2 * r.normal(size=dimension)).tolist()) for i in range(n)]


@pytest.mark.parametrize("n,leaf,block,group,slices", [(300, 4096, 8192, 512, 1024), (1500, 128, 64, 3, 1)])
def test_hard_negatives(spark, monkeypatch, n, leaf, block, group, slices):
    """One leaf, and many leaves of several blocks, groups and slices; equal vectors, ties and odd rows among them."""
    for name, value in (("LEAF_ROWS", leaf), ("BLOCK_ROWS", block), ("GROUP_ANCHORS", group), ("SLICE_GROUPS", slices)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(n, 12, 6)
    rows += [(n + i, i % 4, rows[i][2]) for i in range(40)] + [(n + 40 + i, 1, [0.0] * 12) for i in range(4)]
    bad = [(None, 1, rows[0][2]), (9001, None, rows[0][2]), (9002, 1, None), (9003, 1, [float("nan")] * 12), (9004, 1, [float("inf")] * 12), (9005, 1, [1.0]), (9006, 1, [None] * 12), (9007, 1, []), (9008, 1, [1e30] * 12), rows[5], rows[10]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, label int, embedding array<double>, id long, score long")
    got = hard_negatives.mine(df, F.col("id") % 10 == 0, 5, 10, (30, 90))
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0, 5, 10, (30, 90)).columns == got.columns
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0, 5, 10, (30, 90)).count() == 0


def test_one_row_of_an_id_takes_part(spark):
    df = spark.createDataFrame([(1, 3, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 2, [0.0, 0.5]), (2, 2, [0.0, 1.0]), (3, 4, [0.0, 0.7])], "vec_id long, label int, embedding array<float>")
    got = hard_negatives.mine(df, F.col("id") == 1, 5, 10, (30, 90)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 3, 128 * 256, 128 * 179)]


def test_trees_hold_their_rows_and_prune():
    r = np.random.default_rng(7)
    rows = np.floor(256 * (np.repeat(4 * r.normal(size=(16, 24)), 64, axis=0) + 0.05 * r.normal(size=(1024, 24))))
    tree, anchors = hard_negatives.Balls(rows, 64), hard_negatives.Balls(rows[:32], 8)
    products = rows[:32] @ rows.T
    for (cuts, *a), (ends, *b) in ((anchors.levels[-1], tree.levels[-1]), (anchors.levels[0], tree.levels[1])):
        least, most = hard_negatives.interval(a, b)
        for i, (p, q) in enumerate(zip(cuts, cuts[1:])):
            for j, (s, t) in enumerate(zip(ends, ends[1:])):
                own = products[np.ix_(anchors.order[p:q], tree.order[s:t])]
                assert least[i, j] <= own.min() and own.max() <= most[i, j]
    low, high = np.sort(products, 1)[:, -5], np.full(32, hard_negatives.HIGHEST)
    i, j, _ = hard_negatives.met_ends(anchors, tree, low, high)
    assert len(i) <= 0.3 * 4 * 16  # structure lets most pairs of nodes go


def test_large_products_are_exact():
    rows = np.array([[float((1 << 24) - 1 - i)] * 64 for i in range(3)])
    block = hard_negatives.Block(np.arange(3), np.zeros(3, int), rows)
    assert block.products(rows[:1], np.arange(3))[0].tolist() == [64 * ((1 << 24) - 1) * int(block.rows[i, 0]) for i in range(3)]


# SimHash


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_by_hand(prints):
    """{print: smallest print of its component}."""
    up = {p: p for p in prints}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    ps = sorted(up)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {p: top(p) for p in ps}


def components_by_hand(rows):
    prints = [(d, print_by_hand(t)) for d, t in rows]
    of = linked_by_hand({p for _, p in prints})
    least: dict = {}
    for d, p in prints:
        known = least.get(of[p])
        least[of[p]] = d if known is None else known if d is None else min(known, d)
    return sorted(((d, p, least[of[p]]) for d, p in prints), key=str)


def test_simhash(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    words = "many words of one long text that is copied with a small change at its end so that prints stay near each other".split()
    near = [(900 + i, " ".join([*words * 6, str(i)])) for i in range(20)]
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = [(r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in simhash.near_prints(both).collect()]
    expected = components_by_hand([tuple(r) for r in both.collect()])
    assert sorted(got, key=str) == expected
    assert len({c for d, _, c in expected if d and d >= 900}) < 20
    assert simhash.near_prints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.near_prints(odd).columns == ["doc_id", "print", "component_id"]


def test_prints_of_long_texts(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    for text in (" ".join(f"w{i * i % 97}" for i in range(300)), "A b", "a", "one two Three", "x " * 7, "\x1c a \x00 é"):
        assert simhash.fingerprint(text.encode()) == print_by_hand(text)


@pytest.mark.parametrize("block", [4096, 8])
def test_near_prints_are_found(spark, monkeypatch, block):
    """Prints around a few centres and alone, keys of one block and of many, signs included."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = np.random.default_rng(9)
    centres = [int(x) for x in r.integers(0, 1 << 63, 6, dtype=np.uint64)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(30):
            p = c
            for b in r.choice(64, r.integers(1, 5), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "print long")).collect()
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in edges]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    up = {p: p for p in prints}
    for a, b in edges:
        top = [a, b]
        for i in range(2):
            while up[top[i]] != top[i]:
                top[i] = up[top[i]]
        up[max(top)] = min(top)

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    assert {p: root(p) for p in prints} == linked_by_hand(prints)
