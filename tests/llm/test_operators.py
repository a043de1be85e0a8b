"""The operators on small tables: against libraries, brute force and stated edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, exact_dedup, jaccard_join, license_scan, line_dedup, neighbours, packing, quality, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hit boolean, digest string"
ODD = ["", None, "a", " ", "a  b\n\n c　　x y's  'S I'm  \t\n", "word " * 3000, "\x1c\x1d x", "<|endoftext|> b <|startoftext|>x", "ééé İstanbul ΣΑΣ", "\x85a\x85 b", "Same text", "same  TEXT", "Same text", "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, None, None if i % 3 else "s", None, 1.0, True, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], rows[10]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def by_row(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_perfect_hash():
    keys = [f"key{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.rank_at) == list(range(5000))
    assert all(table.candidate(k) == i for i, k in enumerate(keys))


def test_bpe_matches_library(odd, documents, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, documents):
        for r in bpe.encode_and_decode(df, RANKS, P.PATTERN).collect():
            text = r["text"] or ""
            assert np.frombuffer(r["token_ids"], "<u4").tolist() == library.encode_ordinary(text)
            assert bytes(r["decoded"]).decode() == text
    assert bpe.encode_and_decode(empty, RANKS, P.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(odd, RANKS, P.PATTERN, keep=["doc_id"]), RANKS, P.PATTERN).columns == ["doc_id", "token_ids", "decoded"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_words_match_library(library):
    """What the merger gives for Latin words is what the library gives; odd ones go to the library itself."""
    from ledgerlight.llm.words import WordTokenizer

    tokenizer = WordTokenizer(open(WORDS, "rb").read())
    r = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789'-.,!?;:_/@#$%&*()[]{}+=~\"\\éÉüßñøŁ\u0149\u01c5\u0130\u017f|<>\0\u0301日本Σς") + ["'s", "'LL", "ing", "tion", "1999"]
    words = ["".join(r.choice(letters, r.integers(1, 30))) for _ in range(20_000)] + ["x" * 5000, "ab" * 40_000, "don't", "'s's", "\0", "a\0b"]
    assert tokenizer.merger is not None
    assert tokenizer.ids(words) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(words, add_special_tokens=False)]
    assert tokenizer.ids([" ".join(words)])[0] == b"".join(tokenizer.ids(words))


def pack_by_hand(lengths, capacity):
    """Best fit decreasing over single pieces."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(best)
            gaps.append(best - n)
    return len(gaps)


def check_packed(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing(odd, documents, empty, library):
    for df in (odd, documents):
        rows = packing.packed_documents(df, WORDS).collect()
        n = check_packed(rows, 2048)
        assert n <= pack_by_hand([r["length"] for r in rows], 2048)
        want = []
        for d in df.collect():
            ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [0]
            want += [(d["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert packing.packed_documents(empty, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, 3000) if seed % 2 else np.minimum(100, r.geometric(0.05, 3000))
    runs = packing.plan(dict(Counter(lengths.tolist())), 100)
    rows, seen = [], Counter()
    for n in lengths.tolist():
        rank = seen[n]
        seen[n] += 1
        run = [x for x in runs if x[0] == n and x[1] <= rank][-1]
        k = rank - run[1]
        rows.append({"length": n, "sequence_id": run[2] + k // run[3], "offset": run[4] + k % run[3] * n})
    bins = check_packed(rows, 100)
    assert bins <= pack_by_hand(lengths.tolist(), 100) * 1.01 + 1
    large = [n for n in lengths.tolist() if 3 * n > 100]
    counts = Counter(x["sequence_id"] for x in rows if 3 * x["length"] > 100)
    assert max(counts.values()) <= 2 and len(counts) <= len(large)


def test_exact_dedup(odd, documents, empty, monkeypatch):
    import re

    def want(df):
        groups = defaultdict(list)
        for r in df.collect():
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
        return sorted((i, min(g), len(g)) for g in groups.values() for i in g)

    assert by_row(exact_dedup.exact_groups(odd), "doc_id", "keep_id", "group_size") == want(odd)
    assert exact_dedup.exact_groups(empty).count() == 0
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 20)
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 8)  # a full filter: every row is a possible hit
    assert by_row(exact_dedup.exact_groups(documents), "doc_id", "keep_id", "group_size") == want(documents)


def test_digest_collisions_are_told_apart(odd, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab" * 32))
    got = by_row(exact_dedup.exact_groups(odd.filter("doc_id in (2, 10, 11, 12)")), "doc_id", "keep_id", "group_size")
    monkeypatch.undo()
    assert got == [(2, 2, 1), (10, 10, 3), (10, 10, 3), (11, 11, 1), (12, 10, 3)]


def test_token_counts(spark, odd, documents, empty, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    for df in (odd, documents, documents):
        got = by_row(token_counts.cached_counts(df, WORDS, cache), "doc_id", "n_bytes", "n_tokens")
        assert got == sorted((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
        kept = spark.read.parquet(cache).count()
    assert kept == spark.read.parquet(cache).select("content_digest").distinct().count() + spark.read.parquet(cache).groupBy("content_digest").count().filter("count > 1").count()
    assert token_counts.cached_counts(empty, WORDS, cache).count() == 0 and spark.read.parquet(cache).count() == kept
    model = P.path("piece_bpe_32k.model")
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=model)
    assert by_row(token_counts.cached_counts(odd, model, f"{cache}2"), "doc_id", "n_tokens") == sorted((r["doc_id"], len(s.encode(r["text"] or ""))) for r in odd.collect())


def test_recurrent_gradients():
    r = np.random.default_rng(0)
    net = toxicity.BiGRU()
    net.w = {k: v.astype("f8") for k, v in net.w.items()}
    x, mask = r.normal(size=(5, 3, toxicity.INPUTS)), np.ones((5, 3))
    mask[3:, 0] = 0
    y, weight = np.array([1.0, 0, 1]), np.ones(3)
    loss = lambda: float(-(y * np.log(net.forward(x, mask)) + (1 - y) * np.log(1 - net.forward(x, mask))).mean())
    found = net.gradients(x, mask, y, weight)
    for k, w in [*net.w.items(), ("x", x)]:
        at = tuple(i - 1 for i in w.shape)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        down = loss()
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - found[k][at]) < 2e-4, k


def test_windows_cover_texts():
    for n in (0, 1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 100, 1000):
        starts = list(toxicity.starts_of(n))
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9 and np.mean(np.array(clean) < 0.7) > 0.95
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = toxicity.train(*toxicity.training_rows(docs, labels))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, scorer, ["doc_id"]).collect()}
    assert got[0] == got[1] == 0.0 and got[10] == got[12] and all(0 <= s <= 1 for s in got.values())
    everything = toxicity.score(odd, scorer, odd.columns, into="score_")
    assert everything.columns == [*odd.columns, "score_"] and {r["doc_id"]: r["score_"] for r in everything.collect()} == got
    texts = [r["text"] for r in docs.limit(60).collect()] + [" ".join(r["text"] or "" for r in docs.limit(40).collect()) * 20]
    for text, found in zip(texts, scorer.scores(texts), strict=True):  # each window alone, without padding or batches
        words = toxicity.words_of(text)
        parts = [words[a : a + toxicity.WINDOW] for a in range(0, len(words), toxicity.STRIDE) if a == 0 or a + toxicity.WINDOW - toxicity.STRIDE < len(words)]
        alone = [scorer.net.forward(scorer.features.rows(p)[:, None], np.ones((len(p), 1), "f4"))[0] for p in parts]
        assert abs(found - max(alone, default=0.0)) < 2e-5
    assert toxicity.score(empty, scorer, ["doc_id"]).count() == 0
    assert toxicity.train(*toxicity.training_rows(docs, labels.filter("toxic = 0"))) is None
    assert {r["score"] for r in toxicity.score(odd, None, ["doc_id"]).collect()} == {0.0}


def test_toxic_phrase_late_in_one_run():
    r = np.random.default_rng(3)
    plain = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(60)]
    texts = [" ".join(np.insert(r.choice(plain, 40).astype("U8"), r.integers(0, 40), ["vilezork"] * (i % 2))) for i in range(120)]
    scorer = toxicity.train(texts, np.array([i % 2 for i in range(120)], "f4"))
    for joint in ("_", ""):
        run = joint.join(r.choice(plain, 40))
        clean, toxic, last = scorer.scores([run, joint.join([run[:203], "vilezork", run[203:]]), f"{run}{joint}vilezork"])
        assert clean < 0.5 < min(toxic, last), joint
    for n in (39, 40, 41, 46, 47, 74, 75, 200):
        whole = "".join(r.choice(list("abcdefghij"), n))
        parts = toxicity.words_of(whole.upper())
        assert {g for p in parts for g in toxicity.grams(p)} == {f"^{whole}$"[i : i + k] for k in toxicity.GRAMS for i in range(n + 3 - k)}


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_line_dedup(spark, empty, odd, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", broadcast)
    sites = [(400 + i, f"More\n全部都一样没有空格\nrow {i}", f"s{i}") for i in range(10)]
    common, near, rare = "This line is everywhere", "This one is nearly", "This one is rare"
    rows = [(i, f"own line number {i}\n{common}\n\nno {i}", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, f"{near}\nkept {i} and more", f"s{i}") for i in range(10)] + [(200 + i, f"{rare}\nrest {i} stays here", f"s{i}") for i in range(9)]
    rows += [(300, f"  THIS  line is EVERYWHERE \n{common}", "s1"), (301, None, "s1"), (302, "", None)]
    clashing = ["__flags", "__cut", "__left", "__row", "__gone"]
    df = spark.createDataFrame(rows + sites, "doc_id long, text string, source string").select("*", *[F.lit("keep").alias(c) for c in clashing])
    kept = line_dedup.without_boilerplate(df)
    assert kept.columns == [*df.columns, "lines_removed"] and kept.select(*clashing).distinct().collect() == [("keep",) * 5]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.without_boilerplate(df).collect()}
    assert got[0] == ("own line number 0\n\nno 0", 1)
    assert got[100] == ("kept 0 and more", 1) and got[200] == (f"{rare}\nrest 0 stays here", 0)
    assert got[400] == ("row 0", 2)
    exempt = {r["doc_id"]: r["lines_removed"] for r in line_dedup.without_boilerplate(df, min_words=3).collect()}
    assert exempt[400] == 0 and exempt[0] == 1
    assert got[300] == ("", 2) and got[301] == (None, 0) and got[302] == ("", 0)
    assert line_dedup.without_boilerplate(empty).columns == [*empty.columns, "lines_removed"]
    assert line_dedup.without_boilerplate(empty).count() == 0
    assert by_row(line_dedup.without_boilerplate(odd).filter("text is not null"), "doc_id", "text") == by_row(odd.filter("text is not null"), "doc_id", "text")


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(5000) < 0.8
    votes = np.full((5000, 4), quality.NONE)
    for k, (hit, wrong) in enumerate([(0.5, 0.01), (0.4, 0.005), (0.6, 0.01), (0.3, 0.02)]):
        bad = np.where(truth, r.random(5000) < wrong, r.random(5000) < hit)
        votes[:, k] = np.where(bad, quality.BAD, quality.GOOD)
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, rates = quality.label_model(patterns, n.astype(float))
    assert np.mean((posterior[which.ravel()] > 0.5) == truth) > 0.93
    assert abs(rates[0, 2, 0] - 0.6) < 0.15


def test_label_model_by_rows():
    """EM on rows one by one gives what EM on patterns and their counts gives."""
    r = np.random.default_rng(6)
    votes = r.choice([quality.BAD, quality.NONE, quality.GOOD], (300, 3), p=[0.1, 0.3, 0.6])
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    by_pattern, rates = quality.label_model(patterns, n.astype(float), 20)
    kinds = 3
    share = []
    for v in votes:
        bad = [x == quality.BAD for x in v]
        share.append([0.1, *[0.9 * b / sum(bad) for b in bad]] if any(bad) else [0.95, *[0.05 / kinds] * kinds])
    for _ in range(20):
        rate = {(c, k, o): (sum(s[c] for s, v in zip(share, votes) if v[k] == o) + 1 / 3) / (sum(s[c] for s in share) + 1) for c in range(4) for k in range(3) for o in (-1, 0, 1)}
        prior = [(sum(s[c] for s in share) + 1) / (len(votes) + 4) for c in range(4)]
        share = [[prior[c] * np.prod([rate[c, k, v[k]] for k in range(3)]) for c in range(4)] for v in votes]
        share = [[x / sum(s) for x in s] for s in share]
    assert np.allclose([s[0] for s in share], by_pattern[which.ravel()])
    assert rates.shape == (2, 3, 3) and np.allclose(rates.sum(2), 1)


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    rows = quality.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["good"] for r in rows if r["quality"] == 1]
    bad = [r["good"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4
    weights = quality.train(odd)
    got = {r["doc_id"]: r["score"] for r in quality.score(odd, weights, ["doc_id"]).collect()}
    assert got[0] == got[1] == got[3] == 0.0 and got[10] == got[12]
    assert quality.score(odd, weights, odd.columns, into="score_").columns == [*odd.columns, "score_"]
    assert quality.score(empty, quality.train(empty), ["doc_id"]).count() == 0


def test_quality_reads_runs_without_spaces_to_their_end():
    r = np.random.default_rng(4)
    start = "thelongrunstartswiththesewordsxy"
    assert len(start) == quality.PART
    prose = [start + "".join(r.choice(["sentence", "reader", "garden", "window"], 40)) for _ in range(40)]
    junk = [start + "".join(r.choice(list("#%&=+{}<>09"), 300)) for _ in range(40)]
    hashed = quality.Hashed()
    weights = quality.fit_linear([hashed.of(t) for t in prose[:30] + junk[:30]], np.repeat([1.0, 0.0], 30))
    value = lambda t: float(weights[hashed.of(t)[0]] @ hashed.of(t)[1])
    assert min(map(value, prose[30:])) > 0 > max(map(value, junk[30:]))
    assert "".join(quality.tokens(junk[0])) == junk[0] and quality.tokens(" a  bc ") == ["a", "bc"]


def brute_neighbours(rows, k):
    ok = {i: np.array(v, "f8") for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, x in ok.items():
        if q % 100 == 0:
            d = sorted((float(np.sqrt(np.square(v - x).sum())), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(d, 1)]
    return sorted(out)


@pytest.mark.parametrize("sample", [neighbours.SAMPLE_ROWS, 256])
def test_neighbours(spark, monkeypatch, sample):
    """One level of leaves and, with small samples, two; queries of a block in slices."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(neighbours, "SLICE_QUERIES", 4)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.3 * r.normal(size=16)).astype("f4").tolist()) for i in range(1500)]
    same = rows[100][1]
    rows += [(2000 + i, same) for i in range(300)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] + [1.0] * 15), (5300, [1.0] * 3), (5400, [None] + [1.0] * 15), (5500, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("vector", F.lit(1))
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    got = sorted((r["query_id"], r["rank"], r["id"], r["dist"]) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect())
    want = brute_neighbours(rows, 10)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.98 * len(want)
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6, rtol=0.2)
    few = df.filter("vec_id in (0, 1, 2)")
    assert neighbours.nearest(few, F.col("vec_id") % 100 == 0).count() == 2
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_one_row_of_an_id_asks_and_is_found(spark):
    """An id with several vectors takes part with the smallest of them."""
    df = spark.createDataFrame([(0, [1.0, 1.0]), (0, [0.5, 9.0]), (0, [0.5, 9.0]), (1, [0.5, 8.0]), (1, [0.6, 9.0]), (2, [1.0, 1.5]), (1, None)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [(q, n, i) for q, n, i, _ in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == 1.0


@pytest.mark.parametrize("n", [2000, 100_000])
def test_few_vectors_are_verified(n):
    """On vectors without structure, of 64 dimensions, half of the rows at most are verified, and recall stays above 0.9."""
    r = np.random.default_rng(n)
    rows = r.normal(size=(n, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    project, radius = neighbours.projection(64), neighbours.chi_square_radius()
    asked, hits, verified = np.arange(20) * (n // 20), 0, 0
    blocks = [neighbours.Block(np.arange(a, min(a + 4096, n)), rows[a : a + 4096], project) for a in range(0, n, 4096)]
    for q in asked:
        home = next(blocks[q // 4096].nearest(rows[[q]], np.array([np.inf]), 11, radius))
        bound, found = home[1][-1], []
        before = sum(b.verified for b in blocks)
        for b in blocks:
            found += zip(*next(b.nearest(rows[[q]], np.array([bound]), 11, radius)), strict=True)
        verified += sum(b.verified for b in blocks) - before
        got = [int(i) for i, d in sorted(found, key=lambda f: f[1])[:11] if i != q]
        true = np.argsort(np.square(rows - rows[q]).sum(1))[1:11]
        hits += len(set(got) & set(true.tolist()))
    assert hits >= 0.9 * 10 * len(asked) and verified <= 0.5 * n * len(asked)


def test_two_levels_find_what_one_search_finds():
    r = np.random.default_rng(8)
    rows, asked, bounds = r.normal(size=(4000, 8)), r.normal(size=(50, 8)), r.uniform(0.5, 9, 50)
    top = neighbours.Tree(rows, 8)
    at = top.leaf(rows)
    tree = neighbours.TwoLevels(top, [neighbours.Tree(rows[at == t], 4) for t in range(7)] + [neighbours.Tree(rows[:0], 4)])
    leaf = tree.leaf(rows)
    assert len(set(leaf.tolist())) == 29 == tree.first[-1] and len(set(zip(at.tolist(), leaf.tolist(), strict=True))) == 29
    low, high = np.array([rows[leaf == x].min(0) for x in range(29)]), np.array([rows[leaf == x].max(0) for x in range(29)])
    got = set(zip(*(c.tolist() for c in tree.within(asked, bounds, low, high)), strict=True))
    assert got == set(zip(*(c.tolist() for c in np.nonzero(neighbours.box_distance(asked, low, high) <= bounds[:, None])), strict=True))


def test_chi_square():
    x = neighbours.chi_square_radius(8, 0.05)
    assert abs(x - 15.507) < 0.01


def test_licences(spark, odd, empty):
    full = license_scan.TEMPLATES["mit-text"]
    rows = [(1, "Intro words here.\nReleased under the MIT License.\nend"), (2, full), (3, full.replace("Software", "Program")), (4, "nothing at all"), (5, None), (6, "this work is licensed under the gnu general public license version 3")]
    got = by_row(license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "unit", "license")
    assert {(1, 2, "mit"), (2, 1, "mit-text"), (6, 1, "gpl-3.0")} <= set(got) and not {i for i, *_ in got} & {4, 5}
    assert license_scan.matches(empty).count() == 0 and license_scan.matches(odd).count() == 0
    assert [r["doc_id"] for r in license_scan.best_license(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()][:2] == [1, 2]


def test_wrapped_licences(spark):
    """Notices over several lines of a longer text, against what is planted and against the SQL."""
    import textwrap

    import duckdb
    import pandas as pd

    full = "\n".join(f"# {x}" for x in textwrap.wrap(license_scan.TEMPLATES["mit-text"], 60))
    n = full.count("\n")
    other = "\n".join(f"line {i} tells of rivers and hills numbered {i * 7}" for i in range(60))
    mit = "Released under the MIT License."
    rows = [
        (1, f"head here\n\n{full}\n\n{other}"),
        (2, f"{other}\n\n---\n{full}\ntail text"),
        (3, full),
        (4, "x y\nThis work is licensed under the GNU General\nPublic License, version 3.\nmore words follow here"),
        (5, f"{other}\n{mit}\n{other}"),
        (6, "\n".join([mit] * 300)),
        (7, f"{other}\n{full}\n{full}\n{other}"),
        (8, None),
        (9, f"{other}\nReleased under\n\n...\nthe MIT License.\n{other}"),
        (9, f"{other}\nReleased under\n\n...\nthe MIT License.\n{other}"),
        (9, f"{mit}\n{other}"),
    ]
    found = license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["unit"], r["last_unit"], r["license"], round(r["dice"], 6)) for r in found.collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert got == sorted(con.execute(license_scan.OP9_SQL).fetchall())
    whole = [g[:4] for g in got if g[4] == 1.0]
    assert [g for g in whole if g[0] != 6] == [
        (1, 3, 3 + n, "mit-text"), (2, 63, 63 + n, "mit-text"), (3, 0, 0, "mit-text"), (4, 2, 3, "gpl-3.0"), (5, 61, 61, "mit"),
        (7, 61, 61 + n, "mit-text"), (7, 62 + n, 62 + 2 * n, "mit-text"), (9, 1, 1, "mit"), (9, 61, 64, "mit"), (9, 61, 64, "mit"),
    ]
    assert {g[0] for g in got} == {1, 2, 3, 4, 5, 6, 7, 9}
    # All lines and the whole text (one more bigram than the template), but no overlapping blocks.
    assert [g[1:3] for g in got if g[0] == 6] == [(i, i) for i in range(301)]


def plain_shingles(text):
    """Five-word shingles as tuples of words, without the operator's hashes."""
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(rows):
    sets = {}
    for i, text in sorted(r[:2] for r in rows):
        s = plain_shingles(text)
        sets.setdefault(s or i, (i, s))
    items = [v for v in sets.values() if v[1]]
    links, up = Counter(), {i: i for i, _ in sets.values()}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(items):
        for j, y in items[a + 1 :]:
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    return links, {i: top(i) for i in up}


def test_jaccard_join(spark, odd, empty, monkeypatch):
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [r.choice(words, 120).tolist() for _ in range(12)]
    for i in range(260):
        w = list(base[0] if i < 150 else base[i % 12])
        for at in r.integers(0, 120, i % 4):
            w[at] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(300, "one two"), (301, "One, two!"), (302, ""), (303, None), (304, rows[0][1])]
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)  # several blocks for the large group
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("side", F.lit(1)).withColumn("block", F.lit("x"))
    got = {r["doc_id"]: r for r in jaccard_join.near_classes(df).collect()}
    links, tops = brute_links(rows)
    for i in got:
        assert (got[i]["class_id"], got[i]["n_links"]) == (tops[got[i]["set_id"]], links[got[i]["set_id"]]), i
    assert got[301]["set_id"] == 300 and got[304]["set_id"] == got[0]["set_id"] and got[302]["class_id"] == 302 and got[303]["n_links"] == 0
    assert len(got) == len(rows) and max(links.values()) > 32
    assert jaccard_join.near_classes(empty).count() == 0
    assert jaccard_join.near_classes(odd).count() == odd.count()


def test_unlike_texts_do_not_chain(spark):
    """Each text shares half of its shingles with the next: bands link nearly all of them, pruned pairs few."""
    r = np.random.default_rng(4)
    part = r.integers(1, 1 << 63, (302, 40), dtype=np.uint64)
    sig = jaccard_join.signatures([np.unique(part[i : i + 3]) for i in range(300)])
    base = np.unique(r.integers(1, 1 << 63, 100, dtype=np.uint64))
    near = jaccard_join.signatures([base[n % 7 :] for n in range(40)])
    reps = spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(np.concatenate([sig, near]))], "doc_id long, signature binary")
    groups = Counter(r["component"] for r in jaccard_join.coarse_groups(reps).collect())
    assert groups[300] == 40 and max(n for c, n in groups.items() if c != 300) <= 6


def test_buckets_of_the_same_members_are_looked_at_once(spark):
    rows = [(b, d) for b in range(24) for d in (1, 2)] + [(30, 1), (30, 2), (30, 3), (31, 2), (31, 3), (32, 3), (33, 4)]
    kept = jaccard_join.distinct_buckets(spark.createDataFrame(rows, "band long, doc_id long")).collect()
    assert sorted((r["band"], r["m"]) for r in kept) == [(0, 2), (30, 3), (31, 2)]


def test_sketches_agree_where_signatures_do(spark):
    base = np.unique(np.random.default_rng(5).integers(1, 1 << 63, 200, dtype=np.uint64))
    sig = jaccard_join.signatures([base[n:] for n in range(0, 100, 10)])
    reps = spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(sig)], "doc_id long, signature binary")
    low = {r["doc_id"]: np.frombuffer(r["signature"], np.uint8) for r in jaccard_join.sketched(reps).collect()}
    assert len(low) == 10 and all(len(s) == jaccard_join.HASHES for s in low.values())
    assert all((low[i] == low[0])[sig[i] == sig[0]].all() for i in low)


def test_rows_that_a_join_wants_pass_the_filter(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 1000 > 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text_a"), F.xxhash64(F.lit(1), "id").alias("text_b"))
    wanted = rows.filter("text_a % 10 = 0")
    passed = rows.filter(jaccard_join.maybe_among(wanted))
    assert wanted.exceptAll(passed).isEmpty() and passed.count() < wanted.count() + 40
    assert rows.filter(jaccard_join.maybe_among(wanted.limit(0))).isEmpty()


def test_pruning_thresholds():
    least = jaccard_join.least_agreement()
    for n, a in least.items():
        assert jaccard_join._beta_tail(a, n, 0.8) >= jaccard_join.TOLERANCE > (jaccard_join._beta_tail(a - 1, n, 0.8) if a else 0)


def test_signatures_estimate_similarity():
    a = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64))
    s = jaccard_join.signatures([a, a[:3200]])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.13
    assert hashlib.sha256(s.tobytes()).hexdigest() == hashlib.sha256(jaccard_join.signatures([a, a[:3200]]).tobytes()).hexdigest()
