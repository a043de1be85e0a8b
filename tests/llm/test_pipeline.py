"""Every stage works on what its predecessor kept, and its decisions take effect."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from ledgerlight.llm import common, jaccard_join, packing, quality, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        kept[name], before = {r["doc_id"] for r in after.select("doc_id").collect()}, after
    all_ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept["quality"] <= kept["toxicity"] <= all_ids and kept["line_dedup"] == kept["quality"] and kept["jaccard_join"] <= kept["line_dedup"]
    good = labels[(labels.toxic == 0) & (labels.quality == 1)].index
    assert len(kept["quality"] & set(good)) > 0.95 * len(set(good) & all_ids)
    toxic = set(labels[labels.toxic == 1].index) & all_ids
    assert len(toxic & kept["toxicity"]) < 0.4 * len(toxic)
    left = {r["doc_id"]: r["class_id"] for r in jaccard_join.near_classes(before).collect()}
    assert all(i == c for i, c in left.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in pieces} == kept["jaccard_join"]
    assert sum(r["length"] for r in pieces) / 2048 <= len({r["sequence_id"] for r in pieces}) <= sum(r["length"] for r in pieces) / 2048 * 1.05 + 1
    assert packing and quality and toxicity and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_input(spark):
    """Nulls, empty and long texts, repeated rows, columns with our names, and an empty table."""
    good = " ".join(f"The {w} of the old house was painted, and everyone in the village came to look at it." for w in ("door", "roof", "wall", "gate"))
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good + " Then they went home."), (4, "word " * 30_000), (5, None), (None, None)]
    own = ["score", "score_", "__text", "lines_removed", "__cut", "__flags", "__doc", "text_a", "order"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("keep").alias(c) for c in own])
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        found = after.collect()
        assert {tuple(r[c] for c in own) for r in found} <= {("keep",) * len(own)}, name
        left[name] = sorted(((r["doc_id"], r["text"]) for r in found), key=str)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    everything = sorted(rows, key=str)
    assert left["toxicity"] == everything and left["line_dedup"] == everything
    assert not {2, 3, 5} & {i for i, _ in left["quality"]}
    assert left["jaccard_join"] == sorted([*rows[1:4], rows[5], rows[6], rows[7]], key=str)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.filter("doc_id = 1").count() == 2 and pieces.filter("doc_id = 4").count() == 15
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_one_row_of_each_class(spark):
    words = [f"w{i}" for i in range(80)]
    a, near, b, c, d = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[::-1]), " ".join(words[::2]), " ".join(words[1::2])
    rows = [(1, a), (1, a), (2, near), (2, b), (None, c), (None, c), (None, d), (7, d), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.one_of_each(spark, docs, SF)
    assert left.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key) == sorted([(1, a), (2, b), (None, c), (7, d), (8, ""), (9, None)], key=key)
    found = [tuple(r) for r in jaccard_join.near_classes(docs.filter("doc_id <= 2")).collect()]
    assert sorted(found) == [(1, 1, 1, 2, 1), (1, 1, 1, 2, 1), (2, 1, 2, 1, 1), (2, 2, 2, 1, 0)]


def test_batches_sent_to_workers_are_small(spark):
    """What a stage writes goes through workers in batches of bounded rows; the session's own limit stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    got = common.materialise(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n bigint"), "sizes").collect()
    assert sum(r["n"] for r in got) == 5000 and max(r["n"] for r in got) <= common.BATCH_ROWS
    assert spark.conf.get(key) == own
