"""What ledgers cost on disk: no line is shuffled but by those who ask for it, and numbers don't depend on how files are split."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.plans import queries as core
from ledgerlight.sources import ledger

SF = "/root/testdata/sf0.001"


def shuffled(spark, df):
    """The columns that each shuffle of a plan writes."""
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.findall(r"(\w+)#", found)) for found in re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.M)]


def records(spark, n=3000):
    return spark.range(0, n, 1, 3).select(F.concat(F.lit("l "), (F.col("id") % 7).cast("string")).alias("ledger"), F.col("id").alias("o"), F.concat(F.lit('{"id":"t'), F.col("id").cast("string"), F.lit('","blocked":true}')).alias("json"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_reading_and_verifying_shuffle_no_lines(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    ledger.append(ledger.chained(records(spark, 20), "ledger", "o", "json"), path)
    raw = ledger.lines(spark, path)
    for df in (raw, ledger.integrity(raw), ledger.traces(ledger.read(spark, path)).agg(F.count_if("blocked"))):
        found = shuffled(spark, df)
        assert found and not any(columns & {"line", "value", "r"} for columns in found)


def test_gathered_records_are_shuffled_once(spark, tmp_path):
    """What records are made from is dealt out, not their JSON, with the same chain; plain and compressed files hold the same."""
    made = records(spark)
    want = rows(ledger.chained(made, "ledger", "o", "json"))
    dealt = ledger.gathered(made.select("ledger", "o"), "ledger", "o")
    again = dealt.select("*", F.concat(F.lit('{"id":"t'), F.col("o").cast("string"), F.lit('","blocked":true}')).alias("json"))
    chain = ledger.chained(again, "ledger", "o", "json", gathered=True)
    assert shuffled(spark, chain) == [{"ledger", "o"}]
    assert rows(chain) == want
    with pytest.raises(ValueError):
        ledger.chained(again, "ledger", "o", "json", spark.createDataFrame([], "ledger string, prev_hash string, seq bigint"), gathered=True)
    for compression in (None, "gzip"):
        path = f"file://{tmp_path}/{compression}"
        ledger.append(chain, path, gathered=True, compression=compression)
        assert len(list((tmp_path / str(compression)).rglob("part-*.gz"))) == (7 if compression else 0) and len(list((tmp_path / str(compression)).rglob("part-*"))) == 7
        assert rows(ledger.lines(spark, path).select("ledger", "line_no", "line")) == sorted((k, seq, line) for k, seq, _, _, line in want)
        state = ledger.chain_state(ledger.lines(spark, path))
        ledger.append(ledger.chained(records(spark, 70), "ledger", "o", "json", state), path, compression=compression)
        assert rows(ledger.integrity(ledger.lines(spark, path)).select("total_records", "intact")) == sorted((3000 // 7 + (i < 3000 % 7) + 10, True) for i in range(7))


@pytest.mark.parametrize("size", ["2000", "128m"])
def test_numbers_however_files_are_split(spark, tmp_path, size):
    """Several appends, a file that many tasks read, and blank lines between."""
    path = f"file://{tmp_path}/x"
    for i in range(3):
        part = records(spark, 600).filter(F.floor(F.col("o") / 200) == i)
        ledger.append(ledger.chained(part, "ledger", "o", "json", ledger.chain_state(ledger.lines(spark, path))), path)
    for f in (tmp_path / "x").rglob("part-*"):
        f.write_text(f.read_text().replace("\n", "\n\n", 3))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    set_to = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    for name, value in set_to.items():
        spark.conf.set(name, value)
    try:
        got = ledger.lines(spark, path).select("ledger", "line_no", F.get_json_object("line", "$.seq").cast("bigint").alias("seq"), F.get_json_object("line", "$.id").alias("id")).collect()
        within = ledger.numbered(spark, path).groupBy("ledger", "commit").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
        good = ledger.integrity(ledger.lines(spark, path)).collect()
    finally:
        for name in set_to:
            spark.conf.unset(name)
    assert sorted((r["ledger"], r["line_no"], r["id"]) for r in got) == sorted((f"l {k}", i, f"t{o}") for k in range(7) for i, o in enumerate(range(k, 600, 7)))
    assert all(r["line_no"] == r["seq"] for r in got)
    assert len(within) == 21 and all(r["n"] == list(range(len(r["n"]))) for r in within)
    assert len(good) == 7 and all(r["intact"] for r in good)


def test_roundtrip_is_on_disk_once(spark, tmp_path, monkeypatch):
    """The ledger is written compressed, and what is read back of it shuffles links alone."""
    monkeypatch.setattr(core, "shared_folder", lambda _: f"file://{tmp_path}")
    df = core.ledger_roundtrip(spark, SF)
    assert not any(columns & {"line", "value", "r"} for columns in shuffled(spark, df))
    assert df.first()["total_records"] == spark.read.parquet(f"{SF}/orders.parquet").count()
    files = list(tmp_path.rglob("part-*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files)
