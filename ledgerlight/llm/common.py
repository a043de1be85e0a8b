"""Small helpers that the operators share: the shared scratch folder, text access in tasks, word caches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a task handles at once inside an Arrow batch, and bytes of text beyond which it takes fewer rows.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20
#: Rows of an Arrow batch where a query is run here: a few slices. Spark's default is 10,000, some 31 MB of documents.
BATCH_ROWS = 1024
#: Bytes of one of a worker's caches, by reckoning, before its older half goes; an entry's own besides key and value.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 150
#: White space that every tokenizer here treats as a boundary.
ASCII_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")

_local_scratch: dict[str, str] = {}
_held: dict[str, object] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local[*] session (as in tests) may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return _local_scratch.setdefault(app, "file://" + tempfile.mkdtemp(prefix="ledgerlight-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/ledgerlight-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here send workers ``BATCH_ROWS`` rows at once at most; the session's own limit holds again afterwards.

    A batch stands in the executor, outside its heap, and in the worker as a whole, and kernels take slices of it anyway.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, min(int(own), BATCH_ROWS) if int(own) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application left in the shared folder, once its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/ledgerlight-llm/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` has it: what we add never meets a column of the input."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: SLICE_ROWS rows at most, and SLICE_BYTES of column number ``text`` or a single row."""
    ends = np.cumsum(pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        stop = min(max(stop, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


class TwoGenerations(dict):
    """A cache bounded by bytes: when the young half is full it becomes the old one. ``make(key)`` gives missing values."""

    def __init__(self, make, limit: int = CACHE_BYTES):
        super().__init__()
        self.make, self.limit, self.old, self.bytes = make, limit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.bytes += ENTRY_BYTES + len(key) + (len(value) if isinstance(value, bytes) else 32)
        return value

    def turn(self) -> None:
        """Call between slices."""
        if self.bytes > self.limit:
            self.old, self.bytes = dict(self), 0
            self.clear()


def held(key: str, make: Callable[[], object]):
    """A worker process's one object that lives on from task to task, such as a tokenizer with its cache; another takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Hand freed memory back to the system; without it the peaks of a long-lived worker's operators add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(kernel: Callable, holds: bool = False) -> Callable:
    """``kernel`` for mapInArrow, memory given back after each batch; what other kernels hold goes unless this one ``holds``."""

    def run(batches):
        if not holds and _held:
            _held.clear()
            give_back()

        def one_by_one():
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from kernel(one_by_one())
        give_back()

    return run
