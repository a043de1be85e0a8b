"""Where intermediate results go: a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, as in tests, may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerlight-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table whose rows lie in fewer parts than there are cores, dealt out by ``keys``; larger tables as they are.

    File splits don't tell: a file of one row group is read by one task, however many splits it has. So if splits are few
    the rows of each are counted, which reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(3 * cores, *keys)


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path of ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a path or glob names, if any."""
    system, place = _at(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in system.globStatus(place) or [])


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a path or glob names. A plain path may name nothing; a pattern that does raises."""
    found = listed(spark, pattern)
    if not found and re.search(r"[*?\[{]", pattern):
        raise FileNotFoundError(f"nothing matches {pattern}")
    return found


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content, or not at all; false if the path is taken already."""
    system, place = _at(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":  # a link fails if its name is there; a local rename might not
            paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (place, draft)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.NONE
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            files.rename(system.makeQualified(draft), system.makeQualified(place), options)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        system.delete(draft, False)
    return True
