"""Session helpers: shared scratch space, durable lineage cuts, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    A private temporary folder is used only by a local session that names none (tests); on a cluster its executors
    could not read it, so there the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    active = sc.getCheckpointDir()
    if named:
        if active is None:
            sc.setCheckpointDir(named)
        return named
    if active is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        active = sc.getCheckpointDir()
    return active


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that lost executors cannot change its rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows from a table written in the shared folder: compressed and read by column, unlike a checkpoint."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session setting for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value).lower() if isinstance(value, bool) else str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a job are removed when it has ended; else they stay until the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether at most `max_rows` rows exist; counting stops one row beyond.

    Meant for inputs that are cheap to read, such as a table of queries. Sizes that follow from
    it (k hits per query) need no probe of their own.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def small(df: DataFrame, known: bool) -> DataFrame:
    """Hint a broadcast where the size is known to be bounded; otherwise leave it to Spark."""
    return F.broadcast(df) if known else df


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores if it has fewer tasks than cores, as one small file does.

    Large inputs have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast after counting. A larger side keeps no hint and is joined by shuffle."""
    return small(df, fits(df, max_rows))


# -- folders -----------------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    """A Hadoop path and the file system that owns it, whatever storage the cluster uses."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of its file system."""
    target, fs = _hadoop(spark, path)
    return fs.makeQualified(target).toString()


def remove_dirs(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        target, fs = _hadoop(spark, p)
        fs.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, hidden ones left out; empty if it does not exist."""
    target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(target))
    return sorted(n for n in names if not n.startswith((".", "_")))


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop(spark, path)
    return fs.exists(target)


def is_dir(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def make_dir(spark: SparkSession, path: str) -> None:
    target, fs = _hadoop(spark, path)
    fs.mkdirs(target)


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; fails if it exists, so that two writers cannot both succeed."""
    target, fs = _hadoop(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """Content of a small file."""
    target, fs = _hadoop(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
