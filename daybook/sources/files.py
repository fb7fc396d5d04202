"""Archive directories as tables, and tables written back as an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.keys import basename, capture_key, parse_capture_key
from daybook.functions.text import normalise_newlines
from daybook.operators.captures import first_per_key
from daybook.sources.raw import read_files


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Path, modification time and size. The content column is pruned, so no bytes are read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """PNG frames with the key columns of their names and a hash of their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    key = parse_capture_key(F.col("path"))
    return files.select(
        "path",
        key["window_id"].alias("window_id"),
        key["ts"].alias("ts"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("frame_hash"),
    )


def split_valid_utf8(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows whose bytes are UTF-8, and the rejects with a reason (they stay pending)."""
    ok = F.is_valid_utf8(F.col(content).cast("string"))
    return files.filter(ok), files.filter(~ok).withColumn("reason", F.lit("undecodable"))


def read_texts_and_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decodable *.txt files directly below `path` as DOCS rows, newlines normalised; and (path, mtime, size, reason) of the others."""
    files = read_files(spark, path, "*.txt")
    good, bad = split_valid_utf8(files)
    key = parse_capture_key(F.col("path"))
    texts = good.select(
        "path",
        key["window_id"].alias("window_id"),
        key["ts"].alias("ts"),
        normalise_newlines(F.col("content").cast("string")).alias("text"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    )
    return texts, bad.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "reason")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Every decodable *.txt directly below `path`; `read_texts_and_rejects` also gives the rest."""
    return read_texts_and_rejects(spark, path)[0]


def texts_to_write(captures: DataFrame) -> DataFrame:
    """One DOCS row per capture key (window and second); the first text of a second stays."""
    first = first_per_key(captures)
    return first.select(
        capture_key(F.col("window_id"), F.col("ts")).alias("path"),
        "window_id",
        F.timestamp_seconds(F.unix_seconds("ts")).alias("ts"),
        "text",
        F.timestamp_seconds(F.unix_seconds("ts")).alias("mtime"),
        F.octet_length("text").cast("long").alias("size"),
    )


def write_texts(captures: DataFrame, path: str) -> None:
    """Persist extracted texts below their capture day."""
    rows = texts_to_write(captures).withColumn("day", F.to_date("ts"))
    rows.write.mode("append").partitionBy("day").option("compression", "zstd").parquet(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of paths as (id, path); anything but an array of strings gives no rows."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    return whole.select(F.posexplode(items).alias("id", "path")).select(F.col("id").cast("long").alias("id"), "path")


def relative_names(df: DataFrame) -> DataFrame:
    """Replace full paths by file names, the key form used inside the archive."""
    return df.withColumn("path", basename(F.col("path")))
