"""Log files as a table: `YYYY-MM-DD HH:MM:SS,mmm - logger - LEVEL - message`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the layout of one log record.
RECORD = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (.*?) - ([A-Z]+) - (.*)$"


def parse_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ts, logger, level and message. Continuation lines keep NULLs in the four columns."""
    part = lambda i: F.when(F.col(line).rlike(RECORD), F.regexp_extract(line, RECORD, i))
    ts = F.try_to_timestamp(F.concat(part(1), F.lit("."), part(2)), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return lines.select(
        "*", ts.alias("ts"), part(3).alias("logger"), part(4).alias("level"), part(5).alias("message")
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) in file order, rotated files in name order, without a global sort.

    Each split counts its own lines; a prefix sum over the splits (one row each) turns the
    position inside a split into a line number.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return raw.join(starts, ["file", "block"]).select(
        (F.col("start") + F.col("at") - F.col("first_at")).alias("line_no"), "line"
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(read_log_lines(spark, path))
