"""State signals and process samples that some collector already stores as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.schemas import PROC_SAMPLES, STATES


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_states(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _typed(spark.read.format(fmt).load(path), STATES)


def read_proc_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _typed(spark.read.format(fmt).load(path), PROC_SAMPLES)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A folder that receives Parquet files, as a stream with a bounded micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
