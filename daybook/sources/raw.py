"""Rows as single files, the raw form in which an archive directory arrives: written, and read again without a list of them on the driver."""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from daybook.runtime import is_dir, qualified, stored

#: Names that a task hands on at a time, files that a task reads, about, and bytes of them that it holds, or one file.
NAMES, TASK_FILES, HELD_BYTES = 10_000, 4096, 16 << 20
#: Schemes that Arrow opens; folders elsewhere are read by Spark alone.
OPENED = ("file", "hdfs", "s3", "s3a", "s3n", "gs")
CONTENTS = "path string, modificationTime timestamp, length long, content binary"


def arrow_uri(spark: SparkSession, path: str) -> str:
    """The path as Spark itself resolves it (a path without a scheme lies in the default file system), in Arrow's spelling."""
    scheme, _, rest = qualified(spark, path).partition(":")
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest.removeprefix('//')}"


def write_files(rows: DataFrame, path: str) -> None:
    """One file per row of (name, content); tasks write on their own, the driver sees no content."""
    uri = arrow_uri(rows.sparkSession, path)

    def save(part: Iterator) -> None:
        target, base = fs.FileSystem.from_uri(uri)
        target.create_dir(base, recursive=True)
        for row in part:
            with target.open_output_stream(f"{base}/{row['name']}") as out:
                out.write(bytes(row["content"]))

    rows.select("name", "content").foreachPartition(save)


def _names(uri: str, pattern: str) -> Iterator[str]:
    """Names of the files directly below a folder, without those that Spark takes for hidden."""
    target, base = fs.FileSystem.from_uri(uri)
    if isinstance(target, fs.LocalFileSystem):
        found = (entry.name for entry in os.scandir(base) if entry.is_file())
    else:
        found = (i.base_name for i in target.get_file_info(fs.FileSelector(base)) if i.is_file)
    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return (name for name in found if fnmatchcase(name, pattern) and not hidden(name))


def _listed(uri: str, pattern: str):
    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for name in _names(uri, pattern):
            names.append(name)
            if len(names) == NAMES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])
                names = []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return run


def _opened(uri: str, folder: str):
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(uri)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "modificationTime", "length", "content"])
        for batch in batches:
            rows, held = [], 0
            for name in batch.column(0).to_pylist():
                with target.open_input_file(f"{base}/{name}") as file:
                    content = file.read()
                # Spark knows the time of a file in milliseconds.
                at = target.get_file_info(f"{base}/{name}").mtime_ns // 1_000_000 * 1000
                rows.append((f"{folder}/{name}", at, len(content), content))
                held += len(content)
                if held >= HELD_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return run


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, time, length and content of the files directly below a folder, in the columns of Spark's binary files.

    Spark keeps the status of every file on the driver and plans a task for each few dozen of them. Here a task lists the folder into a table
    of names, and tasks that have some thousands of names open the files; the driver sees neither. Globs, and folders in a store that
    only Spark opens, are read by Spark.
    """
    folder = qualified(spark, path)
    if folder.partition(":")[0] not in OPENED or not is_dir(spark, path):
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    uri = arrow_uri(spark, path)
    names = stored(spark.range(0, 1, 1, 1).mapInArrow(_listed(uri, pattern), "name string"), "names")
    n = names.count()
    tasks = max(1, -(-n // TASK_FILES), min(n, spark.sparkContext.defaultParallelism))
    return names.repartition(tasks).mapInArrow(_opened(uri, folder.rstrip("/")), CONTENTS)
