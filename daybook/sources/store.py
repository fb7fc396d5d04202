"""Archive tables in a folder: Parquet directories plus one small file per commit.

A version of a table is a directory; the newest commit of the table names it. Appends go to
`<version>/batch=<id>` and overwrite only that directory, so a retried batch cannot duplicate
rows. Resets and imports point to a new directory and leave the old one as the backup.
Retention commits move a cutoff that readers apply as a partition filter. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.runtime import create_text, durable, exists, make_dir, names_in, read_text, remove_dirs
from daybook.schemas import STORE_TABLES, stored
from daybook.sources import counts as C

LOG_SCHEMA = "table string, version long, location string, op string, cutoff timestamp, committed_at timestamp"


@dataclass(frozen=True)
class Commit:
    table: str
    version: int
    location: str
    op: str
    cutoff: str | None
    committed_at: str

    @property
    def cutoff_at(self) -> dt.datetime | None:
        return dt.datetime.fromisoformat(self.cutoff) if self.cutoff else None


class ArchiveStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- commits ---------------------------------------------------------------------------

    def history(self, table: str) -> DataFrame:
        """All commits of a table."""
        log = f"{self.root}/{table}/commits"
        if not names_in(self.spark, log):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).json(log)

    def head(self, table: str) -> Commit | None:
        """The newest commit of a table; a folder listing, not a Spark job."""
        log = f"{self.root}/{table}/commits"
        names = names_in(self.spark, log)
        return Commit(**json.loads(read_text(self.spark, f"{log}/{names[-1]}"))) if names else None

    def _commit(self, table: str, location: str, op: str, cutoff: dt.datetime | None = None) -> Commit:
        head = self.head(table)
        now = dt.datetime.now(dt.timezone.utc)
        commit = Commit(
            table,
            head.version + 1 if head else 1,
            location,
            op,
            cutoff.isoformat() if cutoff else None,
            now.isoformat(),
        )
        create_text(self.spark, f"{self.root}/{table}/commits/{commit.version:012d}.json", json.dumps(asdict(commit)))
        return commit

    def _fresh(self, table: str) -> str:
        return f"{self.root}/{table}/{uuid.uuid4().hex}"

    def location(self, table: str) -> str:
        """The folder of a table's present version; a table without one gets an empty one."""
        head = self.head(table)
        if head is None:
            head = self._commit(table, self._fresh(table), "create")
            make_dir(self.spark, head.location)
        return head.location

    # -- reads -----------------------------------------------------------------------------

    def read(self, table: str, without_batch: int | None = None) -> DataFrame:
        """Current rows with their batch; empty with the declared columns if there are none.

        `without_batch` hides one batch, which is what its retry has to see: other writers may have come after it.
        """
        schema = stored(table)
        head = self.head(table)
        df = None
        if head is not None and names_in(self.spark, head.location):
            df = self.spark.read.schema(schema).parquet(head.location)
            if head.cutoff is not None:
                cutoff = F.lit(head.cutoff_at).cast("timestamp")
                df = df.filter((F.col("day") >= F.to_date(cutoff)) & (F.col("mtime") >= cutoff))
        if df is None:
            df = self.spark.createDataFrame([], schema)
        return df if without_batch is None else df.filter(F.col("batch") != without_batch)

    def counts(self, table: str, above: dt.datetime | None = None) -> C.Counts:
        """Rows, bytes and instants of a table from the counters of its batches; with `above`, of the rows newer than it.

        Only batches without counters, and those that `above` cuts, are read. A table with a cutoff is counted whole, as rows of a batch may be hidden.
        """
        head = self.head(table)
        if head is None:
            return C.Counts()
        limit = None if above is None else round((above - dt.datetime.fromtimestamp(0, dt.timezone.utc)) / dt.timedelta(microseconds=1))
        total, unread = C.Counts(), []
        for name in names_in(self.spark, head.location):
            known = None if head.cutoff else C.kept(self.spark, f"{head.location}/{name}")
            if known is None or (limit is not None and None not in (known.oldest, known.newest) and known.oldest <= limit < known.newest):
                unread.append(int(name.removeprefix("batch=")))
            elif limit is None or (known.newest is not None and known.newest > limit):
                total += known
        if unread:
            rows = self.read(table).filter(F.col("batch").isin(unread))
            if above is not None:
                at = "indexed_at" if "indexed_at" in rows.columns else "mtime"
                rows = rows.filter(F.col(at) > F.lit(above))
            total += C.counted(rows)
        return total

    def next_batch(self, table: str) -> int:
        """The number after the newest batch of the table and after every reserved number."""
        head = self.head(table)
        names = names_in(self.spark, head.location) if head else []
        used = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        return max([*used, *self._reserved().values()], default=-1) + 1

    def reserve(self, owner: str, step: int) -> int:
        """A batch number for one step of a writer, the same whenever the step is repeated.

        The number lies after all batches of all tables and all other reserved ones, so a stream's micro-batches never meet the
        batches of cycles. One empty file per reservation keeps it.
        """
        key = f"{owner}-{step}"
        known = self._reserved()
        if key not in known:
            known[key] = max(self.next_batch(t) for t in STORE_TABLES)
            create_text(self.spark, f"{self.root}/reserved/{known[key]:012d}.{key}", "")
        return known[key]

    def _reserved(self) -> dict[str, int]:
        names = names_in(self.spark, f"{self.root}/reserved")
        return {key: int(number) for number, _, key in (n.partition(".") for n in names)}

    def has_batch(self, table: str, batch: int) -> bool:
        """Whether a batch has been written to its end."""
        head = self.head(table)
        return head is not None and exists(self.spark, f"{head.location}/batch={batch}/_SUCCESS")

    # -- writes ----------------------------------------------------------------------------

    def append(self, table: str, df: DataFrame, batch: int) -> None:
        """Write one batch with its counters; writing the same batch again replaces it."""
        self.append_parts(table, [df], batch)

    def append_parts(self, table: str, parts: Iterable[DataFrame], batch: int) -> None:
        """Write one batch part after part; the first replaces what is there, the counters come last."""
        head = self.head(table) or self._commit(table, self._fresh(table), "create")
        location, total = f"{head.location}/batch={batch}", C.Counts()
        for i, part in enumerate(parts):
            rows, seen = C.observed(part)
            self._write(table, rows, location, "append" if i else "overwrite")
            total += C.Counts.of(seen.get)
        C.keep(self.spark, location, total)

    def replace(self, table: str, df: DataFrame, op: str = "replace") -> None:
        """A new version of the table; the old directory stays as the backup."""
        location = self._fresh(table)
        _, levels = STORE_TABLES[table]
        rows = df.select(stored(table).fieldNames())
        rows.write.mode("overwrite").partitionBy("batch", *levels).option("compression", "zstd").parquet(location)
        self._commit(table, location, op)

    def reset(self, table: str) -> None:
        """An empty version; no-op where the table never existed."""
        if self.head(table) is not None:
            self._commit(table, self._fresh(table), "reset")

    def retain(self, table: str, cutoff: dt.datetime) -> None:
        """Hide rows older than the cutoff. Readers prune whole days; `vacuum` frees the disk."""
        head = self.head(table)
        if head is not None:
            self._commit(table, head.location, "retain", cutoff)

    def rewrite_batches(self, table: str, batches: list[int], kept: DataFrame) -> None:
        """Replace the given batches by their kept rows and touch no other directory.

        One job writes all of them; batches without a kept row are removed.
        """
        schema, levels = STORE_TABLES[table]
        if levels:
            raise ValueError(f"{table} has directory levels below its batches")
        head = self.head(table)
        kept = durable(kept.select(*schema.fieldNames(), "batch"))
        left = {r.batch for r in kept.select("batch").distinct().collect()}
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd"
        ).partitionBy("batch").parquet(head.location)
        remove_dirs(self.spark, [f"{head.location}/batch={b}" for b in batches if b not in left])

    def vacuum(self, table: str) -> int:
        """Remove day directories that lie wholly before the cutoff, in any time zone; returns how many."""
        head = self.head(table)
        if head is None or head.cutoff is None:
            return 0
        first_kept = (head.cutoff_at - dt.timedelta(days=1)).date().isoformat()
        gone = [
            f"{head.location}/{batch}/{day}"
            for batch in names_in(self.spark, head.location)
            for day in names_in(self.spark, f"{head.location}/{batch}")
            if day.removeprefix("day=") < first_kept
        ]
        remove_dirs(self.spark, gone)
        return len(gone)

    def _write(self, table: str, df: DataFrame, location: str, mode: str = "overwrite") -> None:
        schema, levels = STORE_TABLES[table]
        rows = df.select(*schema.fieldNames(), *levels)
        writer = rows.write.mode(mode).option("compression", "zstd")
        (writer.partitionBy(*levels) if levels else writer).parquet(location)
