"""Arrow column functions: a plain function of a list of values becomes a column expression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

#: Characters of text that are handed to a function at once; longer texts come alone.
SLICE_CHARS = 4_000_000


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that is not among the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of a table by name, as they stand."""
    return [F.col(f"`{c}`") for c in df.columns]


def identity(column: str) -> Column:
    """A value as text that is never null, so that rows can be joined and grouped on it alike; null is told from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("null"))


def slices(texts: pa.Array) -> Iterator[list]:
    """Values of an Arrow batch in runs of bounded length, so that Python objects stay few at a time."""
    run, size = [], 0
    for value in texts:
        text = value.as_py()
        run.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS or len(run) >= 2000:
            yield run
            run, size = [], 0
    if run:
        yield run


def struct_column(make: Callable[[], Callable[[list], list[tuple]]], ddl: str) -> Callable:
    """A column function: `make()` runs once per task and returns a function from texts to tuples of `ddl`'s fields.

    Marked as non-deterministic only so that Spark evaluates it once, however often its fields are used.
    """
    schema: StructType = _parse_datatype_string(ddl)
    kind = to_arrow_type(schema)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [f.name for f in kind]
        work = make()
        for texts in batches:
            columns = [[] for _ in names]
            for part in slices(texts):
                for row in work(part):
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()
