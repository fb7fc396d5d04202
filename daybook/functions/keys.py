"""Capture keys, file names, window titles and list parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: {window id}_{epoch seconds}.{kind}; the first group is greedy.
CAPTURE_KEY = r"([^/]+)_(\d+)\.(txt|png)$"


def parse_capture_key(path: Column) -> dict[str, Column]:
    """Columns window_id, ts and kind of a capture path; NULL where it is no capture key."""
    part = lambda i: F.nullif(F.regexp_extract(path, CAPTURE_KEY, i), F.lit(""))
    return {
        "window_id": part(1),
        "ts": F.timestamp_seconds(part(2).try_cast("bigint")),
        "kind": part(3),
    }


def capture_key(window_id: Column, ts: Column, kind: str = "txt") -> Column:
    """The file name of a capture: whole seconds, so one name per window and second."""
    return F.concat(window_id, F.lit("_"), F.unix_seconds(ts).cast("string"), F.lit(f".{kind}"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def of_type(path: Column, kind: str) -> Column:
    """Extension test; "*" selects every file."""
    return F.lit(True) if kind == "*" else path.endswith(f".{kind}")


def split_list(text: Column) -> Column:
    """Comma-separated list: parts trimmed, blank parts dropped."""
    parts = F.transform(F.split(text, ","), lambda x: F.btrim(x, F.lit(" \t\n\r\v\f")))
    return F.filter(parts, lambda x: x != "")


def before_first_comma(line: Column) -> Column:
    return F.btrim(F.substring_index(line, ",", 1))


def title_of(raw: Column) -> Column:
    """Title from a `NAME = "title"` property line: the part between the first two ` = `."""
    return F.btrim(F.nullif(F.split_part(raw, F.lit(" = "), F.lit(2)), F.lit("")), F.lit('"'))


def exclusion_terms(terms: str | list[str]) -> list[str]:
    """Exclusion parameter to clean terms: quotes stripped, lower-cased, blanks dropped."""
    parts = terms.strip().strip("\"'").split(",") if isinstance(terms, str) else terms
    return [t for t in (p.strip().strip("\"'").strip().lower() for p in parts) if t]
