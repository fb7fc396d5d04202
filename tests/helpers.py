"""Small frames from seconds after a fixed start."""

import datetime as dt
import io
from contextlib import redirect_stdout

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def utc(seconds):
    return at(seconds).replace(tzinfo=dt.timezone.utc)


def captures(spark, rows):
    """(window, seconds, seq, hash[, title]) rows; the session is the window."""
    data = [(r[0], r[0], at(r[1]), r[2], r[4] if len(r) > 4 else "t", r[3]) for r in rows]
    return spark.createDataFrame(
        data, "window_id string, session string, ts timestamp, seq long, title string, frame_hash string"
    )


def states(spark, rows):
    """(session, seconds, seq, kind, active) rows."""
    data = [(s, at(t), n, k, a) for s, t, n, k, a in rows]
    return spark.createDataFrame(data, "session string, ts timestamp, seq long, kind string, active boolean")


def docs(spark, rows):
    """(path, text[, mtime seconds]) rows."""
    data = [
        (r[0], "w", at(r[2] if len(r) > 2 else 0), r[1], at(r[2] if len(r) > 2 else 0), len((r[1] or "").encode()))
        for r in rows
    ]
    return spark.createDataFrame(
        data, "path string, window_id string, ts timestamp, text string, mtime timestamp, size long"
    )


def values(df, *cols):
    """Sorted tuples of the given columns (plain values for one column)."""
    rows = [tuple(r) for r in df.select(*cols).collect()]
    return sorted(r[0] if len(cols) == 1 else r for r in rows)


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
