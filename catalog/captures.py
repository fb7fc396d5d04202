"""Capture filters, states and throttling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import register
from daybook.functions import keys as K
from daybook.operators import captures as C
from daybook.operators import states as S
from daybook.operators.throttle import throttle

GAPPY = """gappy AS (SELECT * REPLACE (CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 11 = 1 THEN '' ELSE title END AS title,
  CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 13 = 1 THEN '' ELSE window_id END AS window_id) FROM captures)"""


def _gappy(spark, sf):
    n = F.col("seq")
    return (
        X.captures(spark, sf)
        .withColumn("title", F.when(n % 11 == 0, None).when(n % 11 == 1, F.lit("")).otherwise(F.col("title")))
        .withColumn("window_id", F.when(n % 13 == 0, None).when(n % 13 == 1, F.lit("")).otherwise(F.col("window_id")))
    )


@register("with_window", f"WITH {X.CAPTURES}, {GAPPY} SELECT seq FROM gappy WHERE length(window_id) > 0 AND length(title) > 0")
def _(spark, sf):
    return C.with_window(_gappy(spark, sf)).select("seq")


@register(
    "exclude_titles",
    f"WITH {X.CAPTURES} SELECT seq, title FROM captures WHERE NOT (contains(lower(title), 'sign') OR contains(lower(title), 'err'))",
)
def _(spark, sf):
    return C.exclude_titles(X.captures(spark, sf), '"SIGN, err, ,"').select("seq", "title")


FIRST = """firsts AS (SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY window_id, floor(epoch(ts)) ORDER BY ts, seq) = 1)"""
# One second holds an hour here, so that seconds are shared.
COARSE = "captures AS (SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM raw_captures)"
RAW = X.CAPTURES.replace("captures AS", "raw_captures AS", 1)


def _coarse(spark, sf):
    return X.captures(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))


@register("first_per_key", f"WITH {RAW}, {COARSE}, {FIRST} SELECT seq, window_id FROM firsts")
def _(spark, sf):
    return C.first_per_key(_coarse(spark, sf)).select("seq", "window_id")


UNCHANGED = f"""WITH {X.CAPTURES}, {FIRST}, seen AS (SELECT *, lag(frame_hash) OVER w AS prev,
  row_number() OVER w AS n FROM firsts WINDOW w AS (PARTITION BY window_id ORDER BY ts, seq))
SELECT seq, window_id FROM seen WHERE n = 1 OR frame_hash IS DISTINCT FROM prev"""


@register("drop_unchanged", UNCHANGED)
def _(spark, sf):
    return C.drop_unchanged(X.captures(spark, sf)).select("seq", "window_id")


@register(
    "frames_without_text",
    f"WITH {X.CAPTURES} SELECT seq FROM captures c WHERE NOT EXISTS (SELECT 1 FROM captures d WHERE d.seq % 4 = 0 "
    "AND d.window_id = c.window_id AND floor(epoch(d.ts)) = floor(epoch(c.ts)))",
)
def _(spark, sf):
    frames = X.captures(spark, sf)
    texts = frames.filter("seq % 4 = 0").select(K.capture_key(F.col("window_id"), F.col("ts")).alias("path"))
    return C.frames_without_text(frames, texts).select("seq")


def _asof(kind: str, of: str = "captures") -> str:
    return f"""{kind}s AS (SELECT c.seq, s.active AS {kind}_active FROM {of} c ASOF LEFT JOIN
  (SELECT session, ts, active FROM states WHERE kind = '{kind}') s ON c.session = s.session AND c.ts >= s.ts)"""


ASOF = f"WITH {X.CAPTURES}, {X.STATES}, {_asof('suspend')}, {_asof('lock')}"


@register("asof_state", f"{ASOF} SELECT seq, suspend_active, lock_active FROM suspends JOIN locks USING (seq)")
def _(spark, sf):
    seen = S.asof_state(X.captures(spark, sf), X.states(spark, sf))
    return seen.select("seq", "suspend_active", "lock_active")


GATED = f"""{ASOF} SELECT seq FROM suspends JOIN locks USING (seq)
WHERE NOT coalesce(suspend_active, FALSE) AND NOT coalesce(lock_active, FALSE)"""


@register("gate_paused", GATED)
def _(spark, sf):
    return S.gate_paused(X.captures(spark, sf), X.states(spark, sf)).select("seq")


TRANSITIONS = """changes AS (SELECT * EXCLUDE (was) FROM (SELECT *, lag(active, 1, FALSE) OVER
  (PARTITION BY session, kind ORDER BY ts, seq) AS was FROM states) WHERE active <> was)"""


@register("state_transitions", f"WITH {X.STATES}, {TRANSITIONS} SELECT session, kind, seq, active FROM changes")
def _(spark, sf):
    return S.state_transitions(X.states(spark, sf)).select("session", "kind", "seq", "active")


@register(
    "pause_intervals",
    f"""WITH {X.STATES}, {TRANSITIONS} SELECT session, kind, epoch_us(ts) AS start_us, epoch_us(end_ts) AS end_us FROM
    (SELECT *, lead(ts) OVER (PARTITION BY session, kind ORDER BY ts, seq) AS end_ts FROM changes) WHERE active""",
)
def _(spark, sf):
    spans = S.pause_intervals(X.states(spark, sf))
    return spans.select("session", "kind", X.us("start_ts").alias("start_us"), X.us("end_ts").alias("end_us"))


def throttle_sql(key: str, seconds: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT {key} AS k, ts, event_id FROM events),
out AS (SELECT k, min(ts) AS ts FROM e GROUP BY k
  UNION ALL
  SELECT * FROM (SELECT o.k, min(e.ts) AS ts FROM out o JOIN e ON e.k = o.k AND e.ts > o.ts + INTERVAL {seconds} SECOND GROUP BY o.k))
SELECT min(event_id) AS seq, k::VARCHAR AS k FROM out JOIN e USING (k, ts) GROUP BY k, ts"""


@register("throttle", throttle_sql("event_type", 3600))
def _(spark, sf):
    rows = X.captures(spark, sf).select("seq", "ts", F.col("title").alias("k"))
    return throttle(rows, ["k"], 3600, slice_intervals=5).select("seq", "k")


@register(
    "title_of",
    """SELECT event_id, trim(nullif(split_part(raw, ' = ', 2), ''), '"') AS title FROM (SELECT event_id,
    CASE WHEN event_id % 5 = 0 THEN 'WM_NAME: not found' WHEN event_id % 7 = 0
      THEN 'WM_NAME(STRING) = "' || event_type || ' = ' || event_id::VARCHAR || '"'
      ELSE 'WM_NAME(STRING) = "' || event_type || '"' END AS raw FROM events)""",
)
def _(spark, sf):
    e = X.events(spark, sf)
    name = F.lit('WM_NAME(STRING) = "')
    raw = (
        F.when(F.col("event_id") % 5 == 0, F.lit("WM_NAME: not found"))
        .when(
            F.col("event_id") % 7 == 0,
            F.concat(name, "event_type", F.lit(" = "), F.col("event_id").cast("string"), F.lit('"')),
        )
        .otherwise(F.concat(name, "event_type", F.lit('"')))
    )
    return e.select("event_id", K.title_of(raw).alias("title"))


KEYED = f"""keyed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'notes_' || lang || '.txt' WHEN doc_id % 2 = 0
  THEN '/a_b/' || lang || '/' || source || '_x_' || ({X.BASE} + doc_id)::VARCHAR || '.png'
  ELSE source || '_' || ({X.BASE} + doc_id)::VARCHAR || '.txt' END AS path FROM documents)"""


def _keyed(spark, sf):
    d = X.table(spark, sf, "documents")
    epoch = (F.lit(X.BASE) + F.col("doc_id")).cast("string")
    path = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("notes_"), "lang", F.lit(".txt")))
        .when(
            F.col("doc_id") % 2 == 0,
            F.concat(F.lit("/a_b/"), "lang", F.lit("/"), "source", F.lit("_x_"), epoch, F.lit(".png")),
        )
        .otherwise(F.concat("source", F.lit("_"), epoch, F.lit(".txt")))
    )
    return d.select("doc_id", path.alias("path"))


@register(
    "parse_capture_key",
    rf"""WITH {KEYED}, p AS (SELECT doc_id, regexp_extract(path, '([^/]+)_(\d+)\.(txt|png)$', ['w', 't', 'k']) AS m FROM keyed)
    SELECT doc_id, nullif(m.w, '') AS window_id, try_cast(m.t AS BIGINT) * 1000000 AS ts_us, nullif(m.k, '') AS kind FROM p""",
)
def _(spark, sf):
    key = K.parse_capture_key(F.col("path"))
    return _keyed(spark, sf).select(
        "doc_id", key["window_id"].alias("window_id"), X.us(key["ts"]).alias("ts_us"), key["kind"].alias("kind")
    )


@register("basename", rf"WITH {KEYED} SELECT doc_id, regexp_extract(path, '[^/]*$') AS name FROM keyed")
def _(spark, sf):
    return _keyed(spark, sf).select("doc_id", K.basename(F.col("path")).alias("name"))


@register("of_type", rf"WITH {KEYED} SELECT doc_id, path FROM keyed WHERE path LIKE '%.png'")
def _(spark, sf):
    return _keyed(spark, sf).filter(K.of_type(F.col("path"), "png"))


SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@register(
    "split_list",
    f"""SELECT doc_id, len(parts)::BIGINT AS n_parts, array_to_string(parts, '|') AS parts FROM (SELECT doc_id, list_filter(list_transform(
    string_split(text, ','), lambda x: trim(x, {SPACE})), lambda x: x <> '') AS parts FROM documents)""",
)
def _(spark, sf):
    parts = K.split_list(F.col("text"))
    return X.table(spark, sf, "documents").select(
        "doc_id", F.size(parts).cast("long").alias("n_parts"), F.array_join(parts, "|").alias("parts")
    )


@register("before_first_comma", "SELECT doc_id, trim(split_part(text, ',', 1)) AS head FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", K.before_first_comma(F.col("text")).alias("head"))
