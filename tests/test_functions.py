import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daybook.functions import display as D
from daybook.functions import keys as K
from daybook.functions import schedule as SC
from daybook.functions import text as T
from daybook.functions import vectors as V
from daybook.sources.files import split_valid_utf8
from tests.helpers import at


def one(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text", ["", " ", "\t\n", "\x1c\x1f", " ", " 　", "\x85", "a", " . ", " x", "​", "﻿"]
)
def test_non_blank_agrees_with_strip(spark, text):
    assert one(spark, T.is_non_blank(F.col("t")), t=text) == bool(text.strip())


def test_tokens_and_accents(spark):
    assert one(spark, T.tokens(F.col("t")), t="Été, l'an 2024! x_y") == ["été", "l", "an", "2024", "x", "y"]
    assert one(spark, T.tokens(F.col("t"), fold=True), t="Été Über") == ["ete", "uber"]


def test_newlines(spark):
    assert one(spark, T.normalise_newlines(F.col("t")), t="a\r\nb\rc\n") == "a\nb\nc\n"


def test_html_text(spark):
    page = "<html><script>var a='<p>';</script><!-- x --><h1>Hi  there</h1><p>a &amp;lt; <b>b</b><br>c</p></html>"
    assert one(spark, T.html_text(F.col("t")), t=page) == "Hi there\na &lt; b\nc"


def test_invalid_utf8_is_rejected_with_a_reason(spark):
    rows = spark.createDataFrame([(b"ok",), (b"\xff\xfe",), ("é".encode(),)], "content binary")
    good, bad = split_valid_utf8(rows)
    assert good.count() == 2 and bad.select("reason").first().reason == "undecodable"


@pytest.mark.parametrize(
    "path, window, ok",
    [("/a/0x1_2_1704067200.txt", "0x1_2", True), ("w_1704067200.png", "w", True), ("w.txt", None, False), ("w_x.txt", None, False)],
)
def test_capture_key(spark, path, window, ok):
    key = K.parse_capture_key(F.col("p"))
    assert one(spark, key["window_id"], p=path) == window
    assert one(spark, key["ts"], p=path) == (at(0) if ok else None)


def test_capture_key_round_trip(spark):
    df = spark.createDataFrame([("w_1", at(12.7))], "w string, t timestamp")
    name = df.select(K.capture_key(F.col("w"), F.col("t")).alias("n")).first().n
    assert name == "w_1_1704067212.txt"


@pytest.mark.parametrize(
    "raw, title",
    [('WM_NAME(S) = "mail"', "mail"), ('WM_NAME(S) = "a = b"', "a"), ("WM_NAME: not found", None)],
)
def test_title(spark, raw, title):
    assert one(spark, K.title_of(F.col("r")), r=raw) == title


@pytest.mark.parametrize(
    "given, terms",
    [("", []), ('""', []), ('"Mail, bank "', ["mail", "bank"]), ("a,, b ,", ["a", "b"]), (["X", " "], ["x"])],
)
def test_exclusion_terms(given, terms):
    assert K.exclusion_terms(given) == terms


@pytest.mark.parametrize("raw, band", [("0", "low"), ("1", "mid"), ("49", "mid"), ("50", "high"), ("Disabled", "Disabled"), ("?", "?")])
def test_backlog_band(spark, raw, band):
    assert one(spark, D.backlog_band(F.col("r")), r=raw) == band


@pytest.mark.parametrize(
    "minute, want", [(0, "~ 00:15"), (14, "~ 00:15"), (15, "~ 00:30"), (45, "~ 01:00"), (59, "~ 01:00"), (23 * 60 + 59, "~ 00:00")]
)
def test_quarter_hour(spark, minute, want):
    df = spark.createDataFrame([(at(minute * 60),)], "t timestamp")
    assert df.select(SC.fmt_quarter_hour(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize(
    "minute, schedule, want",
    [
        (0, "*:0/15", 15), (14, "*:0/15", 15), (45, "*:0/15", 60), (59, "*:5/20", 65), (4, "*:5/20", 5),
        (23 * 60 + 50, "*:0/15", 24 * 60), (0, "*:0/0", None), (0, "bad", None), (0, "*:70/5", None), (0, "*:0/-5", None),
    ],
)
def test_next_slot(spark, minute, schedule, want):
    df = spark.createDataFrame([(at(minute * 60 + 30), schedule)], "t timestamp, s string")
    got = df.select(SC.next_slot(F.col("t"), F.col("s")).alias("x")).first().x
    assert got == (None if want is None else at(want * 60))


def test_display(spark):
    assert one(spark, D.fmt_mib(F.col("b")), b=1572864) == "1.50 MB"
    assert one(spark, D.fmt_kib(F.col("b")), b=1536) == "1.5"
    assert one(spark, D.fmt_thousands(F.col("b")), b=1234567) == "1,234,567"
    assert one(spark, D.fmt_time(F.col("t").cast("timestamp")), t=None) == "N/A"
    assert one(spark, D.clamp0(F.col("n")), n=-3) == 0
    assert one(spark, D.progress_pct(F.col("a"), F.col("b")), a=1, b=3) == 33.3
    assert one(spark, D.progress_pct(F.col("a"), F.col("b")), a=1, b=0) is None


def test_words_are_counted_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(V, "COUNTED_WORDS", 5)
    texts = [["b", "a", "b"], None, [], ["c"], ["a"] * 9, ["x", "y"], ["x", "z", "x"], []]
    seen = []
    for rows, terms, doc, code, tf in V.counted(pa.array(texts, pa.list_(pa.string()))):
        assert len(rows.flatten()) <= 5 or len(rows) == 1
        names = np.array(terms.to_pylist(), object)[code]
        for i, own in enumerate(rows.to_pylist()):
            assert list(zip(names[doc == i], tf[doc == i])) == [(w, own.count(w)) for w in dict.fromkeys(own or [])]
            seen.append(own)
    assert seen == texts
    assert [*V.counted(pa.array([], pa.list_(pa.string())))] == []
