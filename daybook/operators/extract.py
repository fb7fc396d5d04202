"""Payload to text: one bad row never stops the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import html_text


def extract_html(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Replace the HTML payload by `text` and `error` (NULL payloads are reported)."""
    error = F.when(F.col(payload).isNull(), F.lit("no payload"))
    return pages.withColumn("text", html_text(F.col(payload))).withColumn("error", error).drop(payload)


def extract_text(frames: DataFrame, payload: str, extractor: Callable[[object], str]) -> DataFrame:
    """Replace `payload` by (text, error) from a plugged-in extractor, one Arrow batch at a time."""

    def one(value: object) -> tuple[str | None, str | None]:
        try:
            return extractor(value), None
        except Exception as e:  # noqa: BLE001 - reported per row
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            yield pd.DataFrame([one(v) for v in values], columns=["text", "error"])

    return frames.withColumn("_x", run(payload)).select(
        *[c for c in frames.columns if c != payload], "_x.text", "_x.error"
    )
