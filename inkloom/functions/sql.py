"""Functions for SQL: registered once per session (survey §2.10)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession, functions as F


def register(spark: SparkSession) -> None:
    """canonical_topic(text) and the table function sentence_rows(text)."""

    @F.pandas_udf("string")
    def canonical_topic(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isascii() and c.isalnum() or "一" <= c <= "鿿"))

    @F.udtf(returnType="pos int, sentence string")
    class SentenceRows:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            import re

            for i, s in enumerate(x.strip() for x in re.split(r"(?<=[。！？；.!?])\s*|\n+", text or "") if len(x.strip()) >= 12):
                yield i, s

    spark.udf.register("canonical_topic", canonical_topic)
    spark.udtf.register("sentence_rows", SentenceRows)
