"""Texts as rows: whole files, lines, segments, lengths and pages of other formats."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), text: each file whole, byte order mark and newlines as they are. ValueError-like failure for invalid UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    checked = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
    return files.select(F.col("path").alias("doc_id"), checked.alias("text"))


def normal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_number (from 1), line. A final newline makes no further line; an empty or null text has none."""
    t = normal_newlines(F.col(text))
    parts = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, "\n\\z", ""), "\n", -1))
    return docs.select(key, F.posexplode(parts).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_number"), "line")


def segment(text: Column, start: int | None = 0, length: int | None = None) -> Column:
    """Characters from `start` on (0 if less): 100 without a length, all to the end for a negative one."""
    t, begin = normal_newlines(text), max(start or 0, 0) + 1
    return F.substring(t, begin, 2**31 - 1 - begin if length is not None and length < 0 else 100 if length is None else length)


def char_length(text: Column) -> Column:
    """Characters once newlines are one each."""
    return F.length(normal_newlines(text))


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """doc_id (path, .pdf as .txt), text: what `extract` finds on a file's pages, newlines between. The format's library comes with `extract`."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda c: "\n".join(extract(c)))

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_replace("path", "(?i)\\.pdf$", ".txt").alias("doc_id"), text("content").alias("text"))
