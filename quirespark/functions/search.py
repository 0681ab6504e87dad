"""Tests, counts and first matches of patterns on a column: Spark's functions, or Python's re in Arrow batches for patterns that Java can't express."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import Pattern


def count(line: Column, p: Pattern) -> Column:
    """How many matches a line has."""
    if not p.exact:
        return F.regexp_count(line, F.lit(p.java))
    source = p.source

    @F.pandas_udf("int")
    def run(line: pd.Series) -> pd.Series:
        find = re.compile(source)
        return line.map(lambda s: None if s is None else sum(1 for _ in find.finditer(s))).astype("Int32")

    return run(line)


def first(line: Column, p: Pattern, at_start: bool = False) -> Column:
    """The first match, at the line's begin only if so asked; null where there is none."""
    if not p.exact:
        java = f"^(?:{p.java})" if at_start else p.java
        if p.least:  # no match is empty, so an empty one is none
            return F.nullif(F.regexp_extract(line, java, 0), F.lit(""))
        return F.when(F.rlike(line, F.lit(java)), F.regexp_extract(line, java, 0))
    source = p.source

    @F.pandas_udf("string")
    def run(line: pd.Series) -> pd.Series:
        find = re.compile(source)
        look = find.match if at_start else find.search
        return line.map(lambda s: m[0] if s is not None and (m := look(s)) else None)

    return run(line)


def holds(line: Column, p: Pattern) -> Column:
    """Whether a line has a match."""
    return F.rlike(line, F.lit(p.java)) if not p.exact else first(line, p).isNotNull()
