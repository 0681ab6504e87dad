"""Audits of a blueprint against documents: gaps, collisions, breaks in numbering, pattern statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import search
from ..functions.dialect import patterns
from ..functions.text import heading_numbers
from ..plans.blueprint import Blueprint
from .outline import classify


def gaps(lines: DataFrame, bp: Blueprint, min_len: int = 1) -> DataFrame:
    """doc_id, first_line, last_line, n_lines: runs of lines without a heading, at least min_len long. Excluded lines are neither in a run nor between two."""
    c = classify(lines, bp)
    number = Window.partitionBy("doc_id").orderBy("line_number")
    c = c.withColumn("_all", F.row_number().over(number)).where(F.size("hits") == 0)
    c = c.withColumn("_run", F.col("_all") - F.row_number().over(number))
    runs = c.groupBy("doc_id", "_run").agg(F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.count("*").alias("n_lines"))
    return runs.where(F.col("n_lines") >= min_len).drop("_run")


def collisions(lines: DataFrame, bp: Blueprint) -> DataFrame:
    """doc_id, line_number, line, names: lines that more than one rule takes for a heading."""
    c = classify(lines, bp).where(F.size("hits") > 1)
    return c.select("doc_id", "line_number", "line", F.transform("hits", lambda h: h["name"]).alias("names"))


def breaks(rows: DataFrame, within: list[str], order: Column | str, number: Column) -> DataFrame:
    """rows with number and previous, where the number is not one more than that of the row before within the same group."""
    w = Window.partitionBy(*within).orderBy(order)
    r = rows.withColumn("number", number).where(F.col("number").isNotNull()).withColumn("previous", F.lag("number").over(w))
    return r.where(F.col("number") - F.col("previous") != 1)


def sequence_breaks(placed: DataFrame) -> DataFrame:
    """Headings of an outline whose last number doesn't follow that of the sibling before."""
    return breaks(placed, ["doc_id", "parent_line", "level"], "line_number", F.element_at(heading_numbers(F.col("heading")), -1))


def pattern_stats(lines: DataFrame, given: list[str]) -> DataFrame:
    """pattern_index, pattern, n_matches, n_lines, n_docs, first_line, last_line, mean_line, of patterns with matches. Sums are columns, by document first; no line becomes a row a pattern."""
    ps = patterns(given)
    rows = lines.select("doc_id", "line_number", *[search.count(F.col("line"), p).alias(f"n{k}") for k, p in enumerate(ps)])
    own = lambda k: F.when(F.col(f"n{k}") > 0, F.col("line_number"))
    by_doc = rows.groupBy("doc_id").agg(*[f.alias(f"{x}{k}") for k in range(len(ps)) for x, f in (("m", F.sum(f"n{k}")), ("l", F.count(own(k))), ("a", F.min(own(k))), ("b", F.max(own(k))), ("s", F.sum(own(k))))])
    sums = by_doc.agg(*[f.alias(f"{x}{k}") for k in range(len(ps)) for x, f in (("n_matches", F.sum(f"m{k}")), ("n_lines", F.sum(f"l{k}")), ("n_docs", F.count_if(F.col(f"l{k}") > 0)), ("first_line", F.min(f"a{k}")), ("last_line", F.max(f"b{k}")), ("s", F.sum(f"s{k}")))])
    each = F.array(*[F.struct(F.lit(k).alias("pattern_index"), F.lit(p.source).alias("pattern"), *[F.col(f"{x}{k}").alias(x) for x in ("n_matches", "n_lines", "n_docs", "first_line", "last_line", "s")]) for k, p in enumerate(ps)])
    out = sums.select(F.explode(each).alias("m")).select("m.*").where("n_lines > 0")
    return out.withColumn("mean_line", F.col("s") / F.col("n_lines")).drop("s")
