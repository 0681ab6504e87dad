"""Summaries of sections out of their own sentences, chosen by how rare their words are in the corpus and where they stand.

A word weighs the whole part of log2(sections / sections that have it). A sentence's score is 100 times
its words' mean weight, rounded down, and a bonus for its place; best ones are taken as long as they fit
into the length, and stand in the order of the text. All is in whole numbers.

Words that stand in more than one of `FREQUENT` sections are at most FREQUENT times as many as the
distinct words of a mean section, whatever the size of the corpus; their weights are broadcast, so that
the join of all other words by key has no hot one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = "[^\\x20\\x09-\\x0D.,;:!?\"()]+"
#: A sentence, its end included.
SENTENCE = "[^.!?。！？\\n]+[.!?。！？]*"
FREQUENT = 256
BONUS = 300


def _log2(x: Column) -> Column:
    """The whole part of the logarithm of a whole number of at least 1."""
    return F.length(F.bin(x)) - 1


def _sentences(text: str) -> Column:
    """Sentences of a text that have a word."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.rlike(s, F.lit(WORDS)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def word_weights(sections: DataFrame, text: str, n: int) -> DataFrame:
    """word, df (sections that have it), weight. A section's distinct words are found in its row, so that counts alone are exchanged."""
    distinct = F.array_distinct(F.flatten(F.transform(_sentences(text), _words)))
    df = sections.select(F.explode(distinct).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.withColumn("weight", _log2(F.floor(F.lit(n) / F.col("df")).cast("long")))


def extract(sections: DataFrame, key: list[str], text: str = "body", length: int = 200) -> DataFrame:
    """key and summary: the best sentences of each section, of `length` characters together at most, joined by spaces; empty if none fits. key names a section, a row; it is not null."""
    s = sections.select(*key, F.posexplode(_sentences(text)).alias("place", "sentence"))
    words = s.select(*key, "place", F.explode(_words(F.col("sentence"))).alias("word"))
    n = sections.count()
    weights = word_weights(sections, text, n)
    often = F.col("df") * FREQUENT > n
    first = words.join(F.broadcast(weights.where(often).select("word", "weight")), "word", "left")
    rest = first.where("weight is null").drop("weight").join(weights.where(~often).select("word", "weight"), "word")
    every = first.where("weight is not null").unionByName(rest)
    scores = every.groupBy(*key, "place").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    score = (F.floor(F.col("w") * 100 / F.col("n")) + F.floor(F.lit(BONUS) / (F.col("place") + 1))).alias("score")
    ranked = s.join(scores.select(*key, "place", score), [*key, "place"])
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "place")
    ranked = ranked.withColumn("upto", F.sum(F.length("sentence") + 1).over(best) - 1).where(F.col("upto") <= length)
    chosen = ranked.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))
    return sections.select(*key).distinct().join(chosen, key, "left").withColumn("summary", F.coalesce("summary", F.lit("")))
