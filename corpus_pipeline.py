"""A training corpus from raw documents, in five stages.

quality classifier: documents that it rejects go. near dedup: one document of each group stays.
decontamination: documents with benchmark passages go. secrets: reported spans are masked.
mixing: the remaining words are mixed to the sources' target weights, a row a block of the mix.

Defined cases: null and empty texts are scored like any other and have no words to mix; null ids and
sources stay what they are; repeated rows are one document after near dedup, but rows without words
are in no group; empty tables give no rows; other columns of documents, whatever their names, reach
the fourth stage as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirespark.llm import _common, decontaminate, mixing, near_dedup, rules, secrets
from quirespark.llm._common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs).blocks()


STAGES = [("quality classifier", quality), ("near dedup", near), ("decontamination", benchmark), ("secrets", mask), ("mixing", mix)]

#: The learned classifier and the hashed order of the mix are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table. Each stage is written to the checkpoint folder and read again; then the tables go that it and the stage before were made with."""
    docs, made = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        found = len(_common.MADE)
        rows = stage(spark, docs, sf_dir)
        at = _common.fresh_folder(spark, "pipeline")
        rows.write.parquet(at)
        docs = spark.read.parquet(at)
        _common.tidy(spark, [*made, *(x for x in _common.MADE[found:] if x != at)])
        made = [at]
    return docs
