"""Files as they arrive: matches of each new text, appended to a table (an addition of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matches import match_table
from ..sources.text import lines


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id (path), text of each new file under path."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def stream_matches(docs: DataFrame, patterns: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Appends the matches of all texts that are there and not yet done, then ends. The file sink writes each batch once."""
    found = match_table(lines(docs), patterns)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
