"""Lines of large text files, read in ranges: no file has to fit into a task.

Spark's text source deals a file out in byte ranges and gives a record to the range in which it
starts, so that a newline across a border belongs to one side. A first scan counts records, lines,
characters and bytes of each range; sums over the ranges before it, which are a few numbers a range,
give the place of its first line and character. A second scan counts on from there, in the order of
the records and without an exchange of texts.

Newlines are universal: \\n, \\r\\n and \\r. A record ends at \\n, and \\r alone divides it, so that a
stretch without \\n is a record of one task. A byte order mark stays, as the first character.

Defined cases: a final newline makes no further line; an empty file, or one of nothing but a byte
order mark, has none; bytes that are not UTF-8 fail the job; files that Spark can't split (gzip) are
one range.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of which first places are broadcast (some 100 bytes each); more are joined.
MOST_BROADCAST = 200_000


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range), size (of the file), record: what ends at a \\n."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("record"))
    checked = F.when(F.is_valid_utf8("record"), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "file")))
    return rows.withColumn("record", checked)


def _lines(record: str) -> Column:
    """Lines of a record: the \\r before its \\n belongs to the newline, others end lines."""
    return F.split(F.regexp_replace(record, "\r\\z", ""), "\r", -1)


def ranges(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """file, start and what stands before each range: first_line (from 1), first_char (from 0) and marked: it begins with a byte order mark; open: the file does not end with a newline. together: files in the order of their names are one text."""
    r = _records(spark, path).select("file", "start", "size", _lines("record").alias("lines"), F.octet_length("record").alias("bytes"), F.endswith("record", F.lit("\r")).alias("ends"), F.monotonically_increasing_id().alias("no"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 1)
    each = r.groupBy("file", "start").agg(F.max("size").alias("size"), F.sum(F.size("lines")).cast("long").alias("n_lines"), F.sum(chars).alias("n_chars"), F.sum(F.col("bytes") + 1).alias("n_bytes"), F.max_by("ends", "no").alias("ends"))
    file = Window.partitionBy("file")
    # The source drops a byte order mark, and counts a \n after the last record whether it is there or not.
    missing = F.col("size") - F.sum("n_bytes").over(file)
    each = each.withColumns({"marked": (missing >= 2) & (F.col("start") == F.min("start").over(file)), "open": missing.isin(2, -1), "last": F.col("start") == F.max("start").over(file)})
    each = each.withColumn("open", F.col("open") & ~F.max(F.when(F.col("last"), F.col("ends"))).over(file))
    each = each.withColumn("n_chars", F.col("n_chars") + F.col("marked").cast("int") - (F.col("last") & F.col("open")).cast("int"))
    text = Window.partitionBy(*[] if together else ["file"]).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(text), F.lit(0)).cast("long")
    return each.select("file", "start", (before("n_lines") + 1).alias("first_line"), before("n_chars").alias("first_char"), "n_lines", "marked", (F.col("last") & F.col("open")).alias("open"))


def scan_lines(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """file, line_number (from 1), char_start (from 0; each newline counts as one), line, ended: a newline follows."""
    places = ranges(spark, path, together).withColumnRenamed("start", "_start").withColumnRenamed("file", "_file")
    known = places.limit(MOST_BROADCAST + 1).collect()
    if len(known) <= MOST_BROADCAST:
        places = F.broadcast(spark.createDataFrame(known, places.schema))
    rows = _records(spark, path).select("file", "start", F.explode(_lines("record")).alias("line"))

    def run(batches):
        at, n, chars = None, 0, 0
        for b in batches:
            marks = list(zip(b.column("file").to_pylist(), b.column("start").to_pylist()))
            sizes = pc.add(pc.utf8_length(b.column("line")), 1).to_pylist()
            numbers, begins = [], []
            for mark, size in zip(marks, sizes):
                if mark != at:
                    at, n, chars = mark, 0, 0
                numbers.append(n)
                begins.append(chars)
                n, chars = n + 1, chars + size
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64()), pa.array(begins, pa.int64())], ["file", "start", "line", "n", "chars"])

    counted = rows.mapInArrow(run, "file string, start long, line string, n long, chars long")
    found = counted.join(places, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    first = F.col("marked") & (F.col("n") == 0)
    shift = (F.col("marked") & (F.col("n") > 0)).cast("int")
    return found.select("file", (F.col("first_line") + F.col("n")).alias("line_number"), (F.col("first_char") + F.col("chars") + shift).alias("char_start"), F.when(first, F.concat(F.lit("﻿"), "line")).otherwise(F.col("line")).alias("line"), (~(F.col("open") & (F.col("n") == F.col("n_lines") - 1))).alias("ended"))


def segment_pieces(lines: DataFrame, start: int = 0, length: int | None = None) -> DataFrame:
    """file, line_number, piece: what lines of `scan_lines` have of the segment of `length` characters from `start` on (100 without a length, to the end for a negative one), newlines among them; in order they make the segment. No text is put together."""
    begin = max(start or 0, 0)
    end = F.lit(2**62) if length is not None and length < 0 else F.lit(begin + (100 if length is None else length))
    whole = F.concat("line", F.when(F.col("ended"), "\n").otherwise(""))
    stop = F.col("char_start") + F.length(whole)
    within = lines.where((F.col("char_start") < end) & (stop > begin))
    head = F.greatest(F.lit(begin) - F.col("char_start"), F.lit(0))
    piece = F.substring(whole, (head + 1).cast("int"), (F.least(stop, end) - F.col("char_start") - head).cast("int"))
    return within.select("file", "line_number", piece.alias("piece")).where("piece <> ''")
