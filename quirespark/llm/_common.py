"""Helpers shared by the training-data operators: tokens, checkpoints, bounded batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: whatever stands between ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results; a local one only where none is configured and Spark itself runs on this machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Folders that this process has made for intermediate tables, until `tidy` removes them.
MADE: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    MADE.append(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table into the checkpoint folder and goes on from the files."""
    at = fresh_folder(df.sparkSession, "cut")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def tidy(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Deletes these intermediate tables, or all that this process has made: results that read them and are not yet written are lost."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for folder in list(MADE) if folders is None else folders:
        MADE.remove(folder)
        at = path(folder)
        at.getFileSystem(conf).delete(at, True)


#: Tasks among which the rows of one key are dealt.
SALTS = 64


def spread_join(rows: DataFrame, lookup: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """rows joined with lookup, which has a row a key. Rows of a hot key are dealt out by the columns `by`, and its lookup row is copied to those tasks only."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    copies = salted.select(*key, "_salt").distinct().join(lookup.hint("merge"), key)
    return salted.join(copies.hint("merge"), [*key, "_salt"]).drop("_salt")


def crc_mod(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches, column: str = "text", limit: int = 2 << 20):
    """Slices of the batches with about `limit` bytes of text each; a longer single row stays whole."""
    for batch in batches:
        start = held = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def bytes_of(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]
