"""Batches of guarded edits: tokens and revisions as tables, checks as joins, one revision a tree and batch.

Tables: nodes (ast_id, path, section_title, content_summary), meta (ast_id, rev, updated_at) and tokens
(token, ast_id, purpose, path, issued_rev, expires_at). A batch has ast_id, edit_no (its order in all of
the batch, unique), token, action, path and the action's arguments, as a log of `operators.edits`;
actions by title are resolved to paths before (`tree.resolve`).

An edit is checked in this order: its arguments; its token: known, not expired, of this tree, of the
tree's revision, for this action, for this node; then whether the node and the position exist. A token
goes when it passes or when it is found expired, and not otherwise. As every edit that succeeds moves
its tree to the next revision, all tokens of which are of the one before, one edit a tree and batch
succeeds: the first that passes everything. So all checks are made on one state of the trees, by joins
and windows over a tree's or a token's edits, and nothing waits for an edit before it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import edits as logs
from .tree import parent_of

LIFE = timedelta(minutes=10)
PURPOSES = ["append_child", "upsert_child", "update_node", "append_to_summary"]


def issue(wanted: DataFrame, meta: DataFrame, now: Column, token: Column | None = None, life: timedelta = LIFE) -> DataFrame:
    """Tokens for wanted (ast_id, purpose, path) of the trees' revisions; token: a column that makes them, else random ones."""
    t = wanted.join(meta.select("ast_id", "rev"), "ast_id")
    return t.select((F.expr("uuid()") if token is None else token).alias("token"), "ast_id", "purpose", F.coalesce("path", F.array().cast("array<int>")).alias("path"), F.col("rev").alias("issued_rev"), (now + F.lit(life)).alias("expires_at"))


@dataclass
class Batch:
    """outcomes: ast_id, edit_no, action, ok, error, rev (the tree's revision after the edit); nodes, meta, tokens: the tables after the batch."""

    outcomes: DataFrame
    nodes: DataFrame
    meta: DataFrame
    tokens: DataFrame


def _arguments(e: DataFrame) -> Column:
    title, summary = F.col("section_title"), F.col("content_summary")
    missing = (
        F.when(F.col("action") == "append_child", summary.isNull()).when(F.col("action") == "upsert_child", summary.isNull() | (F.coalesce(title, F.lit("")) == ""))
        .when(F.col("action") == "update_node", title.isNull() & summary.isNull()).when(F.col("action") == "append_to_summary", F.col("append_text").isNull())
    )
    return F.when(~F.coalesce(F.col("action").isin(PURPOSES), F.lit(False)), F.lit("unknown action")).when(F.col("rev").isNull(), "no such tree").when(missing, "title or text is missing")


def commit(nodes: DataFrame, meta: DataFrame, tokens: DataFrame, batch: DataFrame, now: Column) -> Batch:
    """Checks and carries out a batch. now: the time, the same for all."""
    had = set(batch.columns)
    fields = {k: v for k, v in logs.FIELDS.items() if k not in ("titles", "create_missing")}
    e = batch.select("ast_id", F.col("edit_no").cast("long").alias("edit_no"), "token", "action", *[(F.col(c) if c in had else F.lit(None)).cast(k).alias(c) for c, k in fields.items()])
    e = e.withColumn("path", F.coalesce("path", F.array().cast("array<int>")))
    t = tokens.select("token", F.col("ast_id").alias("t_ast"), "purpose", F.col("path").alias("t_path"), "issued_rev", "expires_at")
    e = e.join(t, "token", "left").join(meta.select("ast_id", "rev"), "ast_id", "left").withColumn("arguments", _arguments(e))
    # What a use of the token comes to by itself, on the revision that the tree has now.
    known = F.col("t_ast").isNotNull()
    fixed = F.when(~known, "unknown token").when(now > F.col("expires_at"), "token has expired").when(F.col("t_ast") != F.col("ast_id"), "token is of another tree")
    later = F.when(F.col("issued_rev") != F.col("rev"), "token is of another revision").when(F.col("purpose") != F.col("action"), "token is for another purpose").when(F.col("t_path") != F.col("path"), "token is for another node")
    e = e.withColumns({"fixed": fixed, "later": later})
    uses = F.col("arguments").isNull()
    passes = uses & F.col("fixed").isNull() & F.col("later").isNull()
    # The node and its children, for edits that come so far.
    kids = nodes.where(F.size("path") > 0).groupBy("ast_id", parent_of("path").alias("path")).agg(F.count("*").cast("int").alias("kids"))
    there = nodes.select("ast_id", "path", F.lit(True).alias("there"))
    e = e.join(there, ["ast_id", "path"], "left").join(kids, ["ast_id", "path"], "left")
    can = F.when(F.col("there").isNull(), "no node at the path").when((F.col("action") == "append_child") & ~F.coalesce(F.col("position").between(0, F.coalesce("kids", F.lit(0))), F.lit(True)), "position is out of range")
    e = e.withColumns({"passes": passes, "can": can})
    # The first pass uses a token up; each tree's first edit that passes with its token unused and can be done is the one that is.
    of_token = Window.partitionBy(F.coalesce("token", F.concat(F.lit("none "), "edit_no"))).orderBy("edit_no").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("used", F.coalesce(F.bool_or("passes").over(of_token), F.lit(False)))
    of_tree = Window.partitionBy("ast_id")
    e = e.withColumn("done_at", F.min(F.when(F.col("passes") & ~F.col("used") & F.col("can").isNull(), F.col("edit_no"))).over(of_tree))
    moved = F.coalesce(F.col("edit_no") > F.col("done_at"), F.lit(False))
    e = e.withColumns({"moved": moved, "uses_up": F.col("passes") & ~F.col("used") & ~moved})
    # After that, passes are none; so a token goes by the first use that passes in time or finds it expired.
    gone = F.col("uses_up") | (F.col("arguments").isNull() & F.col("t_ast").isNotNull() & (now > F.col("expires_at")))
    e = e.withColumn("was_gone", F.coalesce(F.bool_or(gone).over(of_token), F.lit(False)))
    error = (
        F.when(F.col("arguments").isNotNull(), F.col("arguments")).when(F.col("was_gone"), "unknown token").when(F.col("fixed").isNotNull(), F.col("fixed"))
        .when(F.col("moved"), "token is of another revision").when(F.col("later").isNotNull(), F.col("later")).otherwise(F.col("can"))
    )
    e = e.withColumn("error", error).withColumn("ok", F.col("error").isNull())
    outcomes = e.select("ast_id", "edit_no", "action", "ok", "error", (F.col("rev") + (F.col("ok") | F.col("moved")).cast("int")).alias("rev"))
    winners = e.where("ok").select("ast_id", "edit_no", "action", *fields)
    after = logs.nodes_after(logs.replay(nodes, winners))
    won = winners.select("ast_id", F.lit(True).alias("won"))
    new_meta = meta.join(won, "ast_id", "left").select(*[F.when(F.col("won"), F.col("rev") + 1).otherwise(F.col("rev")).alias(c) if c == "rev" else F.when(F.col("won"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in meta.columns])
    spent = e.where(gone).select("token").distinct()
    return Batch(outcomes, after, new_meta, tokens.join(spent, "token", "left_anti"))


# Versions of a set of tables


def _files(spark: SparkSession, root: str):
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return path, path(root).getFileSystem(conf)


def version(spark: SparkSession, root: str) -> int:
    """The latest version under root; 0 if there is none."""
    path, fs = _files(spark, root)
    at = path(f"{root}/versions")
    return max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=0) if fs.exists(at) else 0


def publish(spark: SparkSession, root: str, base: int, tables: dict[str, DataFrame]) -> bool:
    """Writes the tables as the version after `base`, all or none; False if another writer was first, whose version has to be read and the batch checked again. The version is one file, which the file system creates only if it does not exist."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    path, fs = _files(spark, root)
    fs.mkdirs(path(f"{root}/versions"))
    try:
        out = fs.create(path(f"{root}/versions/{base + 1}"), False)
    except Exception as e:
        if fs.exists(path(f"{root}/versions/{base + 1}")):
            return False
        raise e
    try:
        out.write(bytearray(folder.encode()))
    finally:
        out.close()
    return True


def read_version(spark: SparkSession, root: str, number: int, name: str) -> DataFrame:
    """A table of a version."""
    return spark.read.parquet(f"{spark.read.text(f'{root}/versions/{number}').first()[0]}/{name}")
