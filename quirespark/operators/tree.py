"""Document trees as node tables (ast_id, path, section_title, content_summary), for many trees at once.

A path is an array of places from 0; [] is the root, and the order of arrays is the order of the
text. Edits are tables with one row a tree: two edits of one tree, or an edit of a node that isn't
there, fail the job. Trees without an edit stay as they are; edits of unknown trees have no effect.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import joined_summary, normal_title, same_title

SCHEMA = "ast_id string, path array<int>, section_title string, content_summary string"
NODE = ["ast_id", "path", "section_title", "content_summary"]


def root_path() -> Column:
    return F.array().cast("array<int>")


def from_sections(sections: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Nodes of an outline's sections (path, heading, content_summary), and a root for each document; titles: (doc_id, title) of roots, else the id."""
    ids = sections.select("doc_id").distinct() if titles is None else titles
    title = F.col("doc_id").cast("string") if titles is None else F.col("title")
    roots = ids.select(F.col("doc_id").cast("string").alias("ast_id"), root_path().alias("path"), title.alias("section_title"), F.lit("").alias("content_summary"))
    return roots.unionByName(sections.select(F.col("doc_id").cast("string").alias("ast_id"), "path", F.col("heading").alias("section_title"), "content_summary"))


def parent_of(path: str) -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def under(path: Column, top: Column) -> Column:
    """Whether path is top or below it."""
    return F.slice(path, 1, F.size(top)) == top


def child_of(path: Column, parent: Column) -> Column:
    return (F.size(path) == F.size(parent) + 1) & under(path, parent)


def subtree(nodes: DataFrame, top: list[int]) -> DataFrame:
    return nodes.where(under(F.col("path"), F.array(*map(F.lit, top)).cast("array<int>")))


def children(nodes: DataFrame, parent: list[int]) -> DataFrame:
    """ast_id, index, section_title of the nodes one step below parent."""
    kept = nodes.where(child_of(F.col("path"), F.array(*map(F.lit, parent)).cast("array<int>")))
    return kept.select("ast_id", F.try_element_at("path", F.lit(-1)).alias("index"), "section_title")


def find_by_title(nodes: DataFrame, query: str, ignore_case: bool = True, max_results: int = 20) -> DataFrame:
    """Nodes of each tree whose title holds the query, the first max_results (1 at least) in the order of the text; none for an empty query."""
    title, q = F.coalesce("section_title", F.lit("")), query
    if ignore_case:
        title, q = F.lower(title), query.lower()
    found = nodes.where(F.contains(title, F.lit(q)) if q else F.lit(False))
    return found.withColumn("_at", F.row_number().over(Window.partitionBy("ast_id").orderBy("path"))).where(F.col("_at") <= max(1, max_results)).drop("_at")


def step(nodes: DataFrame, at: DataFrame, title: Column) -> DataFrame:
    """at (ast_id, path, ...) moved to the first child with that title; path is null where there is none."""
    kids = nodes.where(F.size("path") > 0).select(F.col("ast_id").alias("_a"), parent_of("path").alias("_p"), normal_title(F.col("section_title")).alias("_t"), F.col("path").alias("_c"))
    first = kids.groupBy("_a", "_p", "_t").agg(F.min("_c").alias("_c"))
    got = at.join(first, (F.col("ast_id") == F.col("_a")) & (F.col("path") == F.col("_p")) & (F.when(title.isNotNull(), normal_title(title)) == F.col("_t")), "left")
    return got.withColumn("path", F.col("_c")).drop("_a", "_p", "_t", "_c")


def resolve(nodes: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """wanted (ast_id, titles) with path: level by level the first equal title, without going back; blank titles and a leading title of the root don't count; null where a title is missing. depth: most titles in a row."""
    roots = nodes.where(F.size("path") == 0).select("ast_id", F.col("section_title").alias("_root"))
    some = F.filter("titles", lambda t: normal_title(t) != "")
    w = wanted.join(roots, "ast_id").withColumn("_left", some)
    w = w.withColumn("_left", F.when((F.size("_left") > 0) & same_title(F.get("_left", F.lit(0)), F.col("_root")), F.slice("_left", 2, F.greatest(F.size("_left") - 1, F.lit(0)))).otherwise(F.col("_left")))
    w = w.withColumn("path", root_path()).drop("_root")
    for k in range(depth):
        # Rows whose titles are used up stay where they are.
        w = step(nodes, w.withColumn("_was", F.when(F.size("_left") <= k, F.col("path"))), F.get("_left", F.lit(k)))
        w = w.withColumn("path", F.coalesce("_was", "path")).drop("_was")
    return w.drop("_left")


def ensure_paths(nodes: DataFrame, wanted: DataFrame, depth: int, summary: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes with what is missing, wanted with path and created), for many lists of titles a tree: wanted (ast_id, no, titles), in the order of no.

    Lists are merged into a trie a tree, level by level: equal titles under one node are one request, which
    takes the first child with that title, or makes one after the children that are there, in the order of
    first requests and with the first one's title. So nodes are what they would be if one list came after
    the other. Blank titles and a leading title of the root don't count; lists of unknown trees are left
    out. depth: most titles in a list. created: a node of the path was missing.
    """
    roots = nodes.where(F.size("path") == 0).select("ast_id", F.col("section_title").alias("_root"))
    w = wanted.join(roots, "ast_id").withColumn("_left", F.filter("titles", lambda t: normal_title(t) != ""))
    w = w.withColumn("_left", F.when((F.size("_left") > 0) & same_title(F.get("_left", F.lit(0)), F.col("_root")), F.slice("_left", 2, F.greatest(F.size("_left") - 1, F.lit(0)))).otherwise(F.col("_left"))).drop("_root")
    w = w.withColumns({"path": root_path(), "created": F.lit(False)})
    kids = nodes.where(F.size("path") > 0).select("ast_id", parent_of("path").alias("path"), normal_title(F.col("section_title")).alias("_t"), F.col("path").alias("_kid"))
    first = kids.groupBy("ast_id", "path", "_t").agg(F.min("_kid").alias("_kid"))
    number = kids.groupBy("ast_id", "path").agg(F.count("*").cast("int").alias("_n"))
    made = []
    for k in range(depth):
        raw = F.get("_left", F.lit(k))
        w = w.withColumn("_t", F.when(raw.isNotNull(), normal_title(raw)))
        asked = w.where("_t is not null").groupBy("ast_id", "path", "_t").agg(F.min_by(raw, "no").alias("_raw"), F.min("no").alias("_no"))
        asked = asked.join(first, ["ast_id", "path", "_t"], "left").join(number, ["ast_id", "path"], "left")
        missing = F.col("_kid").isNull()
        place = F.coalesce("_n", F.lit(0)) + F.count_if(missing).over(Window.partitionBy("ast_id", "path").orderBy("_no", "_t")).cast("int") - 1
        asked = asked.withColumn("_to", F.when(missing, F.array_append("path", place.cast("int"))).otherwise(F.col("_kid"))).withColumn("_made", missing)
        made.append(asked.where("_made").select("ast_id", F.col("_to").alias("path"), F.col("_raw").alias("section_title"), F.lit(summary).alias("content_summary")))
        w = w.join(asked.select("ast_id", "path", "_t", "_to", "_made"), ["ast_id", "path", "_t"], "left")
        w = w.withColumns({"path": F.coalesce("_to", "path"), "created": F.col("created") | F.coalesce("_made", F.lit(False))}).drop("_to", "_made", "_t")
    every = nodes.select(*NODE)
    for m in made:
        every = every.unionByName(m)
    return every, w.select(*wanted.columns, "path", "created")


def titles_of(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (ast_id, path) with the titles along the path, without the root's."""
    steps = wanted.select("ast_id", "path", F.posexplode_outer(F.when(F.size("path") > 0, F.sequence(F.lit(1), F.size("path")))).alias("_i", "_n"))
    steps = steps.withColumn("_p", F.when(F.col("_n").isNotNull(), F.slice("path", 1, F.coalesce("_n", F.lit(0)))))
    n = nodes.select(F.col("ast_id").alias("_a"), F.col("path").alias("_q"), F.coalesce("section_title", F.lit("")).alias("_t"))
    got = steps.join(n, (F.col("ast_id") == F.col("_a")) & (F.col("_p") == F.col("_q")), "left")
    return got.groupBy("ast_id", "path").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_t")))), lambda x: x["_t"]).alias("titles"))


def _edited(nodes: DataFrame, edits: DataFrame, **fields: str) -> DataFrame:
    """nodes with their tree's edit: _top (the node that it names) and the given fields, null without an edit. One exchange, by tree."""
    alone = F.when(F.count("*").over(Window.partitionBy("ast_id")) == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("more than one edit of tree "), "ast_id")).cast("array<int>"))
    e = edits.select(F.col("ast_id").alias("_id"), alone.alias("_top"), *[F.col(c).alias(f"_{k}") for k, c in fields.items()])
    j = nodes.join(e, F.col("ast_id") == F.col("_id"), "left")
    there = F.bool_or(F.coalesce(F.col("path") == F.col("_top"), F.lit(False))).over(Window.partitionBy("ast_id"))
    return j.withColumn("path", F.when(F.col("_id").isNull() | there, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no node at the path of the edit of tree "), "ast_id")).cast("array<int>")))


def _with_child(j: DataFrame, fresh: Column, position: Column) -> DataFrame:
    """j, less its edits, and for trees where `fresh` holds the child _title, _summary of the node _top at `position`; later siblings move on with all below them."""
    d = F.size("_top")
    moves = F.coalesce(fresh & (F.size("path") > d) & under(F.col("path"), F.col("_top")) & (F.get("path", d) >= position), F.lit(False))
    path = F.when(moves, F.transform("path", lambda x, i: F.when(i == d, x + 1).otherwise(x))).otherwise(F.col("path"))
    own = F.struct(path.alias("path"), "section_title", "content_summary")
    new = F.struct(F.array_append("_top", position).alias("path"), F.col("_title").alias("section_title"), F.col("_summary").alias("content_summary"))
    both = F.when(F.coalesce(fresh & (F.col("path") == F.col("_top")), F.lit(False)), F.array(own, new)).otherwise(F.array(own))
    return j.select("ast_id", F.explode(both).alias("n")).select("ast_id", "n.*")


def insert(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds a child to the node at path of edits (ast_id, path, position, section_title, content_summary); later siblings move on with all below them. position null: at the end; outside of 0 to the number of children: the job fails."""
    j = _edited(nodes, edits, pos="position", title="section_title", summary="content_summary")
    j = j.withColumn("_n", F.count_if(F.coalesce(child_of(F.col("path"), F.col("_top")), F.lit(False))).over(Window.partitionBy("ast_id")).cast("int"))
    position = F.coalesce(F.col("_pos").cast("int"), F.col("_n"))
    checked = F.when(F.col("_id").isNull() | position.between(0, F.col("_n")), position).otherwise(F.raise_error(F.lit("position out of range")).cast("int"))
    j = j.withColumn("_at", checked)
    return _with_child(j, F.col("_id").isNotNull(), F.col("_at"))


def update(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Sets title and summary of the node at path to those of edits that are not null."""
    j = _edited(nodes, edits, title="section_title", summary="content_summary")
    here = F.col("path") == F.col("_top")
    new = lambda c, e: F.coalesce(F.when(here, F.col(e)), F.col(c)).alias(c)
    return j.select("ast_id", "path", new("section_title", "_title"), new("content_summary", "_summary"))


def append_summary(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds append_text of edits (ast_id, path, append_text) to the summary of the node at path."""
    j = _edited(nodes, edits, text="append_text")
    here = (F.col("path") == F.col("_top")) & F.col("_text").isNotNull()
    new = F.when(here, joined_summary(F.col("content_summary"), F.col("_text"))).otherwise(F.col("content_summary"))
    return j.select("ast_id", "path", "section_title", new.alias("content_summary"))


def upsert(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds content_summary of edits (ast_id, path, section_title, content_summary) to the first child with an equal title, or a new child at the end."""
    j = _edited(nodes, edits, title="section_title", summary="content_summary")
    kid = F.coalesce(child_of(F.col("path"), F.col("_top")), F.lit(False))
    j = j.withColumns({"_n": F.count_if(kid).over(Window.partitionBy("ast_id")).cast("int"), "_old": F.min(F.when(kid & same_title(F.col("section_title"), F.col("_title")), F.col("path"))).over(Window.partitionBy("ast_id"))})
    new = F.when(F.col("path") == F.col("_old"), joined_summary(F.col("content_summary"), F.col("_summary"))).otherwise(F.col("content_summary"))
    j = j.withColumn("content_summary", new)
    return _with_child(j, F.col("_id").isNotNull() & F.col("_old").isNull(), F.col("_n"))


def nodes_from_json(trees: DataFrame) -> DataFrame:
    """Node table of trees (ast_id, json): nested nodes under "root"; a missing list of children is empty. A tree is one row, so it has to fit into a task."""

    def walk(name, node, path):
        kids = node.get("children") or []
        if not isinstance(kids, list):
            raise ValueError(f"{name}: children is not a list")
        yield name, path, node.get("section_title"), node.get("content_summary") or ""
        for i, kid in enumerate(kids):
            yield from walk(name, kid, [*path, i])

    def run(frames):
        for f in frames:
            rows = []
            for name, text in zip(f["ast_id"], f["json"]):
                root = json.loads(text).get("root")
                if not isinstance(root, dict):
                    raise ValueError(f"{name}: no root")
                rows += walk(name, root, [])
            yield pd.DataFrame(rows, columns=NODE)

    return trees.select("ast_id", "json").mapInPandas(run, SCHEMA)


def nested(rows) -> dict:
    """One tree's (or subtree's) nodes, as rows, as nested nodes."""
    made: dict[tuple, dict] = {}
    top = None
    for r in sorted(rows, key=lambda r: list(r["path"])):
        node = {"section_title": r["section_title"], "content_summary": r["content_summary"], "children": []}
        made[tuple(r["path"])] = node
        if top is None:
            top = node
        else:
            made[tuple(r["path"])[:-1]]["children"].append(node)
    return top or {}


META = "ast_id string, file_name string, rev long, updated_at string"


def meta_from_json(trees: DataFrame) -> DataFrame:
    """(ast_id, file_name, rev, updated_at) of trees (ast_id, json): revision 0 and no time where the text has none."""
    t = trees.select("ast_id", F.from_json("json", "file_name string, __meta__ struct<rev:long,updated_at:string>").alias("m"))
    return t.select("ast_id", "m.file_name", F.coalesce("m.__meta__.rev", F.lit(0)).cast("long").alias("rev"), "m.__meta__.updated_at")


def nodes_to_json(nodes: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(ast_id, json) of each tree; meta: (ast_id, file_name, rev, updated_at), which come before the root."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = {"root": nested(f.to_dict("records"))}
        if "_rev" in f:
            rev = f["_rev"].iloc[0]
            out = {"file_name": f["_file"].iloc[0], "__meta__": {"rev": 0 if pd.isna(rev) else int(rev), "updated_at": f["_time"].iloc[0]}} | out
        return pd.DataFrame({"ast_id": f["ast_id"].iloc[:1], "json": [json.dumps(out, ensure_ascii=False, indent=2)]})

    if meta is not None:
        nodes = nodes.join(meta.select("ast_id", F.col("file_name").alias("_file"), F.col("rev").alias("_rev"), F.col("updated_at").alias("_time")), "ast_id", "left")
    return nodes.groupBy("ast_id").applyInPandas(run, "ast_id string, json string")
