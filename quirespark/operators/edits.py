"""Logs of edits: many edits a tree, in order, each on what the ones before it left.

Trees and their edits are dealt out by tree and sorted, nodes first; a task goes through them as a
stream and holds one tree and a batch of rows, however long a log is. Edits of one tree depend on each
other, as paths move with every insertion, so a tree is not divided; trees are.

A log has ast_id, edit_no and action, and of path, titles (arrays), position, section_title,
content_summary, append_text and create_missing what the action needs; other columns may be absent.
The node is named by titles if there are any (for an action by titles only so), else by path, where
null is the root. Actions: append_child, upsert_child, update_node, append_to_summary, ensure_path.
An edit that fails leaves the tree as it was and has an error; it never fails the job. Edits of equal
number go in the order of their other columns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {"path": "array<int>", "titles": "array<string>", "position": "int", "section_title": "string", "content_summary": "string", "append_text": "string", "create_missing": "boolean"}
ROWS = "ast_id string, edit_no long, path array<int>, section_title string, content_summary string, action string, ok boolean, op string, error string, rev long"
ARROW = pa.schema([("ast_id", pa.string()), ("edit_no", pa.int64()), ("path", pa.list_(pa.int32())), ("section_title", pa.string()), ("content_summary", pa.string()), ("action", pa.string()), ("ok", pa.bool_()), ("op", pa.string()), ("error", pa.string()), ("rev", pa.int64())])


def _title(t: str | None) -> str:
    return re.sub(r"\s+", " ", t or "").strip()


def _joined(old: str | None, new: str) -> str:
    return f"{old.rstrip()}\n{new.lstrip()}" if old else new


class Tree:
    """A tree as lists: title, summary, children."""

    def __init__(self):
        self.root = None

    def load(self, path: list[int], title: str | None, summary: str | None) -> None:
        """Adds a node; nodes come in the order of paths."""
        node = [title, summary, []]
        if path:
            self.at(path[:-1])[2].append(node)
        else:
            self.root = node

    def at(self, path: list[int]) -> list:
        node = self.root
        for i in path:
            if not 0 <= i < len(node[2]):
                raise ValueError(f"no node at {path}")
            node = node[2][i]
        return node

    def find(self, titles: list[str | None], make: bool = False, summary: str = "") -> tuple[list[int], bool]:
        """The path of titles, level by level the first equal one, and whether nodes were made."""
        left = [t for t in titles if t and t.strip()]
        if left and _title(left[0]) == _title(self.root[0]):
            left = left[1:]
        node, path, made = self.root, [], False
        for t in left:
            i = next((k for k, kid in enumerate(node[2]) if _title(kid[0]) == _title(t)), None)
            if i is None:
                if not make:
                    raise ValueError(f"no node titled {t}")
                i, made = len(node[2]), True
                node[2].append([t, summary, []])
            path.append(i)
            node = node[2][i]
        return path, made

    def apply(self, e: dict) -> tuple[str, list[int]]:
        """Carries out an edit: what was done, and where; ValueError if it can't be."""
        action, title, summary = e["action"], e["section_title"], e["content_summary"]
        if action == "ensure_path":
            if not e["titles"]:
                raise ValueError("titles are missing")
            path, made = self.find(e["titles"], bool(e["create_missing"]), summary or "")
            return "created" if made else "found", path
        needs = {"append_child": summary is not None, "upsert_child": bool(title) and summary is not None, "update_node": title is not None or summary is not None, "append_to_summary": e["append_text"] is not None}
        if action not in needs:
            raise ValueError(f"unknown action {action}")
        if not needs[action]:
            raise ValueError("title or text is missing")
        if e["titles"] is not None and not e["titles"]:
            raise ValueError("titles are missing")
        path = self.find(e["titles"])[0] if e["titles"] else list(e["path"] or [])
        node = self.at(path)
        if action == "append_child":
            n = len(node[2])
            i = n if e["position"] is None else e["position"]
            if not 0 <= i <= n:
                raise ValueError(f"position {i} is not in 0..{n}")
            node[2].insert(i, [title, summary, []])
            return "created", [*path, i]
        if action == "upsert_child":
            i = next((k for k, kid in enumerate(node[2]) if _title(kid[0]) == _title(title)), None)
            if i is None:
                node[2].append([title, summary, []])
                return "created", [*path, len(node[2]) - 1]
            node[2][i][1] = _joined(node[2][i][1], summary)
            return "appended", [*path, i]
        if action == "update_node":
            node[0], node[1] = node[0] if title is None else title, node[1] if summary is None else summary
            return "updated", path
        node[1] = _joined(node[1], e["append_text"])
        return "appended", path

    def nodes(self):
        """Paths, titles and summaries in the order of the text, without recursion."""
        left = [([], self.root)] if self.root else []
        while left:
            path, node = left.pop()
            yield path, node[0], node[1]
            left += [([*path, i], node[2][i]) for i in reversed(range(len(node[2])))]


def _run(batches):
    def rows():
        name, tree, rev, known = None, Tree(), 0, False
        for b in batches:
            for r in b.to_pylist():
                if not known or r["ast_id"] != name:
                    yield from ((name, None, p, t, s, None, None, None, None, rev) for p, t, s in tree.nodes())
                    name, tree, rev, known = r["ast_id"], Tree(), 0, True
                if r["edit_no"] is None and r["action"] is None:
                    tree.load(r["path"], r["section_title"], r["content_summary"])
                    continue
                try:
                    if tree.root is None:
                        raise ValueError("no such tree")
                    op, path = tree.apply(r)
                    rev += op != "found"
                    yield name, r["edit_no"], path, None, None, r["action"], True, op, None, rev
                except ValueError as e:
                    yield name, r["edit_no"], None, None, None, r["action"], False, None, str(e), rev
        yield from ((name, None, p, t, s, None, None, None, None, rev) for p, t, s in tree.nodes())

    held = []
    for row in rows():
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), ARROW)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), ARROW)], schema=ARROW)


def replay(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Trees after all edits, and an outcome an edit, in one table: see `nodes_after` and `outcomes`. rev: edits so far that changed the tree. Write it once if both are wanted."""
    had = set(log.columns)
    edits = log.select(F.col("ast_id").cast("string").alias("ast_id"), F.col("edit_no").cast("long").alias("edit_no"), F.coalesce("action", F.lit("")).alias("action"), *[(F.col(c) if c in had else F.lit(None)).cast(k).alias(c) for c, k in FIELDS.items()])
    own = nodes.select("ast_id", F.lit(None).cast("long").alias("edit_no"), F.lit(None).cast("string").alias("action"), "path", "section_title", "content_summary")
    both = own.unionByName(edits, allowMissingColumns=True).select("ast_id", "edit_no", "action", *FIELDS)
    order = [F.col("action").isNotNull(), "edit_no", "action", "path", "titles", "position", "section_title", "content_summary", "append_text"]
    return both.repartition("ast_id").sortWithinPartitions("ast_id", *order).mapInArrow(_run, ROWS)


def nodes_after(replayed: DataFrame) -> DataFrame:
    return replayed.where("action is null").select("ast_id", "path", "section_title", "content_summary")


def outcomes(replayed: DataFrame) -> DataFrame:
    """ast_id, edit_no, action, ok, op (created, appended, updated or found), path, error, rev: a row an edit."""
    return replayed.where("action is not null").select("ast_id", "edit_no", "action", "ok", "op", "path", "error", "rev")
