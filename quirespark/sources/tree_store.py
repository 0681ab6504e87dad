"""Guarded edits of one document tree, each a new revision of its node table.

A revision is a Parquet folder rev-N, with the file's name and the time of the edit beside the nodes;
writing one that exists fails, so of two writers one loses.
Edits need a token, which is bound to purpose, node and revision, ends after ten minutes, and is
used up by success. Tokens live in the driver; `init` starts a new generation, which ends them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree

#: Seconds.
TOKEN_LIFE = 600


class TreeStore:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.clock, self.tokens = spark, path.rstrip("/"), clock, {}

    # storage

    def _folder(self) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _latest(self) -> tuple[int, int]:
        """Generation and revision."""
        fs, at = self._folder()
        found = [tuple(map(int, s.getPath().getName().removeprefix("rev-").split("-"))) for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName().startswith("rev-")]
        if not found:
            raise FileNotFoundError(self.path)
        return max(found)

    def _table(self) -> DataFrame:
        return self.spark.read.parquet("{}/rev-{}-{}".format(self.path, *self._latest()))

    def nodes(self) -> DataFrame:
        return self._table().select(tree.NODE)

    @property
    def rev(self) -> int:
        return self._latest()[1]

    def meta(self) -> dict:
        """file_name, rev, updated_at."""
        row = self._table().select("file_name", "updated_at").first()
        return {"file_name": row.file_name, "rev": self.rev, "updated_at": row.updated_at}

    def to_json(self) -> str:
        """The whole file: name, revision, time and nested nodes."""
        m = self.meta()
        one = self.spark.createDataFrame([("", m["file_name"], m["rev"], m["updated_at"])], tree.META)
        return tree.nodes_to_json(self.nodes(), one).first().json

    def _commit(self, nodes: DataFrame, generation: int, rev: int, file_name: str | None = None) -> dict:
        now = datetime.fromtimestamp(self.clock(), timezone.utc).isoformat()
        name = self.meta()["file_name"] if file_name is None else file_name
        nodes.select(*tree.NODE, F.lit(name).alias("file_name"), F.lit(now).alias("updated_at")).coalesce(1).write.mode("error").parquet(f"{self.path}/rev-{generation}-{rev}")  # one tree is one document
        return {"ok": True, "rev": rev, "updated_at": now}

    def _edit(self, **fields) -> DataFrame:
        return self.spark.createDataFrame([("", *fields.values())], "ast_id string, " + ", ".join(f"{k} {'array<int>' if k == 'path' else 'int' if k == 'position' else 'string'}" for k in fields))

    # reading

    def init(self, file_name: str, root_title: str | None = None, root_summary: str = "") -> dict:
        try:
            generation = self._latest()[0] + 1
        except FileNotFoundError:
            generation = 0
        return self._commit(self.spark.createDataFrame([("", [], root_title or file_name, root_summary)], tree.SCHEMA), generation, 0, file_name)

    def load(self, path: list[int] | None = None) -> dict:
        """The tree, or what is at and below path, as nested nodes."""
        self._node(path or [])
        return tree.nested(tree.subtree(self.nodes(), path or []).collect())

    def _node(self, path: list[int]) -> None:
        if any(i < 0 for i in path) or not tree.subtree(self.nodes(), path).take(1):
            raise ValueError(f"no node at {path}")

    def resolve_path(self, titles: list[str]) -> list[int]:
        wanted = self.spark.createDataFrame([("", titles)], "ast_id string, titles array<string>")
        got = tree.resolve(self.nodes(), wanted, len(titles)).first()
        if got is None or got.path is None:
            raise ValueError(f"no node {titles}")
        return list(got.path)

    def list_children(self, path: list[int] | None = None, titles: list[str] | None = None, include_children: bool = True) -> list[dict]:
        at = self.resolve_path(titles) if titles else path or []
        self._node(at)
        return [] if not include_children else [{"index": r["index"], "section_title": r.section_title} for r in tree.children(self.nodes(), at).orderBy("index").collect()]

    def find_by_title(self, query: str, ignore_case: bool = True, max_results: int = 20) -> list[dict]:
        found = tree.find_by_title(self.nodes(), query, ignore_case, max_results).orderBy("path").collect()
        return [{"path": list(r.path), "section_title": r.section_title} for r in found]

    def load_meta(self, purpose: str, path: list[int] | None = None, titles: list[str] | None = None, include_children: bool = True) -> dict:
        """A node's children, and a token for one edit of it."""
        if not purpose:
            raise ValueError("a purpose has to be given")
        at = self.resolve_path(titles) if titles else path or []
        children, meta = self.list_children(at, include_children=include_children), self.meta()
        token = uuid.uuid4().hex
        self.tokens[token] = (purpose, tuple(at), self._latest(), self.clock() + TOKEN_LIFE)
        return {"ok": True, "rev": meta["rev"], "updated_at": meta["updated_at"], "path": at, "children": children, "edit_token": token}

    # writing

    def _use(self, token: str, purpose: str, path: list[int]) -> tuple[int, int]:
        """Checks in this order: known, not ended, of this revision, purpose, node."""
        if token not in self.tokens:
            raise PermissionError("unknown edit token")
        its_purpose, its_path, its_rev, ends = self.tokens[token]
        now = self._latest()
        if self.clock() > ends:
            del self.tokens[token]
            raise PermissionError("edit token has ended")
        for ok, what in ((its_rev == now, "is of another revision"), (its_purpose == purpose, "is for another purpose"), (its_path == tuple(path), "is for another node")):
            if not ok:
                raise PermissionError(f"edit token {what}")
        del self.tokens[token]
        return now

    def _at(self, path, titles) -> list[int]:
        if titles is not None and not titles:
            raise ValueError("titles are empty")
        return self.resolve_path(titles) if titles else path or []

    def _write(self, purpose: str, token: str, path, titles, change: Callable[[DataFrame, list[int]], DataFrame]) -> dict:
        at = self._at(path, titles)
        self._node(at)
        generation, rev = self._use(token, purpose, at)
        return self._commit(change(self.nodes(), at), generation, rev + 1)

    def append_child(self, token: str, section_title: str | None, content_summary: str, path: list[int] | None = None, titles: list[str] | None = None, position: int | None = None) -> dict:
        def change(nodes, at):
            n = tree.children(nodes, at).count()
            if position is not None and not 0 <= position <= n:
                raise ValueError(f"position {position} is not in 0..{n}")
            return tree.insert(nodes, self._edit(path=at, position=position, section_title=section_title, content_summary=content_summary))

        return self._write("append_child", token, path, titles, change)

    def upsert_child(self, token: str, section_title: str, content_summary: str, path: list[int] | None = None, titles: list[str] | None = None) -> dict:
        return self._write("upsert_child", token, path, titles, lambda nodes, at: tree.upsert(nodes, self._edit(path=at, section_title=section_title, content_summary=content_summary)))

    def update_node(self, token: str, section_title: str | None = None, content_summary: str | None = None, path: list[int] | None = None, titles: list[str] | None = None) -> dict:
        if section_title is None and content_summary is None:
            raise ValueError("neither title nor summary is given")
        return self._write("update_node", token, path, titles, lambda nodes, at: tree.update(nodes, self._edit(path=at, section_title=section_title, content_summary=content_summary)))

    def append_to_summary(self, token: str, append_text: str, path: list[int] | None = None, titles: list[str] | None = None) -> dict:
        return self._write("append_to_summary", token, path, titles, lambda nodes, at: tree.append_summary(nodes, self._edit(path=at, append_text=append_text)))

    def ensure_path(self, token: str, titles: list[str], create_missing: bool = False, default_summary: str = "") -> dict:
        """The path of titles; missing nodes are made at the end of their parents if asked for, with the default summary, as one revision."""
        if not titles:
            raise ValueError("titles are empty")
        generation, rev = self._use(token, "ensure_path", [])
        nodes, made = self.nodes(), False
        at: list[int] = []
        for k in range(1, len(titles) + 1):
            wanted = self.spark.createDataFrame([("", titles[:k])], "ast_id string, titles array<string>")
            got = tree.resolve(nodes, wanted, k).first()
            if got.path is None:
                if not create_missing:
                    raise ValueError(f"no node {titles[:k]}")
                n = tree.children(nodes, at).count()
                nodes, made = tree.insert(nodes, self._edit(path=at, position=n, section_title=titles[k - 1], content_summary=default_summary)), True
                at = [*at, n]
            else:
                at = list(got.path)
        return {"path": at, "created": made} | (self._commit(nodes, generation, rev + 1) if made else {"ok": True, "rev": rev})

    # by name

    ACTIONS = ("init", "load", "resolve_path", "list_children", "load_meta", "find_by_title", "ensure_path", "append_child", "upsert_child", "update_node", "append_to_summary")

    def call(self, action: str, **arguments) -> dict:
        """An action by its name; what fails, an unknown action too, is a record with ok false and the error, and never raises."""
        if action not in self.ACTIONS:
            return {"ok": False, "error": f"unknown action: {action}"}
        try:
            got = getattr(self, action)(**arguments)
        except Exception as e:
            return {"ok": False, "error": str(e)}
        return got if isinstance(got, dict) and "ok" in got else {"ok": True, "result": got}
