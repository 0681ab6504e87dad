"""A data source of one file a row: (name, text), for trees as JSON, matches of a document as JSON Lines and the like.

    spark.dataSource.register(DocumentFiles)
    spark.read.format("document_files").option("suffix", ".json").load(path)
    trees.write.format("document_files").option("suffix", ".json").mode("overwrite").save(path)

Reading: files are listed once, dealt out by size in groups of `group_bytes`, and read by tasks; a file
is one row. Writing: a task writes each file under a name of its own attempt and moves it into place, so
that a file is whole or not there, and a task that is run again writes the same. Of equal names one stays.
Mode overwrite deletes the folder's files with the suffix first. A job that fails deletes the files of its
finished tasks again, also where they took the place of others; one that succeeds leaves `_SUCCESS`.

Paths are what Arrow's file systems know by their scheme (file, hdfs, s3, gs and others). Names are
encoded as in URLs. Files whose name begins with _ or . are left out. A null name fails the job; a null
text is an empty file.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def _at(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Group(InputPartition):
    files: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _listed(path: str, suffix: str) -> list:
    where, base = _at(path)
    return [f for f in where.get_file_info(fs.FileSelector(base)) if f.is_file and f.base_name[0] not in "_." and f.base_name.endswith(suffix)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.most = options["path"], options.get("suffix", ""), int(options.get("group_bytes", 64 << 20))

    def partitions(self):
        groups, size = [[]], 0
        for f in sorted(_listed(self.path, self.suffix), key=lambda f: f.path):
            if groups[-1] and size + f.size > self.most:
                groups, size = [*groups, []], 0
            groups[-1].append(f.path)
            size += f.size
        return [Group(g) for g in groups if g] or [Group([])]

    def read(self, partition):
        where, _ = _at(self.path)
        for path in partition.files:
            with where.open_input_file(path) as f:
                name = unquote(path.rsplit("/", 1)[-1].removesuffix(self.suffix))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read().decode()])], ["name", "text"])


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        where, base = _at(self.path)
        where.create_dir(base, recursive=True)
        for f in _listed(self.path, self.suffix) if overwrite else []:
            where.delete_file(f.path)

    def write(self, iterator):
        where, base = _at(self.path)
        done = []
        for row in iterator:
            if row["name"] is None:
                raise ValueError("a file has to have a name")
            at = f"{base}/{quote(row['name'], safe='')}{self.suffix}"
            own = f"{base}/.{uuid.uuid4().hex}"
            with where.open_output_stream(own) as f:
                f.write((row["text"] or "").encode())
            where.move(own, at)
            done.append(at)
        return Written(done)

    def commit(self, messages):
        where, base = _at(self.path)
        with where.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages):
        where, _ = _at(self.path)
        for m in messages:
            for path in m.files if m else []:
                if where.get_file_info(path).is_file:
                    where.delete_file(path)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls):
        return "document_files"

    def schema(self):
        return "name string, text string"

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), overwrite)
