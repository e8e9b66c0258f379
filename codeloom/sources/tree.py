"""Source trees as a Spark data source: ``spark.read.format("codeloom_tree").load(root)``.

One row for each Python file: repo_id, path, relative_path, module_path, source.  Every folder below the root is one
repository, and so is a file directly in it (option ``repo``: the whole tree is that one).  The driver lists the root, tasks walk the folders of their
repositories; each folder is listed once, in the same pass that reads its files, and folders that are left out are never
listed at all.  Empty files have their row, one that is not valid UTF-8 a null source.

Pushed down: equality on ``repo_id`` prunes repositories, a beginning or equality of ``relative_path`` prunes folders.
Options: ``relevant`` (true: without tests and excluded folders), ``per_task`` (repositories of a task at least).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from codeloom.functions.exprs import module_path
from codeloom.sources.files import EXCLUDED_FOLDERS

NAME = "codeloom_tree"
SCHEMA = "repo_id string, path string, relative_path string, source string"
_SHAPE = pa.schema([(c, pa.string()) for c in ("repo_id", "path", "relative_path", "source")])
#: Tasks at most, and bytes of sources in one batch.
TASKS, BATCH = 10_000, 8 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder or file named the way Spark names it."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", uri)))


def left_out(name: str, is_folder: bool) -> bool:
    if is_folder:
        return name.lower() in EXCLUDED_FOLDERS
    return name.startswith("test_") or name.endswith("_test.py")


@dataclass
class Repositories(InputPartition):
    places: list[tuple[str, str, bool]]  # repository, its folder or file, whether it is a folder


class TreeReader(DataSourceReader):
    def __init__(self, root: str, options: dict):
        self.root, self.repo = root, options.get("repo")
        self.relevant = options.get("relevant", "true").lower() == "true"
        self.per_task = int(options.get("per_task", "1"))
        self.repos: set[str] | None = None
        self.begin = ""

    def pushFilters(self, filters):
        for f in filters:
            column, taken = getattr(f, "attribute", ()), False
            if column == ("repo_id",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repos = wanted if self.repos is None else self.repos & wanted
                taken = True
            elif column == ("relative_path",) and isinstance(f, EqualTo | StringStartsWith) and f.value is not None:
                self.begin = max(self.begin, f.value, key=len)
            if not taken:  # the beginning of a path only says which folders matter; Spark tests the rows
                yield f

    def partitions(self):
        system, path = opened(self.root)
        if self.repo is not None:
            found = [(self.repo, path, True)]
        else:
            found = sorted((i.base_name, i.path, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(path)))
            found = [r for r in found if (r[2] or r[0].endswith(".py")) and not (self.relevant and left_out(r[0], r[2]))]
        found = [r for r in found if self.repos is None or r[0] in self.repos]
        size = max(self.per_task, -(-len(found) // TASKS), 1)
        return [Repositories(found[at:at + size]) for at in range(0, len(found), size)] or [Repositories([])]

    def read(self, partition: Repositories) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        rows, held = [], 0
        for repo, place, is_folder in partition.places:
            for path, below in self._walk(system, place, "") if is_folder else [(place, repo)]:
                with system.open_input_stream(path) as stream:
                    content = stream.read()
                try:
                    source = content.decode("utf-8")
                except UnicodeDecodeError:
                    source = None
                rows.append((repo, path, below, source))
                held += len(content)
                if held > BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _walk(self, system: fs.FileSystem, folder: str, below: str) -> Iterator[tuple[str, str]]:
        for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name):
            here, is_folder = below + info.base_name, info.type == fs.FileType.Directory
            if (self.relevant and left_out(info.base_name, is_folder)) or not self._matters(here + "/" * is_folder):
                continue
            if is_folder:
                yield from self._walk(system, info.path, here + "/")
            elif info.base_name.endswith(".py"):
                yield info.path, here

    def _matters(self, path: str) -> bool:
        return path.startswith(self.begin) or (path.endswith("/") and self.begin.startswith(path))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*rows, strict=True)], schema=_SHAPE)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options)


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The files below ``root`` with their module paths; see the module's text for options."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
    rows = spark.read.format(NAME).options(**options).load(root)
    return rows.select("repo_id", "path", "relative_path", module_path(F.col("relative_path")).alias("module_path"), "source")


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``files(repo_id, relative_path, source)`` as files below ``root``; returns their number.

    Tasks write their own rows; a task that is run again writes the same files again.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            system, base = opened(root)
            for row in batch.to_pylist():
                path = f"{base}/{row['repo_id']}/{row['relative_path']}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write((row["source"] or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
    return files.select("repo_id", "relative_path", "source").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
