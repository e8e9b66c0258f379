"""Reading source trees, archives and input folders."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.exprs import EXCLUDED_FOLDERS, _c, module_path
from codeloom.operators.skew import lookup_join
from codeloom.session import cut


def _plain(path: str) -> str:
    """A path or URI without its scheme and without a trailing slash."""
    head, sep, tail = path.partition(":/")
    return "/" + (tail if sep and "/" not in head else path).strip("/")


def _below(path: Column, root: str) -> Column:
    """The part of a file URI behind ``root``."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:/+", "/")
    return F.substring(plain, F.lit(len(_plain(root)) + 2), F.length(plain))


def is_relevant(path: Column | str, exclude: Sequence[str] = EXCLUDED_FOLDERS) -> Column:
    """Not a test file and not below one of the excluded folders."""
    p = _c(path)
    name = F.substring_index(p, "/", -1)
    return (
        ~F.arrays_overlap(F.split(F.lower(p), "/"), F.array(*[F.lit(e) for e in exclude]))
        & ~name.startswith("test_") & ~name.endswith("_test.py")
    )


def filter_relevant(files: DataFrame, exclude: Sequence[str] = EXCLUDED_FOLDERS,
                    on: str = "relative") -> DataFrame:
    """``on='absolute'`` tests the folders above the root as well."""
    return files.where(is_relevant("relative_path" if on == "relative" else "path", exclude))


def scan_sources(spark: SparkSession, root: str, repos: str | None = None, relevant: bool = True) -> DataFrame:
    """Every ``*.py`` below ``root``.

    ``repos=None`` treats each folder directly below the root as one repository;
    a name makes the whole tree that one repository.  Test and excluded paths
    are dropped by file metadata, so their contents are never read.  A file that
    is not valid UTF-8 keeps its row with a null source.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.py")
        .load(root)
    )
    below = _below(F.col("_metadata.file_path"), root)
    if relevant:
        raw = raw.where(is_relevant(below))
    text = F.col("content").cast("string")
    filled = raw.select("path", _below(F.col("path"), root).alias("_below"),
                        F.when(F.is_valid_utf8(text), text).alias("source"))
    empty = _empty_files(spark, root)
    if relevant:
        empty = empty.where(is_relevant("_below"))
    located = filled.unionByName(empty)
    if repos is None:
        repo, rel = F.substring_index("_below", "/", 1), F.regexp_replace("_below", r"^[^/]*/", "")
    else:
        repo, rel = F.lit(repos), F.col("_below")
    return located.select(repo.alias("repo_id"), "path", rel.alias("relative_path"),
                          module_path(rel).alias("module_path"), "source")


_ENTRY = pa.schema([("path", pa.string()), ("is_folder", pa.bool_())])


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subfolders and empty Python files directly in each folder."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", folder))
            system, path = fs.FileSystem.from_uri(uri)
            rows = [dict(path=f"{folder}/{i.base_name}", is_folder=not i.is_file)
                    for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True))
                    if not i.is_file or (i.size == 0 and i.extension == "py")]
            yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Empty files, which Spark's file sources leave out (an empty ``__init__.py`` still makes a package).

    Folders are listed in parallel tasks, one level of the tree per round.
    """
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(root)
    start = place.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(place).toString()
    folders, found = spark.createDataFrame([(start,)], "path string"), []
    while folders.take(1):
        listed = cut(folders.mapInArrow(_list_folders, "path string, is_folder boolean"))
        found.append(listed.where("NOT is_folder"))
        folders = listed.where("is_folder").select("path").repartition(sc.defaultParallelism)
    empty = found[0]
    for level in found[1:]:
        empty = empty.unionByName(level)
    return empty.select("path", _below(F.col("path"), root).alias("_below"), F.lit("").alias("source"))


_MEMBERS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files inside each archive, one output batch per file.

    A member that cannot be read (encrypted, damaged, of unknown compression) keeps its row without content, and so
    becomes a file without a source; a damaged archive has no members.
    """
    def row(archive: str, member: str, content: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(archive=archive, member=member, content=content)], schema=_MEMBERS)

    for batch in batches:
        for file in batch.to_pylist():
            archive, content = file["archive"], file["content"]
            if not archive.endswith(".zip"):
                yield row(archive, archive.rsplit("/", 1)[-1], content)
                continue
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        try:
                            inside = z.read(info)
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, zlib.error):
                            inside = None
                        yield row(archive, info.filename, inside)
            except zipfile.BadZipFile:
                continue


def expand_archives(archives: DataFrame) -> DataFrame:
    """``archives(path, content)`` -> files, one repository per archive.

    An upload that is no zip becomes one file.  If all members (without
    ``__MACOSX``) sit in one top folder, that folder is the root.
    """
    members = (
        archives.select(F.col("path").alias("archive"), "content")
        .mapInArrow(_members, "archive string, member string, content binary")
    )
    top = F.substring_index("member", "/", 1)
    roots = (
        members.where(top != "__MACOSX").groupBy("archive")
        .agg(F.min(top).alias("_lo"), F.max(top).alias("_hi"), F.min(F.instr("member", "/")).alias("_deep"))
        .select("archive", F.when((F.col("_lo") == F.col("_hi")) & (F.col("_deep") > 0), F.col("_lo")).alias("_root"))
    )
    text = F.col("content").cast("string")
    rel = F.when(F.col("_root").isNull(), F.col("member")).otherwise(
        F.substring(F.col("member"), F.length("_root") + 2, F.length("member")))
    inside = F.col("_root").isNull() | F.startswith(F.col("member"), F.concat("_root", F.lit("/")))
    return (
        lookup_join(members, roots, ["archive"])
        .where(inside & F.col("member").endswith(".py"))
        .select(
            F.regexp_replace(F.substring_index("archive", "/", -1), r"\.[^.]*$", "").alias("repo_id"),
            F.concat_ws("!/", "archive", "member").alias("path"),
            rel.alias("relative_path"), module_path(rel).alias("module_path"),
            F.when(F.is_valid_utf8(text), text).alias("source"),
        )
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Name and size of the files directly in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder)
    name = F.substring_index("path", "/", -1)
    return files.select(name.alias("id"), name.alias("name"), F.col("length").alias("size"))
