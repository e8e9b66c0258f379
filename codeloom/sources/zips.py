"""Uploaded archives by member: the directory at an archive's end is read first, then members are read by their place.

No worker holds an archive: listing reads its end, and each member is its own row from then on, dealt out evenly and read
by byte range.  ``expand_archives`` (``sources.files``) is the way for contents that are rows already, as in a stream.

Defined results: a member that cannot be read (encrypted, damaged, of unknown compression, larger than ``LARGEST``) keeps
its row without a source; a damaged archive has no members; an upload that is no archive is one file.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.exprs import module_path
from codeloom.operators.skew import lookup_join
from codeloom.session import cut
from codeloom.sources.tree import opened

#: Bytes of a member at most (one member is one cell).
LARGEST = 256 << 20
#: A member's header in an archive, and where it has the lengths of name and extra field.
HEADER, NAME_LENGTH, EXTRA_LENGTH = 30, 26, 28

_LISTED = "archive string, member string, at long, packed long, size long, method int, crc long"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for archive in batch.column("path").to_pylist():
            if not archive.endswith(".zip"):
                rows.append((archive, archive.rsplit("/", 1)[-1], -1, 0, 0, 0, 0))
                continue
            system, path = opened(archive)
            try:
                with system.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            method = -1 if i.flag_bits & 1 else i.compress_type  # the first bit: encrypted
                            rows.append((archive, i.filename, i.header_offset, i.compress_size, i.file_size, method, i.CRC))
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter: too short to be an archive
                continue
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = ("archive", "member", "at", "packed", "size", "method", "crc")
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _inside(file, row: dict) -> bytes | None:
    if row["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or row["size"] > LARGEST:
        return None
    file.seek(row["at"])
    head = file.read(HEADER)
    if len(head) < HEADER:
        return None
    file.seek(row["at"] + HEADER + int.from_bytes(head[NAME_LENGTH:EXTRA_LENGTH], "little") + int.from_bytes(head[EXTRA_LENGTH:HEADER], "little"))
    raw = file.read(row["packed"])
    try:
        content = raw if row["method"] == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(raw, row["size"] + 1)
    except zlib.error:
        return None
    return content if len(content) == row["size"] and zlib.crc32(content) == row["crc"] else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents by byte range, one output batch for each member."""
    for batch in batches:
        for row in batch.to_pylist():
            system, path = opened(row["archive"])
            with system.open_input_file(path) as file:
                content = file.read() if row["at"] < 0 else _inside(file, row)
            yield pa.RecordBatch.from_arrays([pa.array([row["archive"]]), pa.array([row["member"]]), pa.array([content], pa.binary())], ["archive", "member", "content"])


def list_members(spark: SparkSession, folder: str) -> DataFrame:
    """Files inside the archives of a folder (archive, member, place and sizes); no member is read."""
    uploads = spark.read.format("binaryFile").load(folder).select("path")
    return cut(uploads.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_list, _LISTED))


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Python files of all archives, one repository for each archive: as ``expand_archives``, read by member.

    Which folder is an archive's root, and which members are wanted, is known from the listing; only those are read.
    """
    listed = list_members(spark, folder)
    top = F.substring_index("member", "/", 1)
    roots = listed.where(top != "__MACOSX").groupBy("archive").agg(
        F.min(top).alias("_lo"), F.max(top).alias("_hi"), F.min(F.instr("member", "/")).alias("_deep")).select(
        "archive", F.when((F.col("_lo") == F.col("_hi")) & (F.col("_deep") > 0), F.col("_lo")).alias("_root"))
    inside = F.col("_root").isNull() | F.startswith(F.col("member"), F.concat("_root", F.lit("/")))
    wanted = lookup_join(listed, roots, ["archive"]).where(inside & F.col("member").endswith(".py"))
    # members are dealt out by themselves, so that a large archive is read by many tasks
    dealt = wanted.select("archive", "member", "at", "packed", "size", "method", "crc").repartition("archive", "member")
    contents = dealt.mapInArrow(_read, "archive string, member string, content binary")
    text = F.col("content").cast("string")
    rel = F.when(F.col("_root").isNull(), F.col("member")).otherwise(F.substring(F.col("member"), F.length("_root") + 2, F.length("member")))
    return lookup_join(contents, roots, ["archive"]).select(
        F.regexp_replace(F.substring_index("archive", "/", -1), r"\.[^.]*$", "").alias("repo_id"), F.concat_ws("!/", "archive", "member").alias("path"),
        rel.alias("relative_path"), module_path(rel).alias("module_path"), F.when(F.is_valid_utf8(text), text).alias("source"))


def write_archives(files: DataFrame, folder: str) -> int:
    """One zip for each repository of ``files(repo_id, relative_path, source)`` in ``folder``; returns their number.

    A repository is one archive and so one task's work.
    """
    def write(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        repo = key[0].as_py()
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{repo}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in rows.sort_by("relative_path").to_pylist():
                z.writestr(zipfile.ZipInfo(f"{repo}/{row['relative_path']}"), (row["source"] or "").encode(), zipfile.ZIP_DEFLATED)
        return pa.table({"repo_id": pa.array([repo], pa.string())})
    return files.select("repo_id", "relative_path", "source").groupBy("repo_id").applyInArrow(write, "repo_id string").count()
