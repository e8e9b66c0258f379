"""Record tables with a commit log: readers see whole versions, uploads replace whole records, repeats change nothing.

Below ``path``: ``data/version=<v>/repo_id=<r>`` holds what one commit wrote, ``manifests/n=<n>`` says which version of
each record is current after commit n, and ``commits/<n>`` is made last, by an operation that fails if it is there
already.  A commit that did not get that far has changed nothing for any reader; of two writers one fails and can try
again.  A record that was uploaded without rows is in the manifest with a version that has no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import cut

MANIFEST = "repo_id string, version string, batch string, n_rows long"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits, ascending."""
    place, files = _place(spark, f"{path}/commits")
    if not files.exists(place):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(place))


def manifest(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The current version of each record (repo_id, version, batch, n_rows) after commit ``at`` (None: the last)."""
    known = commits(spark, path)
    if at is not None and at not in known:
        raise ValueError(f"no commit {at}")
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/n={known[-1] if at is None else at}")


def commit_records(incoming: DataFrame, path: str, records: DataFrame | None = None, batch: str | None = None) -> int:
    """Replace the records at hand with ``incoming(repo_id, ...)``; returns the number of the commit.

    ``records(repo_id)`` names the records that are replaced, those without any row in ``incoming`` included (None:
    those of ``incoming``).  A ``batch`` that is in the log already is not written again.  Rows of records that are not
    at hand are left out.
    """
    spark = incoming.sparkSession
    known = commits(spark, path)
    if batch is not None and known:
        place, files = _place(spark, f"{path}/batches/{batch}")
        if files.exists(place):
            return known[-1]
    version = uuid.uuid4().hex
    at_hand = cut((incoming if records is None else records).select("repo_id").where("repo_id IS NOT NULL").distinct())
    rows = incoming.join(at_hand, "repo_id", "left_semi")
    rows.select(*incoming.columns).write.partitionBy("repo_id").parquet(f"{path}/data/version={version}")
    sizes = _version(spark, path, version, incoming).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_rows"))
    fresh = at_hand.join(sizes, "repo_id", "left").select("repo_id", F.lit(version).alias("version"), F.lit(batch).alias("batch"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    kept = manifest(spark, path).join(at_hand, "repo_id", "left_anti")
    n = (known[-1] if known else -1) + 1
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{path}/manifests/n={n}")
    place, files = _place(spark, f"{path}/commits/{n}")
    files.create(place, False).close()  # fails if another writer was faster
    if batch is not None:
        place, files = _place(spark, f"{path}/batches/{batch}")
        files.create(place, True).close()
    return n


def _version(spark: SparkSession, path: str, version: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).option("basePath", f"{path}/data/version={version}").parquet(f"{path}/data/version={version}")


def read_records(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The rows of all current records after commit ``at``.  The table read stays as it is while others commit."""
    current = cut(manifest(spark, path, at).where("n_rows > 0").select("version", "repo_id"))
    versions = [r["version"] for r in current.select("version").distinct().collect()]  # at most one for each commit
    if not versions:
        raise ValueError(f"no rows in {path}")
    paths, base = [f"{path}/data/version={v}" for v in versions], spark.read.option("basePath", f"{path}/data")
    # names of folders stay texts, also where they look like numbers
    shape = base.parquet(*paths).schema
    named = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("version", "repo_id") else f for f in shape.fields])
    rows = base.schema(named).parquet(*paths)
    return rows.join(current, ["version", "repo_id"], "left_semi").drop("version")


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Delete the versions that none of the last ``keep`` commits refers to; returns their names."""
    last = commits(spark, path)[-keep:]
    used = {r["version"] for n in last for r in manifest(spark, path, n).select("version").distinct().collect()}
    place, files = _place(spark, f"{path}/data")
    gone = []
    for status in files.listStatus(place) if last else []:
        name = status.getPath().getName().removeprefix("version=")
        if name not in used:
            files.delete(status.getPath(), True)
            gone.append(name)
    return gone
