"""Session settings and lineage cuts.

Iterative operators (ranking, components, tracing, generation rounds) cut
their lineage with tables and checkpoints, so a lost executor costs one round
and not the whole loop.  The folder is the one the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the jobs of this package.  A cluster profile may
# override any of them; nothing below is needed for correctness.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call sites per Column: faster plan building
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: With it, Spark deletes what a finished execution has shuffled; else these files stay until the driver's JVM collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "codeloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A machine-local folder is only ever chosen in local mode, where driver and
    executors share one disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="codeloom-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@contextmanager
def moves_deleted(spark: SparkSession) -> Iterator[None]:
    """Nothing goes on from the shuffle files of what is written in here, so they are deleted with its end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and go on from that table.

    The table has no lineage and its true size.  (A checkpointed table keeps the
    size *estimate* of its plan; in a loop of joins these multiply from round to
    round until planning takes longer than running and nothing is ever small.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with moves_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def kept(df: DataFrame) -> DataFrame:
    """``df`` itself if ``cut`` wrote it, else the table ``cut`` makes of it."""
    return df if getattr(df, "_written_to", None) else cut(df)


def release(table: DataFrame) -> None:
    """Delete what ``cut`` wrote for a table that nothing reads any more (a finished round of a loop)."""
    path = getattr(table, "_written_to", None)
    if path:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lay_out(df: DataFrame, width: int, *cols: str) -> DataFrame:
    """Partition a table once by ``cols`` and checkpoint it; later joins on them do not move it again."""
    shared_folder(df.sparkSession)
    with moves_deleted(df.sparkSession):
        return df.repartition(width, *cols).checkpoint(eager=True)
