"""Structured Streaming jobs: task state, usage pairing and totals, corpus ingest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.exprs import AGENTS
from codeloom.operators.extract import extract_facts
from codeloom.sources.commits import commit_records
from codeloom.sources.files import expand_archives, filter_relevant

UNKNOWN = "unknown"  # fixed value: usage that cannot be attributed


# --- task state -------------------------------------------------------------

def latest_task_state(events: DataFrame) -> DataFrame:
    """Latest row per task; ``events(task_id, ts, seq, ...)``.  Works on streams (update mode) and tables alike."""
    rest = [c for c in events.columns if c != "task_id"]
    order = F.struct("ts", "seq")
    return events.groupBy("task_id").agg(F.max_by(F.struct(*rest), order).alias("_s")).select("task_id", "_s.*")


# --- usage ------------------------------------------------------------------

def call_tag(tags: str = "tags", chain_tags: str = "chain_tags"):
    """Agent of a call: a known agent among its own tags, else its first tag, else the innermost chain tag."""
    known = F.filter(F.col(tags), lambda t: F.lower(t).isin(*AGENTS))
    innermost = F.get(F.col(chain_tags), F.size(F.col(chain_tags)) - 1)
    return F.coalesce(F.get(known, F.lit(0)), F.get(F.col(tags), F.lit(0)), innermost, F.lit(UNKNOWN))


def pair_calls(starts: DataFrame, ends: DataFrame, delay: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """End-of-call events with the tag stored when the call started.

    ``starts(run_id, tags, ts)``, ``ends(run_id, component_id, chain_tags, ts,
    input_tokens, output_tokens, total_tokens)``.  State is kept for calls of
    up to ``longest``; an end without a start in that time falls back to its
    chain tags.  On streams unmatched ends appear once the watermark of both
    inputs has passed them.
    """
    s = starts.select("run_id", "tags", F.col("ts").cast("timestamp").alias("start_ts")).withWatermark("start_ts", delay).alias("s")
    e = ends.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).alias("e")
    joined = e.join(s, F.expr(f"e.run_id = s.run_id AND s.start_ts <= e.ts AND s.start_ts >= e.ts - INTERVAL {longest}"), "left_outer")
    return joined.select("e.run_id", "e.component_id", "e.ts", "e.input_tokens", "e.output_tokens", "e.total_tokens",
                         call_tag().alias("agent"))


def running_usage(calls: DataFrame, delay: str = "10 minutes", window: str | None = None) -> DataFrame:
    """Totals per component and agent (and event-time window), kept current as calls arrive."""
    keys = [F.col("component_id"), F.col("agent")]
    if window:
        keys = [F.window("ts", window).alias("window"), *keys]
    return calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("call_count"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"))


# --- sinks ------------------------------------------------------------------

def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write every micro-batch below ``path/batch=<n>``; a repeated batch replaces itself."""
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Of the rows written in update mode, the last one per key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")


# --- ingest -----------------------------------------------------------------

def stream_archives(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """New uploads in a folder as a stream of (path, content)."""
    return (spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch)
            .schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content"))


def archive_repo(path: str = "path") -> Column:
    """The repository an uploaded file stands for: its name without the ending."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def ingest_stream(incoming: DataFrame, out: str, checkpoint: str, to_files: Callable[[DataFrame], DataFrame] = expand_archives,
                  repo: Column | None = None) -> StreamingQuery:
    """Extract facts of new uploads and replace the records of their repositories.

    ``repo`` is the repository of an upload (default: by its path).  Every batch is one commit (see
    ``sources.commits``): an upload replaces its record as a whole, also by nothing, and a batch that is run again
    after a failure changes nothing.  ``read_records`` reads the result.
    """
    def upsert(batch: DataFrame, n: int) -> None:
        facts = extract_facts(filter_relevant(to_files(batch)))
        named = batch.select((archive_repo() if repo is None else repo).alias("repo_id"))
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.md5(checkpoint.encode()).hexdigest()
        commit_records(facts, out, named, f"{run}-{n}")
    return (incoming.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
