"""Stateful stream jobs with state that ends: totals that a reset clears, tasks that are forgotten, waits with a limit.

All three keep event-time timers, so what is kept does not grow with the keys ever seen.  They need Spark's RocksDB state
store, which ``stateful`` names for the query at hand where the session has no setting of its own.

Defined results: rows without a key or a time are left out.  Equal times are ordered by ``seq``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codeloom.functions.exprs import AGENTS

UNKNOWN = "unknown"  # fixed value: usage that cannot be attributed
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of runs that share their state; with some thousand open runs each, hundreds of MB stay out of any one task.
GROUPS = 4096
COUNTED = ["call_count", "input_tokens", "output_tokens", "total_tokens"]


@contextmanager
def stateful(spark: SparkSession):
    """While a query of this module is started: the state store it needs, unless the session names one."""
    before = spark.conf.get(PROVIDER, None)
    named = before is not None and "HDFSBacked" not in before
    if not named:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if not named:
            spark.conf.unset(PROVIDER)


def _millis(seconds_or_text: str) -> int:
    return int(pd.Timedelta(seconds_or_text) / pd.Timedelta(milliseconds=1))


def _all(rows: Iterator[pd.DataFrame]) -> list[dict]:
    return [r for part in rows for r in part.to_dict("records")]


def _frame(rows: Sequence[dict], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in schema.names] for r in rows], columns=schema.names).astype(
        {f.name: "Int64" for f in schema.fields if isinstance(f.dataType, T.LongType)})


# --- totals with reset ------------------------------------------------------

TOTALS = T.StructType([T.StructField("component_id", T.StringType()), T.StructField("run", T.LongType()), T.StructField("agent", T.StringType()),
                       *[T.StructField(c, T.LongType()) for c in COUNTED]])
_EVENT = T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()),
                       T.StructField("agent", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTED[1:]]])


class Totals(StatefulProcessor):
    """Totals per agent since the last reset of a component.

    Events wait in the state until the watermark has passed them, and are then counted in the order of their times, so
    that a reset parts what came before it from what came after however the rows arrived.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", T.StructType([T.StructField("run", T.LongType())]))
        self.waiting = handle.getListState("waiting", _EVENT)
        self.totals = handle.getMapState("totals", T.StructType([T.StructField("agent", T.StringType())]),
                                         T.StructType([T.StructField(c, T.LongType()) for c in COUNTED]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(r[n] for n in _EVENT.names) for r in _all(rows)]
        self._wake(min(e[0] for e in fresh))
        self.waiting.appendList(fresh)
        return iter(())

    def _wake(self, at: int) -> None:
        """One timer for each component: the earliest event that waits."""
        known = list(self.handle.listTimers())
        if not known or at < min(known):
            for timer in known:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = [tuple(e) for e in self.waiting.get()]
        due = sorted((e for e in waiting if e[0] <= now), key=lambda e: (e[0], e[1]))
        later = [e for e in waiting if e[0] > now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(e[0] for e in later))
        else:
            self.waiting.clear()
        if not due:
            return
        run = self.run.get()[0] if self.run.exists() else 0
        out: dict[str | None, dict] = {}
        for _, _, kind, agent, *tokens in due:
            if kind == "reset":
                run += 1
                self.totals.clear()
                out = {None: {"agent": None, **dict.fromkeys(COUNTED, 0)}}
                continue
            agent = agent or UNKNOWN
            have = tuple(self.totals.getValue((agent,))) if self.totals.containsKey((agent,)) else (0, 0, 0, 0)
            have = tuple(int(x) + int(y or 0) for x, y in zip(have, (1, *tokens), strict=True))
            self.totals.updateValue((agent,), have)
            out[agent] = {"agent": agent, **dict(zip(COUNTED, have, strict=True))}
        self.run.update((run,))
        yield _frame([{"component_id": key[0], "run": run, **r} for r in out.values()], TOTALS)

    def close(self) -> None:
        pass


def resetting_usage(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``events(component_id, ts, seq, kind, agent, input_tokens, output_tokens, total_tokens)``, kind ``call`` or ``reset``.

    Rows as the totals change: component_id, run (the number of resets before), agent and the totals; a reset alone
    gives a row without an agent.  ``current_totals`` reads the state from them.
    """
    shaped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where("component_id IS NOT NULL AND ts IS NOT NULL")
    shaped = shaped.select("component_id", "ts", F.unix_millis("ts").alias("at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "kind", "agent",
                           *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTED[1:]])
    return shaped.groupBy("component_id").transformWithStateInPandas(Totals(), TOTALS, "Update", "EventTime")


def current_totals(written: DataFrame) -> DataFrame:
    """Of the rows that ``resetting_usage`` wrote (with their ``batch``): the totals of every component's last run."""
    last = written.groupBy("component_id").agg(F.max("run").alias("run"))
    rows = written.join(last, ["component_id", "run"]).where("agent IS NOT NULL")
    return rows.groupBy("component_id", "run", "agent").agg(F.max_by(F.struct(*COUNTED), F.struct("batch", "call_count")).alias("_t")).select(
        "component_id", "run", "agent", "_t.*")


# --- tasks that are forgotten -----------------------------------------------

class LatestTask(StatefulProcessor):
    """The latest event of a task; once that says it has ended, the task is forgotten ``keep_ms`` later."""

    def __init__(self, schema: T.StructType, ended: Sequence[str], keep_ms: int):
        self.schema, self.ended, self.keep_ms = schema, tuple(ended), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField(n, T.LongType()) for n in ("at", "seq", "timer")]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else (None, None, None)
        newest = max(_all(rows), key=lambda r: (r["at"], r["seq"]))
        order = (int(newest["at"]), int(newest["seq"]))
        if before[0] is not None and order <= before[:2]:
            return
        if before[2] is not None:
            self.handle.deleteTimer(before[2])
        timer = order[0] + self.keep_ms if newest["status"] in self.ended else None
        if timer is not None:
            timer = max(timer, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.last.update((*order, timer))
        yield _frame([newest], self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_task_state(events: DataFrame, keep: str = "7 days", delay: str = "10 minutes", ended: Sequence[str] = ("completed", "failed")) -> DataFrame:
    """Latest row of each task as it changes; ``events(task_id, ts, seq, status, status_detail)``.

    A task whose last status is one of ``ended`` leaves the state when the watermark is ``keep`` past it; the rows
    already written stay.  Events later than the watermark are dropped, so a forgotten task does not come back by one.
    """
    schema = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()),
                           T.StructField("status", T.StringType()), T.StructField("status_detail", T.StringType())])
    shaped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where("task_id IS NOT NULL AND ts IS NOT NULL")
    shaped = shaped.select(F.col("task_id").cast("string").alias("task_id"), "ts", F.unix_millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "status", "status_detail")
    return shaped.groupBy("task_id").transformWithStateInPandas(LatestTask(schema, ended, _millis(keep)), schema, "Update", "EventTime")


# --- calls with a limited wait ----------------------------------------------

CALLS = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("component_id", T.StringType()), T.StructField("agent", T.StringType()),
                      T.StructField("matched", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in COUNTED[1:]]])


class Pairing(StatefulProcessor):
    """An end of a call meets its start; one that has waited ``wait_ms`` for it goes out without.

    A key is a group of runs: their rows come and go together, so the state is read and written once for a batch of a
    group and not once for each run.
    """

    def __init__(self, wait_ms: int, longest_ms: int):
        self.wait_ms, self.longest_ms = wait_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long, text = T.LongType(), T.StringType()
        self.starts = handle.getListState("starts", T.StructType([T.StructField("run_id", long), T.StructField("at", long), T.StructField("tag", text), T.StructField("until", long)]))
        self.ends = handle.getListState("ends", T.StructType([T.StructField("run_id", long), T.StructField("at", long), T.StructField("until", long), T.StructField("component_id", text),
                                                              T.StructField("chain_tag", text), *[T.StructField(c, long) for c in COUNTED[1:]]]))

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        names = ["run_id", "component_id", "agent", "matched", *COUNTED[1:]]
        return _frame([dict(zip(names, (r[0], r[1], r[2] or UNKNOWN, *r[3:]), strict=True)) for r in rows], CALLS)

    def _keep(self, state, had: bool, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif had:
            state.clear()

    def _wake(self, starts: dict[int, tuple], ends: list[tuple]) -> None:
        """One timer for the group, at the first time that something of it ends."""
        first = min([s[2] for s in starts.values()] + [e[2] for e in ends], default=None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first is not None:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every, now = _all(rows), timerValues.getCurrentWatermarkInMs()
        starts = {s[0]: tuple(s[1:]) for s in self.starts.get()}
        waiting = [tuple(e) for e in self.ends.get()]
        had, fresh = bool(starts), []
        for r in every:
            run, at = int(r["run_id"]), int(r["at"])
            if r["side"] == "start":
                starts[run] = (at, r["tag"], max(at + self.longest_ms, now) + 1)
            else:
                fresh.append((run, at, max(at + self.wait_ms, now + 1), r["component_id"], r["chain_tag"], *[int(r[c]) for c in COUNTED[1:]]))
        out, left = [], []
        for e in waiting + fresh:
            start = starts.get(e[0])
            if start and start[0] <= e[1] <= start[0] + self.longest_ms:
                out.append((e[0], e[3], start[1] or e[4], True, *e[5:]))
            else:
                left.append(e)
        self._keep(self.starts, had, [(run, *s) for run, s in starts.items()])
        self._keep(self.ends, bool(waiting), left)
        self._wake(starts, left)
        if out:
            yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        now = max(now, timerValues.getCurrentWatermarkInMs())  # all that has ended by now, not only the first
        starts = {s[0]: tuple(s[1:]) for s in self.starts.get()}
        waiting = [tuple(e) for e in self.ends.get()]
        kept, left = {run: s for run, s in starts.items() if s[2] > now}, [e for e in waiting if e[2] > now]
        self._keep(self.starts, bool(starts), [(run, *s) for run, s in kept.items()])
        self._keep(self.ends, bool(waiting), left)
        self._wake(kept, left)
        due = [(e[0], e[3], e[4], False, *e[5:]) for e in waiting if e[2] <= now]
        if due:
            yield self._out(due)

    def close(self) -> None:
        pass


def pair_calls_in_time(starts: DataFrame, ends: DataFrame, wait: str = "30 minutes", longest: str = "1 hour", delay: str = "10 minutes",
                       groups: int = GROUPS) -> DataFrame:
    """Ends of calls with the agent of their start: run_id, component_id, agent, matched and tokens.

    ``starts(run_id, tags, ts)``, ``ends(run_id, component_id, chain_tags, ts, input_tokens, output_tokens,
    total_tokens)``.  A matched end goes out in the batch that sees both; an end without a start goes out with its chain
    tag when the watermark is ``wait`` past it.  A start is kept for calls of up to ``longest``.  Runs are dealt into
    ``groups`` by a hash; a group's open runs are in one task's memory at a time.  The number is fixed with the
    checkpoint: choose it by the runs that are open at once.
    """
    known = F.filter("tags", lambda t: F.lower(t).isin(*AGENTS))
    tag = F.coalesce(F.get(known, F.lit(0)), F.get("tags", F.lit(0)))
    innermost = F.get("chain_tags", F.size("chain_tags") - 1)
    null, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    one = starts.select(F.col("run_id").cast("long").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("start").alias("side"), tag.alias("tag"),
                        null.alias("component_id"), null.alias("chain_tag"), *[zero.alias(c) for c in COUNTED[1:]])
    two = ends.select(F.col("run_id").cast("long").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("end").alias("side"), null.alias("tag"),
                      F.col("component_id").cast("string").alias("component_id"), innermost.alias("chain_tag"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTED[1:]])
    every = one.unionByName(two).withWatermark("ts", delay).where("run_id IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_millis("ts"))
    every = every.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(groups)))
    return every.groupBy("part").transformWithStateInPandas(Pairing(_millis(wait), _millis(longest)), CALLS, "Update", "EventTime")


def run(spark: SparkSession, stream: DataFrame, write: Callable[[DataFrame], object]) -> None:
    """Start a stream of this module by ``write`` and wait for its end."""
    with stateful(spark):
        query = write(stream)
        query.awaitTermination()
