"""State that ends: resets, forgotten tasks, limited waits; restarts from the checkpoint."""

from datetime import datetime, timedelta

import pytest

from codeloom.streaming import jobs as J
from codeloom.streaming import state as S

EVENTS = "component_id string, ts timestamp, seq long, kind string, agent string, input_tokens long, output_tokens long, total_tokens long"
START = datetime(2024, 1, 1, 10)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Append rows to a folder that is read as a stream; run a job over what is new."""
    n = [0]

    def put(name, rows, schema):
        n[0] += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    def go(stream):
        S.run(spark, stream, lambda s: J.to_table(s, str(tmp_path / "out"), str(tmp_path / "ckpt"), "update"))

    def written():
        return spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=*"))
    return put, go, written


def test_totals_with_resets_go_on_after_a_restart(spark, feed):
    put, go, written = feed
    call = lambda c, t, agent, n: (c, at(t), 1, "call", agent, n, 1, n + 1)
    reset = lambda c, t: (c, at(t), 0, "reset", None, None, None, None)
    # out of order: the call of minute 2 comes after the reset of minute 3, and belongs before it
    first = [call("a", 1, "writer", 5), reset("a", 3), call("a", 4, "writer", 7), call("a", 2, "reader", 9), call("a", 3, None, 2), call("b", 1, "x", 1), (None, at(1), 1, "call", "x", 1, 1, 2)]
    stream = put("in", [*first, call("z", 60, "x", 1)], EVENTS)
    go(S.resetting_usage(stream))
    got = {(r.component_id, r.run, r.agent): (r.call_count, r.input_tokens) for r in S.current_totals(written()).collect()}
    assert got == {("a", 1, "writer"): (1, 7), ("a", 1, "unknown"): (1, 2), ("b", 0, "x"): (1, 1)}
    # a new query goes on with the totals in the checkpoint
    stream = put("in", [call("a", 70, "writer", 10), reset("b", 80), call("z", 200, "x", 1)], EVENTS)
    go(S.resetting_usage(stream))
    got = {(r.component_id, r.run, r.agent): (r.call_count, r.input_tokens) for r in S.current_totals(written()).collect()}
    assert got == {("a", 1, "writer"): (2, 17), ("a", 1, "unknown"): (1, 2), ("z", 0, "x"): (1, 1)}  # b was reset and has no totals


def test_ended_tasks_are_forgotten(spark, feed):
    put, go, written = feed
    schema = "task_id string, ts timestamp, seq long, status string, status_detail string"
    rows = [(f"t{i}", at(1), i, "completed" if i % 2 else "processing", "d") for i in range(40)] + [(None, at(1), 1, "x", "d")]
    stream = put("in", [*rows, ("t0", at(2), 100, "failed", "e"), ("t0", at(0), 101, "pending", "old"), ("late", at(30), 1, "processing", "")], schema)
    job = lambda s: S.expiring_task_state(s, keep="1 hour", delay="1 minute")
    go(job(stream))
    state = {r.task_id: r.status for r in J.current_rows(spark, written().inputFiles()[0].rsplit("/batch=", 1)[0], ["task_id"]).collect()}
    assert state == {f"t{i}": "failed" if i == 0 else "completed" if i % 2 else "processing" for i in range(40)} | {"late": "processing"}
    # two hours on, the 21 that had ended are gone from the state; the 19 others and the late ones are kept
    go(job(put("in", [("later", at(180), 1, "processing", "")], schema)))
    held = spark.read.format("statestore").option("stateVarName", "last").load(str(written().inputFiles()[0].rsplit("/out/", 1)[0]) + "/ckpt")
    kept = {r["key"][0] for r in held.collect()}
    assert kept == {f"t{i}" for i in range(2, 40, 2)} | {"late", "later"}


def test_ends_wait_for_their_start_and_no_longer(spark, feed, tmp_path):
    put, go, written = feed
    starts = "run_id long, tags array<string>, ts timestamp"
    ends = "run_id long, component_id string, chain_tags array<string>, ts timestamp, input_tokens long, output_tokens long, total_tokens long"
    end = lambda run, t, chain=(): (run, "c", list(chain), at(t), 1, 2, 3)
    job = lambda a, b: S.pair_calls_in_time(a, b, wait="20 minutes", longest="1 hour", delay="1 minute")
    a = put("starts", [(1, ["x", "Writer"], at(0)), (2, ["first"], at(0)), (5, ["early"], at(0))], starts)
    b = put("ends", [end(1, 5), end(3, 6, ["outer", "inner"]), end(4, 6), end(5, 90), end(9, 10)], ends)
    go(job(a, b))
    got = {r.run_id: (r.agent, r.matched) for r in written().collect()}
    # the watermark is at minute 89 now: the ends of 3, 4 and 9 have waited long enough; 5 is too far from its start and waits
    assert got == {1: ("Writer", True), 3: ("inner", False), 4: ("unknown", False), 9: ("unknown", False)}
    a = put("starts", [(7, ["t7"], at(100))], starts)
    b = put("ends", [end(7, 101), end(2, 102, ["lost"]), end(8, 300)], ends)
    go(job(a, b))
    got = {r.run_id: (r.agent, r.matched) for r in written().collect()}
    assert got == {1: ("Writer", True), 3: ("inner", False), 4: ("unknown", False), 9: ("unknown", False), 7: ("t7", True), 2: ("lost", False), 5: ("unknown", False)}


@pytest.mark.parametrize("groups", [1, 3])
def test_runs_of_one_group_keep_apart(spark, feed, groups):
    put, go, written = feed
    starts = "run_id long, tags array<string>, ts timestamp"
    ends = "run_id long, component_id string, chain_tags array<string>, ts timestamp, input_tokens long, output_tokens long, total_tokens long"
    end = lambda run, t: (run, f"c{run}", [f"e{run}"], at(t), run, 2, 3)
    job = lambda a, b: S.pair_calls_in_time(a, b, wait="20 minutes", longest="1 hour", delay="1 minute", groups=groups)
    a = put("starts", [(i, [f"s{i}"], at(i % 7)) for i in range(0, 200, 2)], starts)
    b = put("ends", [end(i, 8) for i in range(100)] + [end(999, 35)], ends)
    go(job(a, b))  # the watermark is at minute 34: the 50 ends without a start have waited long enough; 999 waits
    got = {r.run_id: (r.component_id, r.agent, r.matched, r.input_tokens) for r in written().collect()}
    assert got == {i: (f"c{i}", f"s{i}" if i % 2 == 0 else f"e{i}", i % 2 == 0, i) for i in range(100)}
    a = put("starts", [(1000, ["x"], at(50))], starts)
    b = put("ends", [end(i, 40) for i in range(100, 200)] + [end(2000, 500)], ends)  # starts of the first run are kept
    go(job(a, b))
    rows = written().collect()
    assert len(rows) == len({r.run_id for r in rows}) == 201 and {r.run_id for r in rows if r.matched} == set(range(0, 200, 2))
    held = spark.read.format("statestore").option("stateVarName", "ends").load(str(written().inputFiles()[0].rsplit("/out/", 1)[0]) + "/ckpt")
    assert held.count() <= groups  # before: one for each run
