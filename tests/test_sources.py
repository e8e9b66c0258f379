"""Files, archives, records and streams on a temporary folder."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.operators import generate as N
from codeloom.operators import verify as V
from codeloom.schemas import DOCUMENTATION
from codeloom.sources import commits as K
from codeloom.sources import files as S
from codeloom.sources import records as R
from codeloom.streaming import jobs as J


def put(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def zipped(tree):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in tree.items():
            z.writestr(name, text)
    return out.getvalue()


def test_scan(spark, tmp_path):
    put(tmp_path, {"one/a.py": "x = 1", "one/sub/b.py": "y", "one/tests/c.py": "z", "one/test_d.py": "z", "one/readme.md": "no", "two/Docs/e.py": "z",
                   "two/f_test.py": "z", "two/bad.py": b"\xff\xfe", "two/pkg/__init__.py": ""})
    got = {(r.repo_id, r.relative_path): (r.module_path, r.source) for r in S.scan_sources(spark, str(tmp_path)).collect()}
    assert got == {("one", "a.py"): ("a", "x = 1"), ("one", "sub/b.py"): ("sub.b", "y"), ("two", "bad.py"): ("bad", None), ("two", "pkg/__init__.py"): ("pkg.__init__", "")}
    whole = S.scan_sources(spark, str(tmp_path / "one"), repos="r", relevant=False)
    assert whole.count() == 4 and S.filter_relevant(whole).count() == 2
    assert S.filter_relevant(whole, exclude=[tmp_path.name.lower()], on="absolute").count() == 0
    inputs = {r.name: r.size for r in S.list_inputs(spark, str(tmp_path / "one")).collect()}
    assert inputs == {"a.py": 5, "test_d.py": 1, "readme.md": 2}


def test_archives(spark, tmp_path):
    put(tmp_path, {"single.zip": zipped({"top/a.py": "a", "top/p/b.py": "b", "__MACOSX/x.py": "m", "top/c.txt": "t"}), "flat.zip": zipped({"a.py": "1", "d/b.py": "2"}),
                   "lone.py": "alone", "broken.zip": b"PK no", "empty.zip": zipped({})})
    got = {(r.repo_id, r.relative_path): r.source for r in S.expand_archives(S.read_archives(spark, str(tmp_path))).collect()}
    assert got == {("single", "a.py"): "a", ("single", "p/b.py"): "b", ("flat", "a.py"): "1", ("flat", "d/b.py"): "2", ("lone", "lone.py"): "alone"}


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([("r", "m.f", "function", "m.py", "m.py", ["u"], "src"), ("s", "m.g", "function", "m.py", "m.py", [], "src")],
                                 "repo_id string, id string, component_type string, file_path string, relative_path string, used_by array<string>, source_code string")
    R.write_components(rows, str(tmp_path / "c"))
    back = {r.id: r for r in R.read_components(spark, str(tmp_path / "c")).collect()}
    assert back["m.f"].used_by == ["u"] and back["m.g"].depends_on == [] and not back["m.f"].has_docstring and "source_code" not in back["m.f"].asDict()
    table = str(tmp_path / "t")
    R.save_records(rows.select("repo_id", "id"), table)
    R.save_records(spark.createDataFrame([("r", "new1"), ("r", "new2")], "repo_id string, id string"), table)
    assert {(r.repo_id, r.id) for r in spark.read.parquet(table).collect()} == {("r", "new1"), ("r", "new2"), ("s", "m.g")}
    assert R.get_record(spark.read.parquet(table), "s").count() == 1
    put(tmp_path, {"g/rep.json": json.dumps({"a/b.f": ["x", "y"], "c": []})})
    assert {tuple(r) for r in R.read_callgraph(spark, str(tmp_path / "g")).collect()} == {("rep", "a/b.f", "x"), ("rep", "a/b.f", "y")}


def test_report_and_order(spark, tmp_path):
    summary = spark.createDataFrame([("r", "v", "m", 0.5)], "repo_id string, variant string, metric string, score double")
    R.write_report(summary, summary.withColumn("id", F.lit("c")), str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep/details")).where("metric = 'm' AND variant = 'v'").count() == 1
    edges = spark.createDataFrame([("r", "a", "b")], "repo_id string, src string, dst string")
    R.write_order(spark.createDataFrame([("r", "b", 1), ("r", "a", 2)], "repo_id string, id string, pos long"), edges, str(tmp_path / "o"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o/dependencies")).collect()] == [("r", "b", "a")]


def test_ingest_replaces_a_repository(spark, tmp_path):
    put(tmp_path, {"in/one.zip": zipped({"a.py": "def f(): pass", "b.py": "def g(): pass"}), "in/two.zip": zipped({"a.py": "def h(): pass"})})
    for _ in range(2):
        J.ingest_stream(J.stream_archives(spark, str(tmp_path / "in")), str(tmp_path / "facts"), str(tmp_path / "ck")).awaitTermination()
        put(tmp_path, {"in/later/x": b""})  # not part of the folder itself
    facts = K.read_records(spark, str(tmp_path / "facts")).where("fact = 'component'")
    assert sorted((r.repo_id, r.owner) for r in facts.collect()) == [("one", "a.f"), ("one", "b.g"), ("two", "a.h")]
    put(tmp_path, {"in2/one.zip": zipped({"a.py": "def new(): pass"})})
    J.ingest_stream(J.stream_archives(spark, str(tmp_path / "in2")), str(tmp_path / "facts"), str(tmp_path / "ck2")).awaitTermination()
    again = K.read_records(spark, str(tmp_path / "facts")).where("fact = 'component'")
    assert sorted((r.repo_id, r.owner) for r in again.collect()) == [("one", "a.new"), ("two", "a.h")]
    # an upload without any source empties its record
    put(tmp_path, {"in3/two.zip": zipped({"notes.txt": "x"})})
    J.ingest_stream(J.stream_archives(spark, str(tmp_path / "in3")), str(tmp_path / "facts"), str(tmp_path / "ck3")).awaitTermination()
    left = K.read_records(spark, str(tmp_path / "facts")).where("fact = 'component'")
    assert sorted((r.repo_id, r.owner) for r in left.collect()) == [("one", "a.new")]
    assert {r.repo_id: r.n_rows > 0 for r in K.manifest(spark, str(tmp_path / "facts")).collect()} == {"one": True, "two": False}


def test_commits(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "repo_id string, id string, n long"
    assert K.commits(spark, path) == [] and K.manifest(spark, path).count() == 0
    assert K.commit_records(spark.createDataFrame([("007", "a", 1), ("r", "b", 2), (None, "c", 3)], schema), path, batch="x") == 0
    first = K.read_records(spark, path)
    rows = lambda df: sorted((r.repo_id, r.id, r.n) for r in df.collect())
    # while the next version is written, and until its commit is made, readers see the one before
    half = spark.createDataFrame([("r", "new", 9)], schema)
    half.write.partitionBy("repo_id").parquet(f"{path}/data/version=half")
    K.manifest(spark, path).write.parquet(f"{path}/manifests/n=1")
    assert rows(K.read_records(spark, path)) == [("007", "a", 1), ("r", "b", 2)]
    assert K.commit_records(half, path, batch="y") == 1 and K.commit_records(half, path, batch="y") == 1 and K.commits(spark, path) == [0, 1]
    assert rows(K.read_records(spark, path)) == [("007", "a", 1), ("r", "new", 9)] and rows(first) == rows(K.read_records(spark, path, 0)) == [("007", "a", 1), ("r", "b", 2)]
    assert K.commit_records(half.limit(0), path, spark.createDataFrame([("r",)], "repo_id string")) == 2
    assert rows(K.read_records(spark, path)) == [("007", "a", 1)]
    assert "half" in K.vacuum(spark, path, keep=1) and rows(K.read_records(spark, path)) == [("007", "a", 1)]
    # two writers that saw the same last commit: the second one fails and changes nothing
    place, files = K._place(spark, f"{path}/commits/3")
    files.create(place, False).close()
    known, K.commits = K.commits, lambda *a: [0, 1, 2]
    try:
        with pytest.raises(Exception, match="already exists"):
            K.commit_records(half, path)
    finally:
        K.commits = known


def test_call_tags(spark):
    df = spark.createDataFrame([(["x", "WRITER"], None), (["x"], ["c"]), (None, ["a", "b"]), (None, []), ([], None)], "tags array<string>, chain_tags array<string>")
    assert [r.t for r in df.select(J.call_tag().alias("t")).collect()] == ["WRITER", "x", "b", "unknown", "unknown"]


def test_verdicts_and_state(spark):
    doc = ("s", None, None, None, None, None, None, None, None, None, None, None, "ex")
    docs = spark.createDataFrame([("r", "ok", doc), ("r", "none", None), ("r", "model", doc)], DOCUMENTATION_ROW)
    static = spark.createDataFrame([], "repo_id string, id string, rank int, subject string, text string")
    reports = spark.createDataFrame([("r", "ok", ([("a", True, "c")], "finished", "fine"), None), ("r", "model", None, "boom")], REPORT_ROW)
    got = {r.id: r for r in V.merge_findings(docs, static, reports).withColumn("text", V.feedback_text()).collect()}
    assert (got["ok"].needs_revision, got["ok"].step, got["ok"].text) == (False, "finished", "")
    assert got["none"].findings == [V.NO_DOCUMENT] and got["none"].step == "writer" and not got["none"].model_ok
    assert got["model"].findings == ["[LLM - ERROR]: Panggilan Verifier LLM gagal: boom"] and got["model"].text == "\n".join(V.FAILURE_LINES)
    state = N.final_state(docs.withColumns({"attempts": F.lit(1), "rejections": F.lit(0)}))
    text = {r.id: r.final_state.docstring for r in state.collect()}
    assert "examples" not in json.loads(text["ok"]) and json.loads(text["ok"])["short_summary"] == "s" and text["none"] == ""


def test_templates(spark):
    df = spark.createDataFrame([("class", "ctx {code}", "body {context}", None), ("method", "c", "b", "fix it")], "component_type string, context string, focal string, feedback string")
    got = [r.prompt for r in N.build_prompts(df, N.Templates()).collect()]
    assert got[0] == "Context: ctx {code}\n\nDocument this class.\n\nbody {context}\n" and got[1] == "fix it\n\nDocument this function.\n\nb\n"


def test_missing_verdict_is_a_rejection(spark):
    state = spark.createDataFrame([("r", "a", 0, 0, None)], "repo_id string, id string, attempts long, rejections long, feedback string")
    doc = F.struct(F.concat(F.lit("d"), F.col("rejections").cast("string")).alias("short_summary"))
    verdicts = "repo_id string, id string, needs_revision boolean, step string, next_feedback string"
    done = N.revise_rounds(state, lambda rows: rows.withColumn("doc", doc), lambda rows: spark.createDataFrame([], verdicts)).collect()
    assert [(r.rejections, r.doc.short_summary) for r in done] == [(2, "d2")]


DOCUMENTATION_ROW = __import__("pyspark.sql.types", fromlist=["StructType"]).StructType().add("repo_id", "string").add("id", "string").add("doc", DOCUMENTATION)
REPORT_ROW = "repo_id string, id string, report struct<critiques:array<struct<section:string,is_accurate:boolean,critique:string>>,suggested_next_step:string,suggestion_feedback:string>, error string"


class Stopped(Exception):
    pass


def test_a_stopped_run_goes_on_from_its_log(spark, tmp_path, monkeypatch):
    """Killed after the second call of a model: the next run asks for the rest only, with the same result."""
    from codeloom.operators import context as C
    asked = tmp_path / "asked"

    def counted(name, model):
        def call(prompts):
            with open(asked, "a") as f:
                f.writelines(f"{name}\n" for _ in prompts)
            return model(prompts)
        return call

    def need(prompts):
        return [json.dumps({"info_need": p.count("**Query:**") < 2, "internal_expand": [], "external_retrieval": [f"q{p.count('**Query:**')}"]}) for p in prompts]
    reader, searcher = counted("reader", need), counted("searcher", lambda ps: [f"answer to {p}" for p in ps])
    comps = spark.createDataFrame([("r", f"f{i}", "function", "code") for i in range(6)], "repo_id string, id string, component_type string, source_code string")
    none = spark.createDataFrame([], "repo_id string, id string, kind string, pos long, part_id string, type string, content string")
    state = comps.select("repo_id", "id", F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("feedback"))
    go = lambda log: N.gather_rounds(none, comps, state, reader, searcher, max_attempts=3, log=log)
    table = lambda made: (sorted(map(tuple, made[0].select(*C.PART_COLUMNS).collect())), sorted(map(tuple, made[1].collect()), key=str))
    whole = table(go(N.CallLog(spark, str(tmp_path / "whole"))))
    one_run = sorted(asked.read_text().split())
    assert one_run == ["reader"] * 18 + ["searcher"] * 12
    asked.unlink()
    left, real = [3], N.apply_model

    def stops(*args):
        left[0] -= 1
        if left[0] < 0:
            raise Stopped
        return real(*args)
    monkeypatch.setattr(N, "apply_model", stops)
    log = N.CallLog(spark, str(tmp_path / "log"))
    with pytest.raises(Stopped):
        go(log)
    paid = len(asked.read_text().split())
    assert paid == 18  # reader, searcher, reader
    monkeypatch.setattr(N, "apply_model", real)
    assert table(go(N.CallLog(spark, str(tmp_path / "log")))) == whole
    assert sorted(asked.read_text().split()) == one_run
    assert log.answers().count() == 30


def test_failed_calls_are_made_again(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a", "x"), ("r", "b", "boom")], "repo_id string, id string, prompt string")
    log = N.CallLog(spark, str(tmp_path / "log"))

    def fails(prompts):
        if "boom" in prompts:
            raise ValueError("no")
        return prompts
    assert {r.id: (r.response, r.error) for r in log.apply(rows, fails, "w").collect()} == {"a": ("x", None), "b": (None, "no")}
    assert {r.id: (r.response, r.error) for r in log.apply(rows, lambda ps: [p + "!" for p in ps], "w").collect()} == {"a": ("x", None), "b": ("boom!", None)}


def test_finished_levels_are_not_made_again(spark, tmp_path):
    order = spark.createDataFrame([("r", f"n{i}", i) for i in range(3)], "repo_id string, id string, level long")
    made = []

    def make(stop):
        def one(rows, docs):
            level = rows.first().level
            if level == stop:
                raise Stopped
            made.append(level)
            return rows.withColumn("docstring", F.lit(f"after {docs.count()}"))
        return one
    with pytest.raises(Stopped):
        N.generate_by_level(order, make(2), str(tmp_path / "docs"))
    got = {r.id: r.docstring for r in N.generate_by_level(order, make(None), str(tmp_path / "docs")).collect()}
    assert made == [0, 1, 2] and got == {"n0": "after 0", "n1": "after 1", "n2": "after 2"}
