"""Parsing of responses, docstrings and reports on hand-made rows."""

import textwrap

import pytest
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.functions import metrics as M
from codeloom.functions import tokens as K
from codeloom.operators import documents as D
from codeloom.operators import helpfulness as H
from codeloom.operators import resolve as R
from codeloom.operators import truthfulness as T
from codeloom.operators import usage as U
from codeloom.schemas import DOCUMENTATION


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("response, document, want", [
    ('<python_list>["A", \'b_c\',]</python_list>', "", ["A", "b_c"]),
    ('x <python_list>\n["A",\n "B"]\n</python_list>', "", ["A", "B"]),
    ('<python_list>["A", oops "B"]</python_list>', "", ["A", "B"]),
    ("<python_list>[]</python_list>", "`kept`", []),
    ('<python_list>"A"</python_list> then ["C"]', "", ["C"]),
    ('no tag ["x.y"] and ["z"]', "", ["x.y"]),
    ("nothing", "uses `run` and `(odd` and `call()` and `a b`", ["run", "a b"]),
    ('["it\\"s"]', "", ['it"s']),
])
def test_mentions(spark, response, document, want):
    df = spark.createDataFrame([("r", "c", response, document)], "repo_id string, component_id string, response string, document string")
    assert df.select(T.mention_list("response", "document").alias("m")).first().m == want


@pytest.mark.parametrize("text, summary, parameters, description", [
    ("<skor>4</skor>", 4, 4, 3), ("<skor>2</skor><skor>3</skor>", 3, 3, 3), ("<skor>9</skor> skor = 1", 1, 1, 3), ("Level 2", 2, 3, 3),
    ("5 / 5", 5, 5, 3), ("none", 3, 3, 3), ("Keseluruhan: [4.7]", 3, 3, 4), ("keseluruhan: 9", 3, 3, 9), ("SKOR: 0", 3, 3, 3),
])
def test_ratings(spark, text, summary, parameters, description):
    assert [one(spark, text, lambda c, m=m: H.parse_rating(c, m)) for m in ("summary", "parameters", "description")] == [summary, parameters, description]


def test_suggestions(spark):
    assert one(spark, "<saran> do\nit </saran>", lambda c: H.parse_suggestion(c, "summary")) == "do\nit"
    assert one(spark, "Good. Sebaiknya add more! Fine", lambda c: H.parse_suggestion(c, "summary")) == "Sebaiknya add more."
    assert one(spark, "saran\nnext line\nx", lambda c: H.parse_suggestion(c, "parameters")) == "next line"
    assert one(spark, "plain", lambda c: H.parse_suggestion(c, "parameters")) == H.DEFAULT_SUGGESTION["parameters"]
    assert one(spark, "Saran: a b\n\nrest", lambda c: H.parse_suggestion(c, "description")) == "a b"


def test_has_parameters(spark):
    params = spark.createDataFrame([("r", "a", "self", "positional", 0), ("r", "b", "self", "positional", 0), ("r", "b", "x", "positional", 1),
                                    ("r", "c", "cls", "keyword_only", 0), ("r", "d", "p", "positional_only", 0), ("r", "d", "self", "positional", 1)],
                                   "repo_id string, component_id string, name string, kind string, position int")
    comps = spark.createDataFrame([("r", i) for i in "abcde"], "repo_id string, id string")
    assert {r.id for r in H.has_parameters(comps, params).collect()} == {"b", "c", "d"}


def test_docstring(spark):
    long = "word " * 40
    doc = ("Short.", None, [("x", "int", long, None), ("y", "", "", None)], None, [("", "Only text.")], None, [("v", "int", "d", None)],
           [("ValueError", "bad")], [], "", None, "Some notes.", ">>> f()")
    df = spark.createDataFrame([("r", "c", doc)], __import__("pyspark.sql.types", fromlist=["StructType"]).StructType().add("repo_id", "string").add("id", "string").add("doc", DOCUMENTATION))
    filled = textwrap.indent(textwrap.fill(long, width=75), "    ")
    want = "\n".join(["Short.", "", "Parameters", "-" * 10, "x : int", filled, "y", "", "Returns", "-------", "Only text.", "", "Receives", "--------", "v : int",
                      "    d", "", "Raises", "------", "ValueError : bad", "", "Notes", "-----", "Some notes.", "", "Examples", "--------", ">>> f()"])
    assert D.render_docstring(df).first().docstring == want
    text = {r.section: r.text for r in D.doc_sections(
        spark.createDataFrame([("r", "c", "function", "m.py", "def c():", "")], "repo_id string, id string, component_type string, relative_path string, signature string, graph_url string"),
        df, "xx", "text").collect()}
    assert text["Raises"] == "**ValueError**\n    bad" and "Attributes" not in text and text["Notes"] == "Some notes."


def test_legacy_returns(spark):
    schema = "struct<returns:array<struct<type:string,description:string>>>"
    for value in ('{"returns": {"type": "int", "description": "d"}}', '{"returns": [{"type": "int", "description": "d"}]}'):
        got = one(spark, value, lambda c: D.legacy_returns(c, schema))
        assert [tuple(r) for r in got.returns] == [("int", "d")]


def test_small_expressions(spark):
    assert one(spark, 2.5, X.round_half_up, "double") == 3 and one(spark, 3.49, X.round_half_up, "double") == 3
    assert one(spark, 90061.0, X.fmt_elapsed, "double") == "1 day, 1:01:01"
    assert one(spark, "a.b.C.f", lambda c: X.path_mismatch(c, F.lit("x.a.z.b.D.g"), F.lit("method"))) == 0
    assert one(spark, "b.a.f", lambda c: X.path_mismatch(c, F.lit("a.b.g"), F.lit("function"))) == 1
    assert one(spark, " a b$.yml", X.sanitize_name) == "a_b.yml"
    assert [one(spark, v, X.is_safe_name) for v in ("a.py", "", "..", "a/b", None)] == [True, False, False, False, False]
    assert one(spark, "one\r\ntwo\nthree", lambda c: X.line_slice(c, F.lit(2), F.lit(9))) == "two\nthree"


def test_tokenizers(spark):
    assert one(spark, "a b, c", lambda c: K.token_count(c, K.REGEX)) == 4
    assert one(spark, "  a  b, c", lambda c: K.truncate_tokens(c, 3, K.REGEX)) == "  a  b,"

    class Codec:
        def encode(self, text):
            return list(text)

        def decode(self, items):
            return "".join(items)
    letters = K.from_codec("letters", Codec)
    assert one(spark, "abcd", lambda c: K.token_count(c, letters)) == 4 and one(spark, "abcd", lambda c: K.truncate_tokens(c, 2, letters)) == "ab"
    former = K.set_tokenizer(letters)
    try:
        assert K.get_tokenizer() is letters
    finally:
        K.set_tokenizer(former)


def test_metric_registry(spark):
    M.register_metric("length", "share of ten letters", lambda: F.least(F.length("v") / 10.0, F.lit(1.0)))
    M.register_metric("broken", "out of range", lambda: F.length("v") * 1.0)
    df = spark.createDataFrame([("abc",), ("",)], "v string")
    assert sorted(r.score for r in M.evaluate(df, "length").collect()) == [0.0, 0.3]
    with pytest.raises(Exception, match="score"):
        M.evaluate(df, "broken").collect()
    assert M.out_of_range(M.evaluate(df, "broken", check=False)).count() == 1
    with pytest.raises(KeyError):
        M.evaluate(df, "unknown")


def test_usage_of_unnamed_agents(spark):
    rows = [("r", "c", "writer", 1, 1, 1, 2), ("r", "c", "Writer", 1, 100, 100, 200), ("r", "d", "unknown", 1, 7, 7, 14), ("r", "d", None, 1, 1, 0, 1)]
    usage = spark.createDataFrame(rows, "repo_id string, component_id string, agent string, call_count long, input_tokens long, output_tokens long, total_tokens long")
    got = {r.agent: r.total_tokens for r in U.usage_rollup(usage).collect()}
    assert got == {"reader": 0, "searcher": 0, "verifier": 0, "writer": 202, "other": 15, "total": 217}
    assert {r.component_id: r.total_token for r in U.usage_by_component(usage).collect()} == {"c": 202, "d": 15}
    cost = {r.agent: r.input_tokens for r in U.usage_cost(usage, U.default_prices(spark)).collect()}
    assert cost["total"] == 109 and cost["other"] == 8


def test_export_lists_hold_all(spark):
    edges = spark.createDataFrame([("r", f"u{i:02}", "hub") for i in range(25)], "repo_id string, src string, dst string")
    components = spark.createDataFrame([("r", "hub"), ("r", "u00"), ("r", "alone")], "repo_id string, id string")
    rows = R.with_dependency_lists(components, edges, 10).collect()
    users = [u for r in sorted(rows, key=lambda r: r.part) if r.id == "hub" for u in r.used_by]
    assert users == [f"u{i:02}" for i in range(25)] and max(len(r.used_by) for r in rows) == 10
    assert [(r.part, r.depends_on, r.used_by) for r in rows if r.id == "alone"] == [(0, [], [])]
