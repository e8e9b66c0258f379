"""What travels between tasks: large rows meet what they need in as few moves as the job allows."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import context as C
from codeloom.operators import graph as G
from codeloom.operators import resolve as R
from codeloom.operators import skew
from codeloom.plans import corpus

COMPONENTS = "repo_id string, id string, component_type string"
EDGES = "repo_id string, src string, dst string"


def plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def moved(df):
    """The columns that each exchange by hash moves."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: hash", text)


@pytest.fixture
def kept_plans(monkeypatch):
    """Plans of the tables that an operator writes on its way."""
    plans = []
    for module in (R, skew, C, G):
        for name in ("cut", "kept"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda df, own=getattr(module, name): (plans.append(plan(df)), own(df))[1])
    return plans


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("few", [64, 1])
def test_calls_go_to_the_ids_of_their_ending(spark, monkeypatch, kept_plans, few):
    monkeypatch.setattr(R, "FEW_IDS", few, raising=False)
    ids = [("r", "a.b.C", "class"), ("r", "a.b.C.__init__", "method"), ("r", "a.C", "class"), ("r", "a.b.f", "function"), ("r", "f", "function"),
           ("r", "a.f", "function"), ("r", "root.a.f", "function"), ("s", "z.f", "function"), ("r", "a.b.D.__init__", "method"), (None, "n", "function"), ("r", "a.f", "function")]
    raws = ["f", "a.f", "a/b/f", "root.f", "root.a.f", "C", "C.__init__", "b.C.__init__", "D.__init__", "z.f", "__init__", "", "x.", "n", "<builtin>.print", None]
    calls = [(repo, caller, kind, raw) for repo in ("r", "s", None) for caller, kind in (("a.b.g", "function"), ("a.b.C.m", "method"), ("g", "function"), (None, "function"))
             for raw in raws for _ in range(2)]
    comps = spark.createDataFrame(ids, COMPONENTS)
    got = R.resolve_callees(spark.createDataFrame(calls, "repo_id string, caller_id string, caller_type string, raw_callee string"), comps, "root")
    known, want = {(r, i) for r, i, _ in ids if r}, set()
    for repo, caller, kind, raw in set(calls):
        if raw is None or raw.startswith("<builtin>"):
            continue
        name = raw.replace("/", ".")
        parts = (caller or "").split(".") if caller else []
        depth = max(len(parts) - (2 if kind == "method" else 1), 0)
        tried = [name, name[5:] if name.startswith("root.") else None, *[".".join([*parts[:n], name]) for n in range(depth, 0, -1)]]
        at = next((k for k, t in enumerate(tried) if t is not None and (repo, t) in known), None)
        callee = None if at is None else tried[at]
        want.add((repo, caller, kind, raw, callee, 2 if at is None else min(at, 2), callee == "a.b.C.__init__"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert few == 1 or not any("explode(sequence" in p for p in kept_plans)  # one row for each call


def test_names_of_calls_are_made_behind_the_joins(spark, no_broadcast, tmp_path):
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "A B"), (1, "C")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "X", 0), (1, "Y", 1), (2, "Z", 9)]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string", [(k, "n", k % 3, "s") for k in range(9)] + [(3, "m", 0, "s"), (None, "n", 0, "s")]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(k, "n", k % 2) for k in range(4)]),
        "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(k, "n", "b", "t", 1, 1.0) for k in [*range(12), 5]]),
        "orders": ("o_orderkey bigint, o_custkey bigint", [(k, k % 10) for k in range(30)]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_linenumber int", [(k % 31, (k * 7 + k % 5) % 14, (None, *range(-1, 9))[k % 11]) for k in range(900)] + [(1, None, 1), (None, 1, 1)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    c = corpus.Corpus(spark, str(tmp_path))
    tables = {t: c.table(t) for t in rows}
    for view in ("fx_calls", "fx_next", "fx_parents"):
        full = corpus.with_views(f"SELECT * FROM {view}")
        want = sorted(map(str, spark.sql(full, **{t: d for t, d in tables.items() if "{" + t + "}" in full}).collect()))
        assert sorted(map(str, c.view(view).collect())) == want and (want or view == "fx_parents")
    assert not any(re.search(r"\b(id|class_id|src|dst)#", line) for line in moved(c.view("fx_next")))
    # lines whose name ends in the part's number are told apart where they met the part
    assert sum(bool(re.search(r"\b(id|caller_id)#", line)) for line in moved(c.view("fx_calls"))) <= 1


def test_edges_of_resolved_calls_need_no_class_lookup(spark, no_broadcast):
    calls = spark.createDataFrame([("r", "m.f", "function", "m.C.__init__"), ("r", "m.f", "function", "m.g")], "repo_id string, caller_id string, caller_type string, raw_callee string")
    comps = spark.createDataFrame([("r", "m.C", "class"), ("r", "m.C.__init__", "method"), ("r", "m.f", "function"), ("r", "m.g", "function")], COMPONENTS)
    edges = R.resolve(calls, comps, "main-alternatif", distinct=False)
    assert {(r.src, r.dst) for r in edges.collect()} == {("m.f", "m.C"), ("m.f", "m.g")}
    assert "Join" not in plan(edges) and "Exchange" not in plan(edges)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_groups_are_numbered_where_they_meet(spark, monkeypatch, kept_plans, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "SAMPLED", 1.0, raising=False)
    rows = [(k % 7 if k % 7 else None, k * 37 % 101) for k in range(101)] + [(9, 1), (9, 2)]
    placed = skew.numbered(spark.createDataFrame(rows, "g int, v int"), ["g"], [F.col("v")], "n")
    want = {(g, v, sorted(w for h, w in rows if h == g).index(v) + 1) for g, v in rows}
    assert {tuple(r) for r in placed.collect()} == want and placed.count() == len(rows)
    if hot > 3:
        assert plan(placed).count("Exchange") == 1 and not any("rangepartitioning" in p for p in kept_plans)


def test_both_lists_of_a_component_without_slices(spark, kept_plans, no_broadcast):
    edges = [("r", f"m{a}", f"m{b}") for a in range(6) for b in range(6) if (a + b) % 3] * 2
    comps = spark.createDataFrame([("r", f"m{k}", "function") for k in range(7)], COMPONENTS)
    lists = R.with_dependency_lists(comps, spark.createDataFrame(edges, EDGES), 2)
    assert not any("rangepartitioning" in p for p in kept_plans)
    for k in range(7):
        mine = sorted((r.part, r.depends_on, r.used_by) for r in lists.where(f"id = 'm{k}'").collect())
        down, up = (sorted({e[2 - at] for e in edges if e[1 + at] == f"m{k}"}) for at in (0, 1))
        assert sum((p[1] for p in mine), []) == down and sum((p[2] for p in mine), []) == up
        assert [p[0] for p in mine] == list(range(len(mine))) and all(len(p[1]) <= 2 and len(p[2]) <= 2 for p in mine)


def test_neighbourhoods_are_seen_behind_the_joins(spark, no_broadcast):
    comps = spark.createDataFrame([("r", "a", "class"), ("r", "b", "method"), ("r", "b", "function"), ("r", "n", None)], COMPONENTS)
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "a", "b"), ("r", "b", "gone"), ("r", "gone", "a"), ("r", "gone", "lost"), ("r", "n", "a"), (None, "a", "b")], EDGES)
    ego = G.ego_edges(comps, edges, spark.createDataFrame([("r", "a", "n"), ("r", "a", "n"), ("r", "gone", "a")], "repo_id string, id string, parent_id string"))
    got = sorted((r.focal, r.label, r.other, str(r.other_type), r.is_external) for r in ego.collect())
    assert got == sorted([("a", "depend_on", "b", "method", False), ("a", "depend_on", "b", "function", False), ("b", "uses", "a", "class", False),
                          ("b", "depend_on", "gone", "None", True), ("a", "uses", "gone", "None", True), ("a", "uses", "n", "None", True),
                          ("n", "depend_on", "a", "class", False), ("a", "inherits", "n", "None", True), ("a", "inherits", "n", "None", True)])
    text = plan(ego)
    assert "Generate" in text and text.index("Generate") < text.index("Exchange")  # rows are doubled behind the last move


def test_ranked_dependencies_move_twice(spark, kept_plans, no_broadcast):
    comps = spark.createDataFrame([("r", "a", "function"), ("r", "k", "class")], COMPONENTS)
    edges = spark.createDataFrame([("r", "a", x) for x in ("p", "q", "s", "t", "q")] + [("r", "k", "p"), ("r", "gone", "p"), ("r", "a", None)], EDGES)
    ranks = spark.createDataFrame([("r", "p", 1.0), ("r", "q", 2.0), ("r", "s", 1.0)], "repo_id string, id string, score double")
    up = spark.createDataFrame([("r", "a", "t"), ("r", "a", None), ("r", "k", "p")], "repo_id string, id string, parent_id string")
    ranked = C.ranked_deps(comps, edges, ranks, up)
    assert [(r.part_id, r.score, r.pos) for r in ranked.orderBy("pos").collect()] == [("q", 2.0, 1), ("p", 1.0, 2), ("s", 1.0, 3), (None, 0.0, 4)]
    assert sum("part_id#" in line and "src#" not in line for line in moved(ranked)) <= 3 and not any("rangepartitioning" in p for p in kept_plans)
    top = C.top_dependencies(comps, edges.where("dst IS NOT NULL"), ranks, 2)
    assert sorted((r.id, r.dep_id, r.pos) for r in top.collect()) == [("a", "p", 2), ("a", "q", 1), ("gone", "p", 1), ("k", "p", 1)]


def test_moves_of_a_written_table_are_deleted(spark):
    from codeloom.session import CLEANUP, cut, lay_out
    local = pathlib.Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    rows = spark.range(200_000).select((F.col("id") % 1009).alias("a"), F.xxhash64("id").alias("b"))

    def files():
        return {p for p in local.rglob("shuffle_*") if p.stat().st_size}
    for write in (cut, lambda df: lay_out(df, 4, "b")):
        before, table = files(), write(rows.repartition(4, "a"))
        assert table.count() == 200_000
        assert sum(p.stat().st_size for p in files() - before) < 100_000  # the count's own; the rows take over a megabyte
    assert spark.conf.get(CLEANUP) == "false"


def test_pieces_are_collected_where_they_met_their_counts(spark, kept_plans, no_broadcast):
    from codeloom.functions.tokens import from_codec
    from codeloom.plans.generation import Fours
    parts = spark.createDataFrame([("r", f"m{k}", "dependency", p, f"d{p}", "documentation", "x" * 40) for k in range(3) for p in range(1, 5)],
                                  "repo_id string, id string, kind string, pos long, part_id string, type string, content string")
    focal = spark.createDataFrame([("r", f"m{k}", 10 * k) for k in range(4)], "repo_id string, id string, focal_tokens long")
    left, verdict = C.prune_context(parts, focal, 130, tokenizer=from_codec("fours", Fours))
    assert len(kept_plans) == 2  # the parts and the verdict; no texts
    moves = [line for line in re.findall(r"Exchange hashpartitioning\(.*", kept_plans[1])]
    assert len(moves) == 3  # counts, parts, focal
    assert verdict.count() == 4 and verdict.where("ok").count() == 4
    assert left.groupBy("id").count().count() == 3 and verdict.where("removed = 0").count() == 1
