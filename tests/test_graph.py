"""Graph loops against brute force on small graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import contract as C
from codeloom.operators import graph as G
from codeloom.operators import resolve as R
from codeloom.operators import skew as K


def tables(spark, graphs):
    nodes = [(repo, n) for repo, (ns, _) in graphs.items() for n in ns]
    edges = [(repo, a, b) for repo, (_, es) in graphs.items() for a, b in es]
    return (spark.createDataFrame(nodes, "repo_id string, id string"),
            spark.createDataFrame(edges, "repo_id string, src string, dst string"))


def random_graph(seed, n, m):
    rnd = random.Random(seed)
    ns = [f"n{i:02d}" for i in range(n)]
    return ns, {(a, b) for a, b in ((rnd.choice(ns), rnd.choice(ns)) for _ in range(m)) if a != b}


@pytest.fixture(scope="module")
def graphs():
    return {"x": random_graph(1, 25, 30), "y": random_graph(2, 12, 30), "chain": (["a", "b", "c", "d"], {("a", "b"), ("b", "c")})}


def reach(ns, es):
    out = {n: {n} for n in ns}
    for _ in ns:
        for a, b in es:
            out[a] |= out[b]
    return out


def components_of(ns, es):
    r = reach(ns, es)
    return {n: min(m for m in ns if m in r[n] and n in r[m]) for n in ns}


def rank_of(ns, es, alpha, tol):
    at, n = {v: i for i, v in enumerate(ns)}, len(ns)
    links = [(at[b], at[a]) for a, b in es]  # dependency -> dependant
    out = np.bincount([s for s, _ in links], minlength=n)
    x = np.full(n, 1 / n)
    for _ in range(100):
        new = np.full(n, (1 - alpha) / n) + alpha * x[out == 0].sum() / n
        for s, t in links:
            new[t] += alpha * x[s] / out[s]
        moved, x = np.abs(new - x).sum(), new
        if moved < tol:
            return dict(zip(ns, x))
    raise AssertionError


def test_scc_and_order(spark, graphs):
    nodes, edges = tables(spark, graphs)
    got = {(r.repo_id, r.id): r for r in G.processing_order(nodes, edges).collect()}
    for repo, (ns, es) in graphs.items():
        want = components_of(ns, es)
        assert {n: got[repo, n].scc_id for n in ns} == want
        for a, b in es:  # a depends on b
            if want[a] != want[b]:
                assert got[repo, a].level > got[repo, b].level and got[repo, a].pos > got[repo, b].pos
        assert sorted(got[repo, n].pos for n in ns) == list(range(1, len(ns) + 1))


def test_scc_with_hot_nodes(spark, graphs, monkeypatch):
    """Every node is split as if it were hot; the result stays the same."""
    monkeypatch.setattr(G, "hot_keys", lambda df, keys: K.hot_keys(df, keys, 1))
    nodes, edges = tables(spark, {"y": graphs["y"]})
    got = {r.id: r.scc_id for r in G.scc(nodes, edges).collect()}
    assert got == components_of(*graphs["y"])
    ranks = {r.id: r.score for r in G.pagerank(nodes, edges, tol=1e-6).collect()}
    want = rank_of(*graphs["y"], 0.85, 12 * 1e-6)
    assert all(abs(ranks[n] - want[n]) < 1e-9 for n in want)


def test_pagerank_converges_per_repository(spark, graphs):
    nodes, edges = tables(spark, graphs)
    got = {(r.repo_id, r.id): r.score for r in G.pagerank(nodes, edges).collect()}
    for repo, (ns, es) in graphs.items():
        want = rank_of(ns, es, 0.85, len(ns) * 1e-6)
        assert abs(sum(got[repo, n] for n in ns) - 1) < 1e-9
        assert all(abs(got[repo, n] - want[n]) < 1e-9 for n in ns)
    early = G.pagerank(nodes, edges, max_iter=2)
    assert early.count() == len(got) and 0 < early.where("NOT converged").count()  # what did not settle keeps its scores, marked


def test_history(spark, graphs):
    nodes, edges = tables(spark, {"y": graphs["y"]})
    rows = G.pagerank_history(nodes, edges, tol=1e-3).collect()
    last = max(r.iteration for r in rows)
    want = rank_of(*graphs["y"], 0.85 ** 2, 1e-3)
    assert all(abs(r.score - want[r.id]) < 1e-9 for r in rows if r.iteration == last)
    assert {r.iteration for r in rows} == set(range(1, last + 1))


def test_ego_dot(spark):
    comps = spark.createDataFrame([("r", "m.A", "class"), ("r", "m.A.f", "method"), ("r", "m.g", "function"), ("r", "m.alone", "function")],
                                  "repo_id string, id string, component_type string")
    edges = spark.createDataFrame([("r", "m.A", "m.A.f"), ("r", "m.g", "m.A"), ("r", "m.g", "lib.x")], "repo_id string, src string, dst string")
    ups = spark.createDataFrame([("r", "m.A", "m.P")], "repo_id string, id string, parent_id string")
    ego = G.ego_edges(comps, edges, ups)
    whole = {r.focal: r.dot for r in G.ego_dot(comps, ego).collect()}
    assert set(whole) == {"m.A", "m.A.f", "m.g"}
    text = whole["m.A"]
    assert text.startswith("digraph {") and text.endswith("}")
    assert '"m.A" -> "m.A.f"' in text and '"m.g" -> "m.A"' in text and '"m.P" -> "m.A"' in text and "xlabel=inherits arrowhead=empty" in text
    assert "<A.<BR/>f<BR/>" in text and 'color="#d9534f"' in text
    assert 'label="x" color=gray70' in whole["m.g"]
    parts = G.ego_dot(comps, ego, lines_per_part=2).where("focal = 'm.A'").orderBy("part").collect()
    assert len(parts) > 2 and "\n".join(p.dot for p in parts) == text
    assert G.ego_counts(comps, ego).first()[1:] == (3, 1)


def test_ego_dot_numbers_hubs_only(spark, monkeypatch):
    """Texts that fit into one part are laid out without sorting their lines as rows."""
    comps = spark.createDataFrame([("r", "m.A", "class"), ("r", "m.g", "function")], "repo_id string, id string, component_type string")
    ego = G.ego_edges(comps, spark.createDataFrame([("r", "m.g", "m.A"), ("r", "m.g", "m.g")], "repo_id string, src string, dst string"))
    asked = []
    monkeypatch.setattr(G, "numbered", lambda *a: asked.append(a) or K.numbered(*a))
    texts = {r.focal: r.dot.split("\n")[4:] for r in G.ego_dot(comps, ego).collect()}
    assert not asked and [line.split(" [")[0] for line in texts["m.g"]] == ['\t"m.g"', '\t"m.A"', '\t"m.g" -> "m.A"', '\t"m.g" -> "m.g"', '\t"m.g" -> "m.g"', "}"]


def test_numbered_matches_window(spark):
    rows = [(("hot" if i % 3 else f"k{i % 7}"), (i * 37) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    for keys in (["k"], []):
        got = {r.i: r.n for r in K.numbered(df, keys, [F.col("v").desc(), F.col("i")], "n").collect()}
        for key in {r[0] for r in rows} if keys else [None]:
            order = sorted((r for r in rows if key in (None, r[0])), key=lambda r: (-r[1], r[2]))
            assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_first_containing(spark):
    needles = spark.createDataFrame([("r", "ab"), ("r", "zz"), ("r", ""), ("s", "ab"), ("r", "abc")], "repo_id string, needle string")
    texts = spark.createDataFrame([("r", "xabx"), ("r", "cabc"), ("r", "abc"), ("s", "ba")], "repo_id string, text string")
    got = {(r.repo_id, r.needle): r.found for r in K.first_containing(needles, texts, ["repo_id"], "needle", "text").collect()}
    assert got == {("r", "ab"): "abc", ("r", ""): "abc", ("r", "abc"): "abc"}


@pytest.mark.parametrize("few", [0, 16])
def test_first_containing_without_broadcast_pieces(spark, monkeypatch, few):
    """Texts cut into pieces are never broadcast, whatever their files' size; the result is that of all pairs."""
    monkeypatch.setattr(K, "FEW", few, raising=False)
    monkeypatch.setattr(K, "LOOKUP_ROWS", -1, raising=False)
    texts = [f"m{i}" for i in range(0, 400, 7)] + [f"long_name_of_m{i}_é𝒳" for i in range(0, 60, 3)] + ["", "a\nb"]
    wanted = ["", "m", "m1", "7", "m39", "é𝒳", "𝒳", "name_of_m", "long_name_of_m3_é𝒳", "ng_name_of_m5", "\nb", "m4000", ".", "zz_no_such_name"]
    got = {r.needle: r.found for r in K.first_containing(
        spark.createDataFrame([("r", w) for w in wanted] + [("s", "m")], "repo_id string, needle string"),
        spark.createDataFrame([("r", t) for t in texts], "repo_id string, text string"), ["repo_id"], "needle", "text").collect()}
    assert got == {w: min(t for t in texts if w in t) for w in wanted if any(w in t for t in texts)}
    plan = K.first_containing(
        spark.createDataFrame([("r", w) for w in wanted], "repo_id string, needle string"),
        spark.createDataFrame([("r", t) for t in texts], "repo_id string, text string"), ["repo_id"], "needle", "text")
    assert "BroadcastExchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_dependency_lists_compute_edges_once(spark, monkeypatch):
    comps = spark.createDataFrame([("r", x) for x in "abc"], "repo_id string, id string")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "a", "c"), ("r", "c", "b"), ("r", "a", "b")], "repo_id string, src string, dst string")
    seen, real = [], R.used_by_lists
    monkeypatch.setattr(R, "used_by_lists", lambda e, size: seen.append(e) or real(e, size))
    got = {(r.id, r.part): (r.depends_on, r.used_by) for r in R.with_dependency_lists(comps, edges, 1).collect()}
    assert got == {("a", 0): (["b"], []), ("a", 1): (["c"], []), ("b", 0): ([], ["a"]), ("b", 1): ([], ["c"]), ("c", 0): (["b"], ["a"])}
    assert len(seen) == 2 and all(e.inputFiles() for e in seen)  # read from one table


def test_candidates_by_position(spark):
    """Each candidate by its place is the item of the array, which is not made."""
    rows = [("p.q.C.m", "method", "top/x.y"), ("p.q.f", "function", "z"), ("f", "function", "top.z"), ("C.m", "method", "z")]
    calls = spark.createDataFrame(rows, "caller_id string, caller_type string, raw_callee string")
    every = calls.select("*", F.posexplode(R.callee_candidates("raw_callee", "caller_id", "caller_type", "top")).alias("pos", "want"))
    depth = F.greatest(F.size(F.split("caller_id", r"\.")) - F.when(F.col("caller_type") == "method", 2).otherwise(1), F.lit(0))
    got = every.select("pos", "want", R._candidate(F.col("pos"), depth, "top").alias("got"), depth.alias("depth")).collect()
    assert all(r.got == r.want and r.pos <= r.depth + 1 for r in got) and len(got) == 4 * 2 + sum(r.pos >= 2 for r in got)


def test_collapse_init_and_restrict(spark):
    comps = spark.createDataFrame([("r", "m.C", "class"), ("r", "m.C.__init__", "method"), ("r", "m.__init__", "function"), ("r", "m.f", "function")],
                                  "repo_id string, id string, component_type string")
    edges = spark.createDataFrame([("r", "m.f", "m.C.__init__"), ("r", "m.f", "m.__init__"), ("r", "m.f", "m.f"), ("r", "m.f", "gone")],
                                  "repo_id string, src string, dst string")
    assert {r.dst for r in R.collapse_init(edges, comps).collect()} == {"m.C", "m.__init__", "m.f", "gone"}
    assert {r.dst for r in R.restrict_edges(edges, comps).collect()} == {"m.C.__init__", "m.__init__"}
    graph = spark.createDataFrame([("r", "m/f.py", "f", "function")], "repo_id string, relative_path string, name string, component_type string").select(
        "repo_id", "relative_path", F.lit("m.f.run").alias("id"), "component_type")
    raw = spark.createDataFrame([("r", "m/f.run", "m/g.x"), ("r", "m.f.run", "no")], "repo_id string, caller_key string, callee string")
    assert [r.raw_callee for r in R.match_callers(graph, raw).collect()] == ["m/g.x"]


def random_dag(seed, n, m):
    rnd = random.Random(seed)
    ns = [f"d{i:03d}" for i in range(n)]
    return ns, {tuple(sorted(rnd.sample(ns, 2))) for _ in range(m)}


def test_components_and_levels_of_many_shapes(spark, monkeypatch):
    """Cycles, chains into and out of cycles, trees, sparse and dense graphs; contraction to the end and not at all."""
    cycle = lambda p, n: {(f"{p}{i}", f"{p}{(i + 1) % n}") for i in range(n)}
    tail = {(f"t{i}", f"t{i + 1}") for i in range(9)} | {("t9", "c0"), ("c3", "u0")} | {(f"u{i}", f"u{i + 1}") for i in range(9)}
    two = cycle("p", 6) | cycle("q", 5) | {("p1", "q2"), ("p4", "q0"), ("q1", "x"), ("x", "q3"), ("z", "z"), ("p2", "y"), ("y", "q4")}
    shapes = {"two": two, "tails": cycle("c", 7) | tail, "pair": {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")},
              "tree": {(f"k{i}", f"k{i // 2}") for i in range(1, 40)}, "back": {(f"k{i // 2}", f"k{i}") for i in range(1, 40)}}
    graphs = {k: (sorted({x for e in es for x in e} | {"alone"}), es) for k, es in shapes.items()}
    graphs |= {f"r{s}": random_graph(s, 30, 15 * s) for s in (2, 3, 4)} | {f"d{s}": random_dag(s, 60, 40 * s) for s in (1, 2)}
    nodes, edges = tables(spark, graphs)
    for gain in (1, 10**9):
        monkeypatch.setattr(G, "contract", lambda pairs, sources_stay=False: C.contract(pairs, sources_stay, gain))  # noqa: B023
        got = {(r.repo_id, r.id): (r.scc_id, r.level) for r in G.levels(nodes, edges).collect()}
        for repo, (ns, es) in graphs.items():
            want = components_of(ns, es)
            assert {n: got[repo, n][0] for n in ns} == want, repo
            level = dict.fromkeys(want.values(), 0)
            for _ in level:
                for a, b in es:
                    if want[a] != want[b]:
                        level[want[a]] = max(level[want[a]], level[want[b]] + 1)
            assert {n: got[repo, n][1] for n in ns} == {n: level[want[n]] for n in ns}, repo


def test_long_cycles_and_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    monkeypatch.setattr(C, "_turn", lambda *a, f=C._turn: (rounds.append("turn"), f(*a))[1])
    monkeypatch.setattr(G, "cut", lambda df, f=G.cut: (rounds.append("cut"), f(df))[1])
    ids = spark.range(n).selectExpr("'r' AS repo_id", "concat('n', id) AS id")
    ring = spark.range(n).selectExpr("'r' AS repo_id", "concat('n', id) AS src", f"concat('n', (id + 1) % {n}) AS dst")
    assert G.scc(ids, ring).select("scc_id").distinct().count() == 1
    assert rounds.count("turn") <= 25 and len(rounds) <= 40, rounds
    chain = ring.where(f"src <> 'n{n - 1}'")
    alone = ids.withColumn("scc_id", F.col("id"))
    rounds.clear()
    got = G.levels(ids, chain, alone).select((F.col("level") + F.substring("id", 2, 9).cast("long")).alias("sum")).distinct().collect()
    assert [r[0] for r in got] == [n - 1] and rounds.count("turn") <= 25


def test_dense_graphs_are_merged_before_their_edges_go_round(spark, monkeypatch):
    """What a sample shows to be on common cycles is merged: few of the edges are left for the contraction."""
    rnd, n = random.Random(5), 90
    dense = {(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(3500)}
    dense = {(a, b) for a, b in dense if a != b}
    tail = {("n00", "t0"), ("t0", "t1"), ("t1", "t0"), ("h0", "n01"), ("h1", "h0")}  # below and above the dense part
    graphs = {"d": ([f"n{i:02d}" for i in range(n)] + ["alone"], dense | tail), "s": random_graph(3, 20, 40)}  # t0, t1, h0, h1 are only ends
    nodes, edges = tables(spark, graphs)
    seen = []
    monkeypatch.setattr(G, "contract", lambda pairs, *a, **k: (seen.append(pairs.count()), C.contract(pairs, *a, **k))[1])
    members = G.cut(G.scc(nodes, edges.unionByName(edges)))
    got = {(r.repo_id, r.id): r.scc_id for r in members.collect()}
    want = {(repo, v): m for repo, (ns, es) in graphs.items() for v, m in components_of(sorted({*ns, *(x for e in es for x in e)}), es).items()}
    assert got == want
    assert seen[0] < len(dense) / 3, (seen, len(dense))
    between = {(r.repo_id, r.src_scc, r.dst_scc) for r in G.condense(members, edges).collect()}
    assert between == {(repo, want[repo, a], want[repo, b]) for repo, (_, es) in graphs.items() for a, b in es if want[repo, a] != want[repo, b]}


def test_names_with_one_number_are_numbered_anew(spark, graphs, monkeypatch):
    right = G._number
    monkeypatch.setattr(G, "_number", lambda id_, seed: F.pmod(right(id_, seed), F.lit(7)) if seed == 0 else right(id_, seed))
    nodes, edges = tables(spark, {"y": graphs["y"]})
    members = G.cut(G.scc(nodes, edges))
    want = components_of(*graphs["y"])
    assert {r.id: r.scc_id for r in members.collect()} == want
    assert {(r.src_scc, r.dst_scc) for r in G.condense(members, edges).collect()} == {(want[a], want[b]) for a, b in graphs["y"][1] if want[a] != want[b]}


def test_lean_views_have_the_rows_of_the_views(spark):
    from codeloom.plans import corpus

    c = corpus.Corpus(spark, "/root/testdata/sf0.001")
    for name in corpus.LEAN:
        tables_ = {t: c.table(t) for t in corpus.BASE_TABLES if "{" + t + "}" in corpus.with_views(f"SELECT * FROM {name}")}
        plain, lean = spark.sql(corpus.with_views(f"SELECT * FROM {name}"), **tables_), c.view(name)
        assert plain.columns == lean.columns and plain.count() == lean.count() and not plain.exceptAll(lean).take(1), name
    plan = c.graph._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and sum("Relation" in x and "l_linenumber" in x for x in plan.splitlines()) == 1  # read once
