"""Queries for name resolution and graph analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import path_mismatch
from codeloom.operators import context as C
from codeloom.operators import graph as G
from codeloom.operators import resolve as R
from codeloom.plans.corpus import Corpus
from codeloom.plans.registry import query
from codeloom.session import cut, shared_folder
from codeloom.sources.records import write_order

# --- SQL pieces -------------------------------------------------------------

RESOLVED = """
named AS (SELECT DISTINCT caller_id, raw_callee, replace(raw_callee, '/', '.') AS norm FROM fx_calls
          WHERE NOT starts_with(raw_callee, '<builtin>')),
tried AS (
  SELECT caller_id, raw_callee, 0 AS pos, norm AS id FROM named
  UNION ALL SELECT caller_id, raw_callee, 1, substring(norm, 6) FROM named WHERE starts_with(norm, 'root.')
  UNION ALL SELECT caller_id, raw_callee, 2, split_part(caller_id, '.', 1) || '.' || split_part(caller_id, '.', 2) || '.' || norm FROM named
  UNION ALL SELECT caller_id, raw_callee, 3, split_part(caller_id, '.', 1) || '.' || norm FROM named),
hit AS (SELECT caller_id, raw_callee, arg_min(id, pos) AS callee_id, min(pos) AS pos
        FROM tried JOIN (SELECT id FROM fx_components) USING (id) GROUP BY 1, 2),
call_edge AS (
  SELECT DISTINCT caller_id AS src, coalesce(k.id, callee_id) AS dst FROM hit
  LEFT JOIN (SELECT id FROM fx_components WHERE component_type = 'class') k
    ON callee_id LIKE '%.\\_\\_init\\_\\_' ESCAPE '\\' AND k.id = regexp_replace(callee_id, '\\.__init__$', '')
  WHERE callee_id <> caller_id),
member_edge AS (
  SELECT regexp_replace(m.id, '\\.[^.]*$', '') AS src, m.id AS dst FROM fx_components m
  WHERE m.component_type = 'method' AND m.id NOT LIKE '%.\\_\\_init\\_\\_' ESCAPE '\\')"""


def rank_sql(links: str, nodes: str, steps: int, damping: str = "0.85") -> str:
    """Power iteration as one materialised step per CTE: rank0 .. rank<steps>."""
    parts = [f"link AS MATERIALIZED ({links})", f"node AS MATERIALIZED ({nodes})",
             "outs AS MATERIALIZED (SELECT source, count(*) AS o FROM link GROUP BY 1)",
             "cnt AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM node)",
             "rank0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS score FROM node, cnt)"]
    for i in range(1, steps + 1):
        p = f"rank{i - 1}"
        parts.append(f"""rank{i} AS MATERIALIZED (
  SELECT node.id, (1 - {damping}::DOUBLE) / n + {damping}::DOUBLE * (coalesce(got, 0) + lost / n) AS score
  FROM node CROSS JOIN cnt
  CROSS JOIN (SELECT coalesce(sum(score), 0) AS lost FROM {p} WHERE id NOT IN (SELECT source FROM outs)) l
  LEFT JOIN (SELECT target, sum(score / o) AS got FROM {p} JOIN link ON source = id JOIN outs USING (source) GROUP BY 1) g
    ON g.target = node.id)""")
    return ",\n".join(parts)


def settled_sql(links: str, nodes: str, steps: int, damping: str = "0.85", per_node: bool = True) -> str:
    """``ranked(step, id, score)`` of steps 1 up to the first that moves the scores by less than 1e-6 (times the nodes)."""
    bound = "1e-6 * n" if per_node else "1e-6"
    moved = " UNION ALL ".join(
        f"SELECT {i} AS step, (SELECT sum(abs(x.score - y.score)) FROM rank{i} x JOIN rank{i - 1} y USING (id)) AS d" for i in range(1, steps + 1))
    every = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS step, id, score FROM rank{i}" for i in range(1, steps + 1))
    return f"""{rank_sql(links, nodes, steps, damping)},
stop AS MATERIALIZED (SELECT min(step) AS k FROM ({moved}) m, cnt WHERE d < {bound}),
ranked AS MATERIALIZED (SELECT step, id, score FROM ({every}) r, stop WHERE step <= k)"""


# the whole corpus as one repository, and each nation's module once more as a repository of its own
CLOSURE = """
k AS MATERIALIZED (SELECT repo_id, id, row_number() OVER (ORDER BY repo_id, id) AS n FROM fx_graph_nodes),
e AS MATERIALIZED (SELECT s.n AS s, d.n AS d FROM fx_graph g JOIN k s ON s.repo_id = g.repo_id AND s.id = g.src
                   JOIN k d ON d.repo_id = g.repo_id AND d.id = g.dst),
closure AS (SELECT s AS a, d AS b FROM e UNION SELECT c.a, e.d FROM closure c JOIN e ON e.s = c.b),
mutual AS MATERIALIZED (SELECT x.a, min(x.b) AS m FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a GROUP BY 1),
rooted AS MATERIALIZED (SELECT k.repo_id, k.id, k.n, least(k.n, coalesce(m, k.n)) AS root FROM k LEFT JOIN mutual ON a = n),
member AS MATERIALIZED (SELECT r.repo_id, r.id, r.n, r.root, o.id AS scc_id FROM rooted r JOIN k o ON o.n = r.root),
between AS MATERIALIZED (SELECT DISTINCT x.root AS src_root, y.root AS dst_root FROM e JOIN rooted x ON x.n = s JOIN rooted y ON y.n = d
                         WHERE x.root <> y.root),
contracted AS (SELECT x.repo_id, x.id AS src_scc, y.id AS dst_scc FROM between JOIN k x ON x.n = src_root JOIN k y ON y.n = dst_root),
step AS (SELECT DISTINCT root AS g, CAST(0 AS BIGINT) AS lvl FROM rooted UNION
         SELECT src_root, s.lvl + 1 FROM step s JOIN between ON dst_root = s.g),
leveled AS (SELECT g, max(lvl) AS level FROM step GROUP BY 1)"""


# --- resolution -------------------------------------------------------------

@query(f"""WITH {RESOLVED} SELECT n.caller_id, n.raw_callee, callee_id, CAST(least(pos, 2) AS BIGINT) AS step
FROM named n LEFT JOIN hit USING (caller_id, raw_callee)""")
def resolve_callees(c: Corpus) -> DataFrame:
    return R.resolve_callees(c.calls, c.components, "root").select("caller_id", "raw_callee", "callee_id", "step")


@query(f"WITH {RESOLVED} SELECT src, dst FROM call_edge")
def resolve_main(c: Corpus) -> DataFrame:
    return R.resolve(c.calls, c.components, "main-alternatif", root="root").select("src", "dst")


@query(f"""WITH {RESOLVED},
short AS (SELECT id, CASE WHEN component_type = 'method' THEN array_to_string(string_split(id, '.')[-2:], '.')
                     ELSE string_split(id, '.')[-1] END AS s FROM fx_components),
miss AS (SELECT caller_id, raw_callee, norm, string_split(norm, '.') AS p FROM named
         WHERE (caller_id, raw_callee) NOT IN (SELECT caller_id, raw_callee FROM hit)),
cnt AS (SELECT s, count(*) AS n FROM short GROUP BY 1),
pick AS (
  SELECT caller_id, raw_callee, p, CASE WHEN len(p) > 2 AND c2.n IS NOT NULL AND NOT (p[-2] = p[-3] AND coalesce(c1.n, 0) = 1) THEN 2
                                  WHEN c1.n IS NOT NULL THEN 1 END AS k
  FROM miss LEFT JOIN cnt c2 ON c2.s = array_to_string(p[-2:], '.') LEFT JOIN cnt c1 ON c1.s = p[-1] WHERE len(p) >= 2),
found AS (
  SELECT caller_id, raw_callee, min(id) AS callee_id FROM pick JOIN short ON s = array_to_string(p[-k:], '.')
  WHERE k IS NOT NULL AND contains(id, array_to_string(p[1:len(p) - k], '.')) GROUP BY 1, 2)
SELECT DISTINCT caller_id AS src, callee_id AS dst FROM (
  SELECT caller_id, callee_id FROM hit UNION ALL SELECT caller_id, callee_id FROM found) t
WHERE caller_id <> callee_id""")
def short_name_resolution(c: Corpus) -> DataFrame:
    return R.resolve(c.calls, c.components, "second-alternatif", root="root").select("src", "dst")


@query(f"WITH {RESOLVED} SELECT src, dst FROM member_edge")
def class_method_edges(c: Corpus) -> DataFrame:
    return R.class_method_edges(c.components).select("src", "dst")


def _edges(c: Corpus) -> DataFrame:
    calls = R.resolve(c.calls, c.components, "main-alternatif", root="root", distinct=False)  # the union tells edges apart
    inherits = cut(c.parents).select("repo_id", F.col("id").alias("src"), F.col("parent_id").alias("dst"),
                                F.lit("inherits").alias("kind"))
    return R.all_edges(calls, R.class_method_edges(c.components), inherits)


ALL_EDGES = f"""{RESOLVED},
edge AS (SELECT src, dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (
  SELECT src, dst, 'calls' AS kind FROM call_edge UNION ALL SELECT src, dst, 'member' FROM member_edge
  UNION ALL SELECT id, parent_id, 'inherits' FROM fx_parents) t GROUP BY 1, 2)"""


@query(f"WITH {ALL_EDGES} SELECT src, dst, kinds FROM edge")
def all_edges(c: Corpus) -> DataFrame:
    return _edges(c).select("src", "dst", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH {ALL_EDGES},
lists AS (SELECT dst AS id, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM edge)
SELECT id, CAST((n - 1) // 50 AS BIGINT) AS part, string_agg(src, ',' ORDER BY src) AS users FROM lists GROUP BY 1, 2""")
def used_by(c: Corpus) -> DataFrame:
    return R.used_by_lists(_edges(c), 50).select("id", "part", F.array_join("used_by", ",").alias("users"))


@query(f"""WITH {ALL_EDGES},
up AS (SELECT dst AS id, src AS o, CAST((row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 20 AS BIGINT) AS part FROM edge),
down AS (SELECT src AS id, dst AS o, CAST((row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 20 AS BIGINT) AS part FROM edge),
place AS (SELECT id, part FROM up UNION SELECT id, part FROM down UNION SELECT id, CAST(0 AS BIGINT) FROM fx_components)
SELECT p.id, p.part, coalesce((SELECT string_agg(o, ',' ORDER BY o) FROM down d WHERE d.id = p.id AND d.part = p.part), '') AS depends_on,
  coalesce((SELECT string_agg(o, ',' ORDER BY o) FROM up u WHERE u.id = p.id AND u.part = p.part), '') AS used_by
FROM place p JOIN fx_components k ON k.id = p.id""")
def dependency_lists(c: Corpus) -> DataFrame:
    """The export form, every list in parts of 20."""
    rows = R.with_dependency_lists(c.components, _edges(c), 20)
    return rows.select("id", "part", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("used_by", ",").alias("used_by"))


# the written queue and its edges, read back
@query("""SELECT repo_id, dst AS source, src AS target, 'edge' AS what FROM fx_graph UNION ALL SELECT repo_id, id, NULL, 'node' FROM fx_graph_nodes""")
def order_files(c: Corpus) -> DataFrame:
    path = f"{shared_folder(c.spark)}/order-{uuid.uuid4().hex}"
    edges = cut(c.graph)
    write_order(G.processing_order(c.graph_nodes, edges), edges, path)
    queue = c.spark.read.parquet(f"{path}/processing_queue").select("repo_id", F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("node").alias("what"))
    return c.spark.read.parquet(f"{path}/dependencies").select("repo_id", "source", "target", F.lit("edge").alias("what")).unionByName(queue)


@query("""
SELECT src, dst, CAST(CASE WHEN s[1] = d[1] AND s[2] = d[2] THEN 0
  WHEN s[1] = d[1] OR s[2] = d[2] OR s[1] = d[2] THEN 1 WHEN s[2] = d[1] THEN 1 ELSE 2 END AS BIGINT) AS missed
FROM (SELECT src, dst, string_split(src, '.') AS s, string_split(dst, '.') AS d FROM fx_edges) t""")
def path_mismatches(c: Corpus) -> DataFrame:
    return c.edges.select("src", "dst", path_mismatch("src", "dst", F.lit("method")).cast("long").alias("missed"))


# --- graph ------------------------------------------------------------------

@query("""
SELECT n.id, coalesce(o.c, 0) AS n_depends_on, coalesce(i.c, 0) AS n_used_by FROM fx_nodes n
LEFT JOIN (SELECT src AS id, count(*) AS c FROM fx_edges GROUP BY 1) o USING (id)
LEFT JOIN (SELECT dst AS id, count(*) AS c FROM fx_edges GROUP BY 1) i USING (id)""")
def degrees(c: Corpus) -> DataFrame:
    return G.degrees(c.nodes, c.edges).select("id", "n_depends_on", "n_used_by")


LINKS, NODES = "SELECT dst AS source, src AS target FROM fx_edges", "SELECT id FROM fx_nodes"


@query(f"WITH {settled_sql(LINKS, NODES, 24)} SELECT id, round(score, 10) AS score FROM ranked, stop WHERE step = k")
def pagerank(c: Corpus) -> DataFrame:
    return G.pagerank(c.nodes, c.edges).where("converged").select("id", F.round("score", 10).alias("score"))


@query(f"WITH {settled_sql(LINKS, NODES, 24, '0.7225', False)} SELECT id, step AS iteration, round(score, 10) AS score FROM ranked")
def pagerank_history(c: Corpus) -> DataFrame:
    return G.pagerank_history(c.nodes, c.edges).select("id", "iteration", F.round("score", 10).alias("score"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT repo_id, id, scc_id FROM member")
def scc(c: Corpus) -> DataFrame:
    return G.scc(c.graph_nodes, c.graph).select("repo_id", "id", "scc_id")


@query(f"WITH RECURSIVE {CLOSURE} SELECT repo_id, src_scc, dst_scc FROM contracted")
def condense(c: Corpus) -> DataFrame:
    edges = cut(c.graph)
    return G.condense(cut(G.scc(c.graph_nodes, edges)), edges).select("repo_id", "src_scc", "dst_scc")


@query(f"""WITH RECURSIVE {CLOSURE}
SELECT repo_id, id, scc_id, level, row_number() OVER (PARTITION BY repo_id ORDER BY level, scc_id, id) AS pos
FROM member JOIN leveled ON g = root""")
def processing_order(c: Corpus) -> DataFrame:
    return G.processing_order(c.graph_nodes, cut(c.graph)).select("repo_id", "id", "scc_id", "level", "pos")


_OPENING = "'" + G.OPENING.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
_OUTSIDE = """chr(9) || '"' || other || '" [label="' || regexp_extract(other, '[^.]*$') || '" color=gray70 shape=ellipse style=dashed]'"""


def _node_sql(id_: str, type_: str, colour: str, width: str) -> str:
    """A node's line; a method's label is the last two names."""
    fill = f"CASE {type_} WHEN 'class' THEN '#a3c4f3' WHEN 'method' THEN '#fde4a3' WHEN 'function' THEN '#b3e6c3' END"
    label = f"CASE WHEN {type_} = 'method' THEN regexp_extract({id_}, '([^.]*)[.][^.]*$', 1) || '.<BR/>' || regexp_extract({id_}, '[^.]*$') ELSE regexp_extract({id_}, '[^.]*$') END"
    return (f"""chr(9) || '"' || {id_} || '" [label=<' || {label} || '<BR/><FONT POINT-SIZE="10" COLOR="gray30">' || {type_} || '</FONT>> color="' || """
            f"""{colour} || '" fillcolor="' || {fill} || '" penwidth=' || {width} || ']'""")


EGO = """
ego AS (
  SELECT src AS focal, 'depend_on' AS label, src AS from_id, dst AS to_id, dst AS other FROM fx_edges
  UNION ALL SELECT dst, 'uses', src, dst, src FROM fx_edges
  UNION ALL SELECT id, 'inherits', parent_id, id, parent_id FROM fx_parents)"""


@query(f"""WITH {EGO}
SELECT focal, label, from_id, to_id, c.id IS NULL AS is_external,
  CASE component_type WHEN 'class' THEN '#a3c4f3' WHEN 'method' THEN '#fde4a3' WHEN 'function' THEN '#b3e6c3' END AS fill
FROM ego LEFT JOIN fx_components c ON c.id = other""")
def ego_edges(c: Corpus) -> DataFrame:
    return G.ego_edges(c.components, cut(c.edges), cut(c.parents)).select(
        "focal", "label", "from_id", "to_id", "is_external", "fill")


@query("""
WITH touched AS (SELECT src AS id FROM fx_edges UNION SELECT dst FROM fx_edges UNION SELECT id FROM fx_parents)
SELECT repo_id, count(t.id) AS produced, count(*) - count(t.id) AS skipped FROM fx_components LEFT JOIN touched t USING (id) GROUP BY 1""")
def ego_counts(c: Corpus) -> DataFrame:
    return G.ego_counts(c.components, G.ego_edges(c.components, cut(c.edges), cut(c.parents)))


# one text for each neighbourhood, cut into the parts that the operator makes
@query(f"""WITH {EGO},
seen AS (SELECT e.*, o.component_type AS t FROM ego e JOIN fx_components f ON f.id = focal LEFT JOIN fx_components o ON o.id = other),
lines AS (
  SELECT DISTINCT focal, 0 AS sec, '' AS ord, {_OPENING} AS line FROM seen
  UNION ALL SELECT DISTINCT focal, 1, '', {_node_sql('focal', 'f.component_type', "'#d9534f'", "'2.5'")} FROM seen JOIN fx_components f ON f.id = focal
  UNION ALL SELECT DISTINCT focal, 2, other, CASE WHEN t IS NULL THEN {_OUTSIDE} ELSE {_node_sql('other', 't', "'black'", "'1.0'")} END FROM seen WHERE other <> focal
  UNION ALL SELECT focal, 3, label || chr(9) || from_id || chr(9) || to_id, chr(9) || '"' || from_id || '" -> "' || to_id || '" [fontcolor=gray50 fontsize=8 xlabel='
    || label || CASE WHEN label = 'inherits' THEN ' arrowhead=empty style=dashed' ELSE '' END || ']' FROM seen
  UNION ALL SELECT DISTINCT focal, 4, '', '}}' FROM seen),
placed AS (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY sec, ord) AS place FROM lines)
SELECT focal, CAST((place - 1) // 5000 AS BIGINT) AS part, string_agg(line, chr(10) ORDER BY place) AS dot FROM placed GROUP BY 1, 2""")
def ego_dot(c: Corpus) -> DataFrame:
    return G.ego_dot(c.components, G.ego_edges(c.components, cut(c.edges), cut(c.parents))).select("focal", "part", "dot")


# --- flagship ---------------------------------------------------------------

RANKED = f"""{ALL_EDGES},
{settled_sql("SELECT dst AS source, src AS target FROM edge", "SELECT id FROM fx_components", 32)},
score AS (SELECT id, round(score, 10) AS score FROM ranked, stop WHERE step = k)"""


@query(f"""WITH {RANKED},
o AS (SELECT src AS id, count(*) AS c FROM edge GROUP BY 1), i AS (SELECT dst AS id, count(*) AS c FROM edge GROUP BY 1),
r AS (SELECT src AS id, dst AS dep_id, row_number() OVER (PARTITION BY src ORDER BY s.score DESC, dst) AS pos
      FROM edge JOIN score s ON s.id = dst)
SELECT r.id, dep_id, pos, coalesce(o.c, 0) AS n_depends_on, coalesce(i.c, 0) AS n_used_by
FROM r LEFT JOIN o ON o.id = r.id LEFT JOIN i ON i.id = r.id WHERE pos <= 3""")
def top_dependencies(c: Corpus) -> DataFrame:
    components, edges = c.components, _shared(_edges(c))
    ranks = G.pagerank(components, edges).where("converged").withColumn("score", F.round("score", 10))
    return C.top_dependencies(components, edges, ranks, 3).select("id", "dep_id", "pos", "n_depends_on", "n_used_by")


def _shared(df: DataFrame) -> DataFrame:
    """Edges are read by several steps of a plan: compute them once."""
    return cut(df)
