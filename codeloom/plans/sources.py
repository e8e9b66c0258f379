"""Queries over the Python files derived from the part table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import module_path
from codeloom.operators import extract as E
from codeloom.operators import graph as G
from codeloom.operators import resolve as R
from codeloom.operators import trace as T
from codeloom.operators.helpfulness import has_parameters
from codeloom.plans.corpus import Corpus
from codeloom.plans.registry import query
from codeloom.session import cut, shared_folder
from codeloom.sources.files import list_inputs
from codeloom.sources.records import read_components, write_components
from codeloom.sources.tree import read_tree, write_tree
from codeloom.sources.zips import scan_archives, write_archives


def files(c: Corpus) -> DataFrame:
    return c.sources.withColumns({"path": F.col("relative_path"), "module_path": module_path("relative_path")})


def facts(c: Corpus) -> DataFrame:
    return cut(E.extract_facts(files(c)))


def table_facts(c: Corpus) -> DataFrame:
    """The facts that a symbol table is made of; where nothing else reads them, the others are not kept."""
    return cut(E.extract_facts(files(c)).where(F.col("fact").isin(*T.TABLE_FACTS)))


def seen_once(c: Corpus, view: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What one view makes of the facts; where nothing else reads them, the answer is kept and not the facts."""
    return cut(view(E.extract_facts(files(c))))


# --- expected rows: what the file templates contain --------------------------

_P = """p AS (SELECT p_partkey AS k, replace(folder, '/', '.') AS m, folder || '/p' || CAST(p_partkey AS STRING) || '.py' AS file,
  replace(folder, '/', '.') || '.p' || CAST(p_partkey AS STRING) AS mod, 'P' || CAST(p_partkey AS STRING) AS cls,
  'make_p' || CAST(p_partkey AS STRING) AS fn, p_name, p_brand, p_type, p_size, folder FROM fx_method WHERE p_type <> 'PROMO'),
b AS (SELECT module AS m, module || '.base' AS mod, folder || '/base.py' AS file, folder, n_nationkey AS n FROM fx_module)"""

_COMPONENTS = """comp AS (
  SELECT mod || '.' || cls AS id, 'class' AS component_type, file, 5 AS s, 19 AS e, p_name AS doc, 'class ' || cls || '(Base):' AS sig FROM p
  UNION ALL SELECT mod || '.' || cls || '.__init__', 'method', file, 10, 11, '', 'def __init__(self, brand: str=''' || p_brand || '''):' FROM p
  UNION ALL SELECT mod || '.' || cls || '.price', 'method', file, 13, 16, '', 'def price(self, qty: int) -> float:' FROM p
  UNION ALL SELECT mod || '.' || cls || '.items', 'method', file, 18, 19, '', 'async def items(self):' FROM p
  UNION ALL SELECT mod || '.' || fn, 'function', file, 21, 24, 'Build one.', 'def ' || fn || '(brand, *args):' FROM p
  UNION ALL SELECT mod || '.registered', 'function', file, 2, 3, '', 'def registered(cls):' FROM b
  UNION ALL SELECT mod || '.Root', 'class', file, 4, 6, '', 'class Root:' FROM b
  UNION ALL SELECT mod || '.Root.describe', 'method', file, 5, 6, '', 'def describe(self):' FROM b
  UNION ALL SELECT mod || '.Base', 'class', file, 7, 8, '', 'class Base(Root):' FROM b
  UNION ALL SELECT mod || '.helper', 'function', file, 9, 10, '', 'def helper(x):' FROM b)"""


@query(f"""WITH {_P}, {_COMPONENTS} SELECT id, component_type, file AS relative_path, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line,
  doc <> '' AS has_docstring, doc AS docstring, sig AS signature FROM comp""")
def extract_components(c: Corpus) -> DataFrame:
    return seen_once(c, lambda found: E.extract_components(found).select(
        "id", "component_type", "relative_path", "start_line", "end_line", "has_docstring", "docstring", "signature"))


@query("SELECT folder || '/p' || CAST(p_partkey AS STRING) || '.py' AS file_path FROM fx_method WHERE p_type = 'PROMO'")
def parse_errors(c: Corpus) -> DataFrame:
    return E.parse_errors(facts(c)).select("file_path")


_IMPORTS = """imp AS (
  SELECT file, 'Base' AS visible, m || '.base' AS module, 'Base' AS original, 0 AS level, false AS star, folder || '/base.py' AS target FROM p
  UNION ALL SELECT file, 'reg', m || '.base', 'registered', 0, false, folder || '/base.py' FROM p
  UNION ALL SELECT file, '*', 'base', '*', 1, true, folder || '/base.py' FROM p
  UNION ALL SELECT file, 'warnings', 'warnings', 'warnings', 0, false, NULL FROM p
  UNION ALL SELECT x.file, y.mod, y.mod, y.mod, 0, false, y.file FROM b x JOIN b y ON y.n = x.n + 1
  UNION ALL SELECT folder || '/__init__.py', v, 'base', v, 1, false, file FROM b, (SELECT unnest(['Base', 'helper']) AS v) t)"""


@query(f"WITH {_P}, {_IMPORTS} SELECT file AS file_path, visible AS visible_name, module, original AS original_name, CAST(level AS BIGINT) AS level, star AS is_wildcard FROM imp")
def extract_imports(c: Corpus) -> DataFrame:
    return E.extract_imports(facts(c)).select("file_path", "visible_name", "module", "original_name", "level", "is_wildcard")


@query(f"WITH {_P}, {_IMPORTS} SELECT file AS file_path, visible AS visible_name, target AS target_file FROM imp")
def module_files(c: Corpus) -> DataFrame:
    return R.module_files(E.extract_imports(facts(c)), files(c)).select("file_path", "visible_name", "target_file")


@query(f"""WITH {_P} SELECT * FROM (
  SELECT mod || '.' || cls || x AS component_id, 'self' AS name, 'positional' AS kind, '' AS annotation, '' AS default_text, CAST(0 AS BIGINT) AS position
    FROM p, (SELECT unnest(['', '.__init__', '.price', '.items']) AS x) t
  UNION ALL SELECT mod || '.' || cls || x, 'brand', 'positional', 'str', '''' || p_brand || '''', 1 FROM p, (SELECT unnest(['', '.__init__']) AS x) t
  UNION ALL SELECT mod || '.' || cls || '.price', 'qty', 'positional', 'int', '', 1 FROM p
  UNION ALL SELECT mod || '.' || fn, 'brand', 'positional', '', '', 0 FROM p UNION ALL SELECT mod || '.' || fn, 'args', 'vararg', '', '', 1 FROM p
  UNION ALL SELECT mod || '.registered', 'cls', 'positional', '', '', 0 FROM b UNION ALL SELECT mod || '.helper', 'x', 'positional', '', '', 0 FROM b
  UNION ALL SELECT mod || '.Root.describe', 'self', 'positional', '', '', 0 FROM b) q""")
def extract_params(c: Corpus) -> DataFrame:
    none = F.lit("")
    return E.extract_params(facts(c)).select("component_id", "name", "kind", F.coalesce("annotation", none).alias("annotation"),
                                             F.coalesce("default_text", none).alias("default_text"), "position")


@query(f"""WITH {_P} SELECT component_id, returns_value, has_return_annotation, has_yield, has_raise, has_warn, has_params, has_attributes, CAST(n AS BIGINT) AS n_lines FROM (
  SELECT mod || '.' || cls AS component_id, true AS returns_value, false AS has_return_annotation, true AS has_yield, true AS has_raise, false AS has_warn, true AS has_params, true AS has_attributes, 14 AS n FROM p
  UNION ALL SELECT mod || '.' || cls || '.__init__', false, false, false, false, false, true, false, 2 FROM p
  UNION ALL SELECT mod || '.' || cls || '.price', true, true, false, true, false, true, false, 4 FROM p
  UNION ALL SELECT mod || '.' || cls || '.items', false, false, true, false, false, false, false, 2 FROM p
  UNION ALL SELECT mod || '.' || fn, true, false, false, false, true, true, false, 4 FROM p
  UNION ALL SELECT mod || '.registered', true, false, false, false, false, true, false, 2 FROM b
  UNION ALL SELECT mod || '.helper', true, false, false, false, false, true, false, 2 FROM b
  UNION ALL SELECT mod || '.Root', true, false, false, false, false, false, false, 3 FROM b
  UNION ALL SELECT mod || '.Root.describe', true, false, false, false, false, false, false, 2 FROM b
  UNION ALL SELECT mod || '.Base', false, false, false, false, false, false, true, 2 FROM b) q""")
def extract_code_facts(c: Corpus) -> DataFrame:
    return E.extract_code_facts(facts(c)).select("component_id", "returns_value", "has_return_annotation", "has_yield", "has_raise",
                                                 "has_warn", "has_params", "has_attributes", "n_lines")


@query(f"""WITH {_P} SELECT mod || '.' || cls AS component_id, 'size' AS name, 'class_level' AS origin FROM p
  UNION ALL SELECT mod || '.' || cls, 'brand', 'init' FROM p UNION ALL SELECT mod || '.Base', 'kind', 'class_level' FROM b""")
def extract_attributes(c: Corpus) -> DataFrame:
    return seen_once(c, lambda found: E.extract_attributes(found).select("component_id", "name", "origin"))


@query(f"""WITH {_P} SELECT component_id, name FROM (
  SELECT mod || '.' || cls AS component_id, unnest(['Base', 'reg', 'size', 'self.brand', 'brand', 'qty', 'helper']) AS name FROM p
  UNION ALL SELECT mod || '.' || cls || '.__init__', unnest(['self.brand', 'brand']) FROM p
  UNION ALL SELECT mod || '.' || cls || '.price', 'qty' FROM p
  UNION ALL SELECT mod || '.' || cls || '.items', unnest(['helper', 'self.brand']) FROM p
  UNION ALL SELECT mod || '.' || fn, unnest(['warnings.warn', cls, 'brand']) FROM p
  UNION ALL SELECT mod || '.Base', unnest(['Root', 'kind']) FROM b
  UNION ALL SELECT mod || '.helper', 'x' FROM b) q""")
def extract_refs(c: Corpus) -> DataFrame:
    return seen_once(c, lambda found: E.extract_refs(found).select("component_id", "name"))


@query(f"""WITH {_P} SELECT component_id, name, qualified_name FROM (
  SELECT mod || '.' || cls AS component_id, 'Base' AS name, m || '.base.Base' AS qualified_name FROM p
  UNION ALL SELECT mod || '.' || cls, 'reg', m || '.base.registered' FROM p
  UNION ALL SELECT mod || '.' || cls, n, mod || '.' || n FROM p, (SELECT unnest(['size', 'self.brand', 'brand', 'qty', 'helper']) AS n) t
  UNION ALL SELECT mod || '.' || cls || '.__init__', n, mod || '.' || n FROM p, (SELECT unnest(['self.brand', 'brand']) AS n) t
  UNION ALL SELECT mod || '.' || cls || '.price', 'qty', mod || '.qty' FROM p
  UNION ALL SELECT mod || '.' || cls || '.items', n, mod || '.' || n FROM p, (SELECT unnest(['helper', 'self.brand']) AS n) t
  UNION ALL SELECT mod || '.' || fn, 'warnings.warn', 'warnings.warn' FROM p
  UNION ALL SELECT mod || '.' || fn, cls, mod || '.' || cls FROM p UNION ALL SELECT mod || '.' || fn, 'brand', mod || '.brand' FROM p
  UNION ALL SELECT mod || '.Base', v, mod || '.' || v FROM b, (SELECT unnest(['Root', 'kind']) AS v) t
  UNION ALL SELECT mod || '.helper', 'x', mod || '.x' FROM b) q""")
def qualify_refs(c: Corpus) -> DataFrame:
    """Imports as written: a relative wildcard has no module name, ``wildcard_names`` meets it by file."""
    found = facts(c)
    refs = E.extract_refs(found).withColumn("module_path", module_path("file_path"))
    return R.qualify_refs(refs, E.extract_imports(found), E.extract_components(found)).select("component_id", "name", "qualified_name")


@query(f"""WITH {_P} SELECT file AS file_path, v AS visible_name, m || '.base.' || v AS target
FROM p, (SELECT unnest(['Base', 'Root', 'helper', 'registered']) AS v) t""")
def wildcard_names(c: Corpus) -> DataFrame:
    """``from .base import *`` in every file, met by the file it leads to."""
    found = facts(c)
    table = T.symbol_table(found, files(c))
    return R.expand_wildcards(table.imports, E.extract_components(found)).select("file_path", "visible_name", "target")


# the graph writes modules as paths; a caller that is no component matches nothing
@query(f"""WITH {_P} SELECT mod || '.' || cls || '.price' AS caller_id, 'method' AS caller_type, 'ValueError' AS raw_callee FROM p
UNION ALL SELECT mod || '.' || fn, 'function', replace(mod, '.', '/') || '.' || cls FROM p""")
def caller_match(c: Corpus) -> DataFrame:
    graph = c.sql("""SELECT 'corpus' AS repo_id, folder || '/p' || CAST(p_partkey AS STRING) || '.P' || CAST(p_partkey AS STRING) || '.price' AS caller_key,
        'ValueError' AS callee FROM fx_method
        UNION ALL SELECT 'corpus', folder || '/p' || CAST(p_partkey AS STRING) || '.make_p' || CAST(p_partkey AS STRING),
        folder || '/p' || CAST(p_partkey AS STRING) || '.P' || CAST(p_partkey AS STRING) FROM fx_method
        UNION ALL SELECT 'corpus', folder || '/p' || CAST(p_partkey AS STRING) || '.gone', 'x' FROM fx_method""")
    return R.match_callers(E.extract_components(facts(c)), graph).select("caller_id", "caller_type", "raw_callee")


# calls by the call graph and, where nothing else fits, by the imports; members; bases and decorators
@query(f"""WITH RECURSIVE {_P}, {_COMPONENTS}, near AS (SELECT x.m, min(y.m) AS first FROM b x JOIN b y ON y.n BETWEEN x.n AND x.n + 5 GROUP BY 1),
edge AS MATERIALIZED (
  SELECT mod || '.' || fn AS src, mod || '.' || cls AS dst FROM p
  UNION SELECT mod || '.' || fn, first || '.base.helper' FROM p JOIN near USING (m)
  UNION SELECT mod || '.' || fn, first || '.base.Root.describe' FROM p JOIN near USING (m)
  UNION SELECT mod || '.' || cls, mod || '.' || cls || v FROM p, (SELECT unnest(['.price', '.items']) AS v) t
  UNION SELECT mod || '.Root', mod || '.Root.describe' FROM b
  UNION SELECT mod || '.' || cls, m || '.base.Base' FROM p UNION SELECT mod || '.Base', mod || '.Root' FROM b
  UNION SELECT mod || '.' || cls, m || '.base.registered' FROM p),
step AS (SELECT id, CAST(0 AS BIGINT) AS lvl FROM comp UNION SELECT e.src, s.lvl + 1 FROM step s JOIN edge e ON e.dst = s.id)
SELECT id, max(lvl) AS level, (SELECT count(*) FROM edge WHERE src = id) AS n_depends_on, (SELECT count(*) FROM edge WHERE dst = id) AS n_used_by
FROM step GROUP BY id""")
def sources_to_order(c: Corpus) -> DataFrame:
    """From source files to the order of work, with all kinds of edges and the import crawl as the last resort."""
    found = facts(c)
    comps, table = cut(E.extract_components(found)), T.symbol_table(found, files(c))
    graph = c.sql("""SELECT 'corpus' AS repo_id, folder || '/p' || CAST(p_partkey AS STRING) || '.make_p' || CAST(p_partkey AS STRING) AS caller_key,
        explode(array(folder || '/p' || CAST(p_partkey AS STRING) || '.P' || CAST(p_partkey AS STRING), 'far.helper', 'q.Base.describe', 'no.such.thing', '<builtin>.print')) AS callee
        FROM fx_method""")
    calls = R.resolve(R.match_callers(comps, graph), comps, "main-alternatif", fallback=lambda missing: T.resolve_reimports(missing, comps, table))
    edges = cut(R.all_edges(calls, R.class_method_edges(comps), T.declared_edges(found, comps, table)))
    return G.levels(comps, edges).join(G.degrees(comps, edges), ["repo_id", "id"]).select("id", "level", "n_depends_on", "n_used_by")


# a leading self or cls is no parameter
@query(f"""WITH {_P}, {_COMPONENTS} SELECT id FROM comp WHERE component_type <> 'class'
  AND NOT (id LIKE '%.items' OR id LIKE '%.describe' OR id LIKE '%.registered')""")
def with_parameters(c: Corpus) -> DataFrame:
    found = facts(c)
    comps = E.extract_components(found).where("component_type <> 'class'")
    return has_parameters(comps, E.extract_params(found)).select("id")


@query(f"""WITH {_P}, {_COMPONENTS} SELECT caller AS component_id, name FROM (
  SELECT mod || '.' || fn AS caller, unnest([m || '.base.helper', m || '.nothing', 'numpy.' || cls]) AS name FROM p) q
  WHERE name IN (SELECT id FROM comp) OR split_part(name, '.', 1) IN (SELECT split_part(module, '.', 1) FROM fx_module)""")
def known_refs(c: Corpus) -> DataFrame:
    comps = E.extract_components(facts(c))
    made = comps.where("component_type = 'function' AND id LIKE '%.make%'")
    top = F.regexp_extract("id", r"^[^.]*\.[^.]*", 0)
    refs = made.select("repo_id", F.col("id").alias("component_id"), F.explode(F.array(
        F.concat(top, F.lit(".base.helper")), F.concat(top, F.lit(".nothing")),
        F.concat(F.lit("numpy.P"), F.regexp_extract("id", r"(\d+)$", 1)))).alias("name"))
    return R.filter_known(refs, comps, E.modules(files(c))).select("component_id", "name")


@query(f"""WITH {_P} SELECT mod || '.' || cls AS src, m || '.base.Base' AS dst, 'inherits' AS kind FROM p
  UNION ALL SELECT mod || '.Base', mod || '.Root', 'inherits' FROM b
  UNION ALL SELECT mod || '.' || cls, m || '.base.registered', 'decorates' FROM p""")
def trace_origins(c: Corpus) -> DataFrame:
    """Inheritance and decorator edges: every base and decorator name followed to its definition."""
    found = facts(c)
    comps, table = cut(E.extract_components(found)), T.symbol_table(found, files(c))
    return T.declared_edges(found, comps, table).select("src", "dst", "kind")


@query(f"""WITH {_P} SELECT file, name, start_file, symbol FROM (
  SELECT file, 'Base.describe' AS name, folder || '/base.py' AS start_file, 'Base.describe' AS symbol FROM p
  UNION ALL SELECT file, 'reg', folder || '/base.py', 'registered' FROM p
  UNION ALL SELECT file, 'registered.x', folder || '/base.py', 'registered.x' FROM p
  UNION ALL SELECT file, 'other', folder || '/base.py', 'other' FROM p
  UNION ALL SELECT x.file, y.mod || '.Base', y.file, 'Base' FROM b x JOIN b y ON y.n = x.n + 1) q""")
def best_import(c: Corpus) -> DataFrame:
    table = T.symbol_table(facts(c), files(c))
    asked = c.sql("""SELECT 'corpus' AS repo_id, folder || '/p' || CAST(p_partkey AS STRING) || '.py' AS file,
        explode(array('Base.describe', 'reg', 'registered.x', 'other')) AS name FROM fx_method
        UNION ALL SELECT 'corpus', m.folder || '/base.py', n.module || '.base.Base' FROM fx_module m JOIN fx_module n ON n.n_nationkey = m.n_nationkey + 1""")
    return T.best_import(asked, table).select("file", "name", "start_file", "symbol")


@query(f"""WITH {_P},
far AS (SELECT x.n AS n, y.folder, y.file, split_part(y.folder, '/', 1) || '/__init__.py' AS region, y.n - x.n + 1 AS depth FROM b x JOIN b y ON y.n BETWEEN x.n + 1 AND x.n + 5),
visit AS (
  SELECT file AS seed, file, '' AS filter, 0 AS depth FROM p
  UNION ALL SELECT file, folder || '/base.py', f, 1 FROM p, (SELECT unnest(['', 'Base', 'registered']) AS f) t
  UNION ALL SELECT p.file, far.file, '', depth FROM p JOIN b USING (folder) JOIN far USING (n)
  UNION ALL SELECT p.file, far.folder || '/__init__.py', '', depth FROM p JOIN b USING (folder) JOIN far USING (n)
  UNION ALL SELECT p.file, far.region, '', depth FROM p JOIN b USING (folder) JOIN far USING (n))
SELECT seed, file, filter, CAST(min(depth) AS BIGINT) AS depth FROM visit GROUP BY 1, 2, 3""")
def import_crawl(c: Corpus) -> DataFrame:
    table = T.symbol_table(table_facts(c), files(c))
    seeds = table.imports.where("visible_name = 'Base' AND level = 0").select("repo_id", F.col("file_path").alias("seed"))
    return T.crawl_imports(seeds, cut(T.import_edges(table))).select("seed", "file", F.coalesce("filter", F.lit("")).alias("filter"), "depth")


# from every file, however far imports lead; a file that cannot be parsed imports nothing
@query(f"""WITH {_P},
far AS (SELECT x.folder AS here, y.folder, y.file, split_part(y.folder, '/', 1) || '/__init__.py' AS region FROM b x JOIN b y ON y.n > x.n),
start AS (SELECT file AS seed, folder AS here FROM p UNION ALL SELECT file, folder FROM b)
SELECT relative_path AS seed, relative_path AS file, '' AS filter FROM fx_sources
UNION SELECT file, folder || '/base.py', f FROM p, (SELECT unnest(['', 'Base', 'registered']) AS f) t
UNION SELECT seed, file, '' FROM start JOIN far USING (here)
UNION SELECT seed, folder || '/__init__.py', '' FROM start JOIN far USING (here)
UNION SELECT seed, region, '' FROM start JOIN far USING (here)""")
def import_reach(c: Corpus) -> DataFrame:
    table = T.symbol_table(table_facts(c), files(c))
    seeds = table.files.select("repo_id", F.col("file").alias("seed"))
    return T.reached_files(seeds, cut(T.import_edges(table))).select("seed", "file", F.coalesce("filter", F.lit("")).alias("filter"))


# the package files reached by the crawl re-export the same names; of equals the smallest id is taken
@query(f"""WITH {_P}, near AS (SELECT x.m, min(y.m) AS first FROM b x JOIN b y ON y.n BETWEEN x.n AND x.n + 5 GROUP BY 1)
SELECT mod || '.' || fn AS caller_id, 'far.helper' AS raw_callee, first || '.base.helper' AS callee_id FROM p JOIN near USING (m)
UNION ALL SELECT mod || '.' || fn, 'q.Base.describe', first || '.base.Root.describe' FROM p JOIN near USING (m)""")
def resolve_reimports(c: Corpus) -> DataFrame:
    found = facts(c)
    comps, table = cut(E.extract_components(found)), T.symbol_table(found, files(c))
    calls = comps.where("component_type = 'function' AND id LIKE '%.make%'").select(
        "repo_id", F.col("id").alias("caller_id"), F.explode(F.array(F.lit("far.helper"), F.lit("q.Base.describe"), F.lit("no.such.thing"))).alias("raw_callee"))
    return T.resolve_reimports(calls, comps, table).select("caller_id", "raw_callee", "callee_id")


@query(f"""WITH {_P}, {_COMPONENTS} SELECT id, CASE WHEN component_type = 'method' THEN 'no_span' ELSE 'ok' END AS status FROM comp
  UNION ALL SELECT folder || '/p' || CAST(p_partkey AS STRING) || '.py', 'unparsable' FROM fx_method WHERE p_type = 'PROMO'""")
def hydrate(c: Corpus) -> DataFrame:
    """Stored methods are one line longer than in the files; unparsable files have a stored row too."""
    found = facts(c)
    stored = E.extract_components(found).withColumn("end_line", F.col("end_line") + F.when(F.col("component_type") == "method", 1).otherwise(0)).select(
        "repo_id", "id", "relative_path", "start_line", "end_line")
    broken = E.parse_errors(found).select("repo_id", F.col("file_path").alias("id"), F.col("file_path").alias("relative_path"),
                                          F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"))
    return E.hydrate(stored.unionByName(broken), files(c), found).select("id", "status")


@query(f"""WITH {_P} SELECT mod || '.' || cls AS id, concat_ws(chr(10), '@reg', 'class ' || cls || '(Base):', '    \"\"\"' || p_name || '\"\"\"',
    '    size: int = ' || CAST(p_size AS STRING), '', '    def __init__(self, brand: str = ''' || p_brand || '''):', '        self.brand = brand') AS skeleton FROM p
  UNION ALL SELECT mod || '.Root', concat_ws(chr(10), 'class Root:', '    def describe(self):', '        return 1') FROM b
  UNION ALL SELECT mod || '.Base', concat_ws(chr(10), 'class Base(Root):', '    kind = ''base''') FROM b""")
def class_skeletons(c: Corpus) -> DataFrame:
    return E.class_skeletons(E.extract_components(facts(c)), files(c)).select("id", "skeleton")


# --- files and archives ------------------------------------------------------

def _by_nation(c: Corpus) -> DataFrame:
    """The derived files, a repository for each nation's folder and one for each region's own package file."""
    parts = F.split("relative_path", "/")
    deep = F.size(parts) > 2
    return c.sources.select(F.when(deep, F.concat_ws("-", parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0]).alias("repo_id"),
                            F.substring_index("relative_path", "/", -1).alias("relative_path"), "source")


_FILES = """SELECT CASE WHEN length(relative_path) - length(replace(relative_path, '/', '')) > 1 THEN split_part(relative_path, '/', 1) || '-' || split_part(relative_path, '/', 2)
  ELSE split_part(relative_path, '/', 1) END AS repo_id, CASE WHEN length(relative_path) - length(replace(relative_path, '/', '')) > 1
  THEN split_part(relative_path, '/', 3) ELSE split_part(relative_path, '/', 2) END AS name, source FROM fx_sources"""


@query(f"SELECT repo_id, 'src/' || name AS relative_path, replace('src/' || regexp_replace(name, '[.]py$', ''), '/', '.') AS module_path, source FROM ({_FILES}) f")
def scan_tree(c: Corpus) -> DataFrame:
    """The derived sources written as files, with tests and an excluded folder beside them, and read back as one data source."""
    root = f"{shared_folder(c.spark)}/tree-{uuid.uuid4().hex}"
    rows = _by_nation(c).withColumn("relative_path", F.concat(F.lit("src/"), F.col("relative_path")))
    besides = rows.select("repo_id").distinct().select("repo_id", F.explode(F.array(F.lit("tests/t.py"), F.lit("src/test_x.py"), F.lit("notes.md"))).alias("relative_path"), F.lit("x").alias("source"))
    write_tree(rows.unionByName(besides), root)
    return read_tree(c.spark, root).select("repo_id", "relative_path", "module_path", "source")


@query(f"SELECT repo_id, name AS relative_path, source FROM ({_FILES}) f")
def scan_zips(c: Corpus) -> DataFrame:
    """The same files packed into one zip for each repository and read back by member."""
    folder = f"{shared_folder(c.spark)}/zips-{uuid.uuid4().hex}"
    write_archives(_by_nation(c), folder)
    return scan_archives(c.spark, folder).select("repo_id", "relative_path", "source")


@query(f"SELECT repo_id || '.zip' AS name, true AS has_size FROM ({_FILES}) f GROUP BY 1")
def file_inventory(c: Corpus) -> DataFrame:
    """Names and sizes of the uploads; contents are not read."""
    folder = f"{shared_folder(c.spark)}/zips-{uuid.uuid4().hex}"
    write_archives(_by_nation(c), folder)
    return list_inputs(c.spark, folder).select("name", (F.col("size") > 0).alias("has_size"))


@query(f"""WITH {_P}, {_COMPONENTS} SELECT id, component_type, file AS relative_path, CAST(s AS BIGINT) AS start_line, doc <> '' AS has_docstring FROM comp""")
def component_export(c: Corpus) -> DataFrame:
    """Components written as stored records, without their source, and read back."""
    path = f"{shared_folder(c.spark)}/export-{uuid.uuid4().hex}"
    write_components(E.extract_components(E.extract_facts(files(c))), path)
    return read_components(c.spark, path).select("id", "component_type", "relative_path", "start_line", "has_docstring")
