"""Queries for the scalar expressions and the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.functions.tokens import REGEX, TOKEN_PATTERN, token_count, truncate_tokens
from codeloom.plans.corpus import Corpus
from codeloom.plans.registry import query
from codeloom.sources import records as R
from codeloom.sources.files import filter_relevant

_PATHS = """SELECT id, CASE k % 3 WHEN 0 THEN replace(relative_path, '.py', '/__init__.py') WHEN 1 THEN '__init__.py'
            ELSE relative_path END AS path FROM fx_components"""


@query(f"""
SELECT id, path, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module_path,
  CASE WHEN path = '__init__.py' THEN id
       WHEN path LIKE '%/__init__.py' THEN replace(replace(path, '/__init__.py', ''), '/', '.') || '.' || id
       ELSE replace(regexp_replace(path, '\\.py$', ''), '/', '.') || '.' || id END AS origin,
  replace(regexp_replace(path, '\\.py$', ''), '/', '.') || '.' || id AS loose_origin
FROM ({_PATHS}) t""")
def module_paths(c: Corpus) -> DataFrame:
    return c.sql(_PATHS).select(
        "id", "path", X.module_path("path").alias("module_path"), X.origin_path("path", "id").alias("origin"),
        X.origin_path("path", "id", strict=False).alias("loose_origin"))


@query("""
SELECT id, string_split(id, '.')[-1] AS last_segment,
  array_to_string(string_split(id, '.')[1:-2], '.') AS owner,
  CASE WHEN component_type = 'method' THEN array_to_string(string_split(id, '.')[-2:], '.') ELSE string_split(id, '.')[-1] END AS short,
  CASE WHEN component_type = 'method' THEN string_split(id, '.')[-2] || '.' || chr(10) || string_split(id, '.')[-1]
       ELSE string_split(id, '.')[-1] END AS label
FROM fx_components""")
def id_algebra(c: Corpus) -> DataFrame:
    return c.components.select(
        "id", X.last_seg("id").alias("last_segment"), X.owner_id("id").alias("owner"),
        X.short_name("id", "component_type").alias("short"), X.label("id", "component_type").alias("label"))


_TYPES = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Dict[("' || p_brand || '", ' || p_type || ')]'
            WHEN 1 THEN NULL ELSE p_name || ' | None' END AS type_text FROM {part}"""


@query(f"""
SELECT p_partkey, regexp_replace(replace(coalesce(type_text, ''), '"', ''''), '[\\s()]', '', 'g') AS normal
FROM ({_TYPES}) t""")
def type_normalize(c: Corpus) -> DataFrame:
    return c.sql(_TYPES).select("p_partkey", X.norm_type("type_text").alias("normal"))


_NAMES = """SELECT page_id, url AS name FROM {pages} UNION ALL SELECT 1000000 + p_partkey, ' ' || p_name || '.yml' FROM {part}
            UNION ALL SELECT 2000000 + p_partkey, replace(p_name, ' ', '') FROM {part}"""


@query(f"""
SELECT page_id, (name <> '' AND name NOT IN ('.', '..') AND NOT contains(name, '/') AND NOT contains(name, chr(92))) AS safe,
  CASE WHEN regexp_matches(clean, '\\.ya?ml$') THEN clean ELSE clean || '.yaml' END AS clean
FROM (SELECT page_id, name, regexp_replace(replace(trim(name), ' ', '_'), '[^a-zA-Z0-9_.-]', '', 'g') AS clean FROM ({_NAMES}) n) t""")
def safe_names(c: Corpus) -> DataFrame:
    return c.sql(_NAMES).select("page_id", X.is_safe_name("name").alias("safe"), X.sanitize_name("name").alias("clean"))


_PAGE_FILES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Docs/' WHEN 1 THEN 'src/tests/' WHEN 2 THEN 'testing/' ELSE 'src/' END
   || CASE page_id % 4 WHEN 0 THEN 'test_' ELSE '' END || replace(url, '://', '/')
   || CASE page_id % 5 WHEN 0 THEN '_test.py' ELSE '.py' END AS relative_path FROM {pages}"""


@query(f"""
SELECT page_id, relative_path FROM ({_PAGE_FILES}) t
WHERE NOT list_has_any(string_split(lower(relative_path), '/'), ['venv', '.venv', 'pycg-venv', '__pycache__', 'tests', 'test', '__macosx', 'scripts', 'docs', 'experiments'])
  AND NOT regexp_matches(relative_path, '(^|/)test_[^/]*$') AND NOT relative_path LIKE '%\\_test.py' ESCAPE '\\'""")
def relevant_files(c: Corpus) -> DataFrame:
    return filter_relevant(c.sql(_PAGE_FILES))


@query(r"""
SELECT doc_id, array_to_string(regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]')[2:4], chr(10)) AS lines
FROM {documents}""")
def line_slices(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", X.line_slice("text", F.lit(2), F.lit(4)).alias("lines"))


@query(f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS BIGINT) AS tokens,
  array_to_string(string_split(regexp_replace(text, '({TOKEN_PATTERN})', '\\1' || chr(65535), 'g'), chr(65535))[1:
    CASE WHEN len(regexp_extract_all(text, '{TOKEN_PATTERN}')) <= 40 THEN 1000000 ELSE 40 END], '') AS head
FROM {{documents}}""")
def token_budget(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", token_count("text", REGEX).alias("tokens"),
                              truncate_tokens("text", 40, REGEX).alias("head"))


@query("""
SELECT event_id, CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '1 day, ' ELSE CAST(d AS STRING) || ' days, ' END
  || CAST((s % 86400) // 3600 AS STRING) || ':' || lpad(CAST((s % 3600) // 60 AS STRING), 2, '0') || ':' || lpad(CAST(s % 60 AS STRING), 2, '0') AS elapsed,
  CAST(round(value, 0) AS BIGINT) AS rounded
FROM (SELECT event_id, value, CAST(floor(value * 4000) AS BIGINT) AS s, CAST(floor(value * 4000) AS BIGINT) // 86400 AS d FROM {events}) t""")
def elapsed(c: Corpus) -> DataFrame:
    return c.events.select("event_id", X.fmt_elapsed(F.col("value") * 4000).alias("elapsed"),
                           X.round_half_up("value").cast("long").alias("rounded"))


@query("""
SELECT id, '{"short_summary":' || to_json(short_summary) || ',"extended_summary":' || coalesce(to_json(extended_summary), 'null') || '}' AS context
FROM fx_docs""")
def context_docs(c: Corpus) -> DataFrame:
    doc = F.struct("short_summary", "extended_summary", F.lit(">>> f()").alias("examples"))
    return c.docs.select("id", X.context_doc(doc).alias("context"))


@query("""
SELECT id, coalesce(length(trim(short_summary)) > 0, false) AS summary, coalesce(length(trim(extended_summary)) > 0, false) AS description,
  k % 3 > 0 AS items, true AS number
FROM fx_docs""")
def presence(c: Corpus) -> DataFrame:
    items = F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("id"))
    return c.docs.select("id", X.is_present_text("short_summary").alias("summary"),
                         X.is_present_text("extended_summary").alias("description"),
                         X.is_present_list(items).alias("items"), X.is_present_value("k").alias("number"))


@query("""
SELECT repo_id, id, component_type, CAST(end_line AS BIGINT) AS end_line FROM (
  SELECT lower(module) AS repo_id, module || '.S' || CAST(s_suppkey AS STRING) AS id, 'class' AS component_type, s_suppkey AS end_line
  FROM {supplier} JOIN fx_module ON s_nationkey = n_nationkey
  UNION ALL
  SELECT lower(module), id, 'function', 0 FROM fx_function JOIN {customer} USING (c_custkey) JOIN fx_module ON c_nationkey = n_nationkey
  WHERE module NOT IN (SELECT module FROM {supplier} JOIN fx_module ON s_nationkey = n_nationkey)) t""")
def component_upsert(c: Corpus) -> DataFrame:
    """Modules that have suppliers replace their whole record, the others keep their functions."""
    current = c.sql("""SELECT module AS repo_id, id, 'function' AS component_type, CAST(0 AS BIGINT) AS end_line
                       FROM fx_function JOIN {customer} USING (c_custkey) JOIN fx_module ON c_nationkey = n_nationkey""")
    incoming = c.sql("""SELECT module AS repo_id, module || '.S' || CAST(s_suppkey AS STRING) AS id, 'class' AS component_type,
                        CAST(s_suppkey AS BIGINT) AS end_line FROM {supplier} JOIN fx_module ON s_nationkey = n_nationkey""")
    return R.upsert_records(current, incoming)


_RAW_RECORDS = """SELECT repo_id, CASE WHEN k % 29 = 0 THEN NULL ELSE id END AS id, component_type,
  relative_path AS file_path, CASE WHEN k % 31 = 0 THEN NULL ELSE relative_path END AS relative_path,
  CASE WHEN k % 5 = 0 THEN NULL ELSE start_line END AS start_line, end_line,
  CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 = 0 END AS has_docstring FROM fx_components"""


@query(f"""
SELECT id, component_type, relative_path, coalesce(start_line, 0) AS start_line, end_line,
  coalesce(has_docstring, false) AS has_docstring, CAST(0 AS BIGINT) AS n_users, '' AS signature
FROM ({_RAW_RECORDS}) t WHERE id IS NOT NULL AND relative_path IS NOT NULL""")
def component_records(c: Corpus) -> DataFrame:
    """Stored JSON, written and read back column by column with its defaults."""
    from codeloom.schemas import COMPONENT_RECORD
    text = c.sql(_RAW_RECORDS).select(F.to_json(F.struct("*")).alias("json"))
    rows = text.select(F.from_json("json", COMPONENT_RECORD, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return R.tolerant_components(rows).select(
        "id", "component_type", "relative_path", "start_line", "end_line", "has_docstring",
        F.size("used_by").cast("long").alias("n_users"), F.col("component_signature").alias("signature"))


@query("""
SELECT e.id, CASE WHEN n.id IS NULL THEN '' ELSE 'rec/' || replace(e.id, '.', '_') || '.png' END AS graph_url
FROM fx_components e LEFT JOIN (SELECT src AS id FROM fx_edges UNION SELECT dst FROM fx_edges) n ON n.id = e.id""")
def graph_urls(c: Corpus) -> DataFrame:
    ids = c.edges.select("repo_id", F.explode(F.array("src", "dst")).alias("id"))
    return R.attach_graph_urls(c.components, ids, "rec").select("id", "graph_url")


@query("""SELECT DISTINCT repo_id, caller_id AS caller_key, raw_callee AS callee FROM fx_calls""")
def callgraph_json(c: Corpus) -> DataFrame:
    """Calls packed as one JSON object per caller, read back by the call graph scan."""
    packed = c.calls.groupBy("repo_id", "caller_id").agg(F.collect_set("raw_callee").alias("l"))
    docs = packed.select("repo_id", F.to_json(F.create_map("caller_id", "l")).alias("json"))
    return R.explode_callgraph(docs)


@query("""
SELECT repo_id, 'name ' || repo_id AS name FROM (SELECT DISTINCT module AS repo_id FROM fx_module) t""")
def record_list(c: Corpus) -> DataFrame:
    rows = c.sql("""SELECT module AS repo_id, 'name ' || module AS name, id FROM fx_function
                    JOIN {customer} USING (c_custkey) RIGHT JOIN fx_module ON c_nationkey = n_nationkey""")
    return R.list_records(rows)
