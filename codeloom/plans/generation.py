"""Queries for context assembly, verification and generation rounds."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tokens import REGEX, TOKEN_PATTERN, from_codec, token_count, truncate_tokens
from codeloom.operators import context as C
from codeloom.operators import generate as N
from codeloom.operators import graph as G
from codeloom.operators import verify as V
from codeloom.operators.skew import lookup_join
from codeloom.plans.corpus import Corpus
from codeloom.plans.graphs import CLOSURE
from codeloom.plans.registry import query
from codeloom.session import cut, shared_folder

# --- choosing parts ---------------------------------------------------------

_SCORE = "score AS (SELECT n.id, CAST(count(e.src) AS DOUBLE) AS score FROM fx_components n LEFT JOIN fx_edges e ON e.dst = n.id GROUP BY 1)"


def scores(c: Corpus, edges: DataFrame | None = None) -> DataFrame:
    return G.degrees(c.components, c.edges if edges is None else edges).select("repo_id", "id", F.col("n_used_by").cast("double").alias("score"))


@query(f"""WITH {_SCORE} SELECT src AS id, dst AS part_id, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS pos
FROM fx_edges JOIN score ON id = dst""")
def ranked_deps(c: Corpus) -> DataFrame:
    edges = cut(c.edges)
    return C.ranked_deps(c.components, edges, cut(scores(c, edges)), cut(c.parents)).select("id", "part_id", "score", "pos")


@query(f"""WITH {_SCORE} SELECT p.id, parent_id AS part_id, row_number() OVER (PARTITION BY p.id ORDER BY score DESC, parent_id) AS pos
FROM fx_parents p JOIN score s ON s.id = parent_id""")
def ranked_parents(c: Corpus) -> DataFrame:
    return C.ranked_parents(c.parents, scores(c)).select("id", "part_id", "pos")


@query("""SELECT m.src AS id, m.dst AS part_id, CASE WHEN length(short_summary) >= 30 THEN 'documentation' ELSE 'source_code' END AS type,
  CASE WHEN length(short_summary) >= 30 THEN short_summary ELSE 'src of ' || d.id END AS content FROM fx_edges m JOIN fx_docs d ON d.id = m.dst""")
def dep_content(c: Corpus) -> DataFrame:
    edges = cut(c.edges)
    ranked = C.ranked_deps(c.components, edges, cut(scores(c, edges)))
    comps = c.components.withColumn("source_code", F.concat(F.lit("src of "), F.col("id")))
    texts = c.docs.select("repo_id", "id", F.col("short_summary").alias("docstring"))
    return C.part_content(ranked, comps, texts, C.DEPENDENCY_DOC_LENGTH, "dependency").select("id", "part_id", "type", "content")


@query("SELECT id, class_id AS part_id, 'class ' || class_id AS content FROM fx_method")
def class_context(c: Corpus) -> DataFrame:
    skeletons = c.components.where("component_type = 'class'").withColumn("skeleton", F.concat(F.lit("class "), F.col("id")))
    return C.class_context(c.components, skeletons).select("id", "part_id", "content")


@query("""SELECT id, part_id, pos FROM (
  SELECT dst AS id, src AS part_id, row_number() OVER (PARTITION BY dst ORDER BY end_line - start_line + 1, src) AS pos
  FROM fx_edges JOIN fx_components u ON u.id = src) t WHERE pos <= 2""")
def usage_samples(c: Corpus) -> DataFrame:
    return C.usage_samples(c.components, c.edges).select("id", "part_id", "pos")


# --- rendering and pruning ---------------------------------------------------

_KINDS = ["class", "parent", "dependency", "usage", "external"]


def _s(text: str) -> str:
    """A Python text as an SQL expression both engines read alike."""
    return " || chr(10) || ".join(f"'{line}'" for line in text.split("\n"))


_CODE = f"{_s(chr(10) + '```python' + chr(10))} || content || {_s(chr(10) + '```')}"
_BLOCK = f"""CASE kind WHEN 'class' THEN {_s('```python' + chr(10))} || content || {_s(chr(10) + '```')}
  WHEN 'parent' THEN '**Parent Class:** `' || part_id || {_s('`' + chr(10) + '**Context Type:** ')} || type || {_CODE}
  WHEN 'dependency' THEN '**Component:** `' || part_id || {_s('`' + chr(10) + '**Context Type:** ')} || type || {_CODE}
  WHEN 'usage' THEN '**Source Component:** `' || part_id || '`' || {_CODE}
  ELSE '**Query:** `' || part_id || {_s('`' + chr(10) + '**Result:**' + chr(10))} || content END"""
_HEAD = f"""CASE kind WHEN 'class' THEN {_s(C.CLASS_HEAD.split('%s')[0].replace("'", "''"))} || string_split(part_id, '.')[-1] || {_s(C.CLASS_HEAD.split('%s')[1])}
  WHEN 'parent' THEN {_s(C.PARENT_HEAD.replace("'", "''"))} WHEN 'dependency' THEN {_s(C.INTERNAL_HEAD + C.DEPENDENCY_HEAD)}
  WHEN 'usage' THEN CASE WHEN n_dependency = 0 THEN {_s(C.INTERNAL_HEAD)} ELSE '' END || {_s(C.USAGE_HEAD)} ELSE {_s(C.EXTERNAL_HEAD)} END"""


def _before(own: str) -> str:
    earlier = _KINDS[:_KINDS.index(own)]
    return " + ".join(f"n_{k}" for k in earlier) or "0"


def _pieces(parts: str) -> str:
    before = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_before(k)}" for k in _KINDS) + " END"
    gone, clauses = [], []
    for k in C.REMOVAL_ORDER:
        clauses.append(f"WHEN '{k}' THEN {' + '.join([f'n_{g}' for g in gone] + [f'n_{k}'])} - pos + 1")
        gone.append(k)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _KINDS)
    return f"""
cnt AS MATERIALIZED (SELECT id, count(*) AS n_all, {counts} FROM {parts} GROUP BY 1),
piece AS (SELECT q.*, cnt.* EXCLUDE (id), {before} + pos AS place, CASE kind {' '.join(clauses)} END AS gone_at,
  CASE WHEN pos > 1 THEN {_s(C.BLOCK_BREAK)} ELSE CASE WHEN {before} > 0 THEN chr(10) || chr(10) ELSE '' END || {_HEAD} END || {_BLOCK} AS text
  FROM {parts} q JOIN cnt USING (id))"""


def focal(c: Corpus) -> DataFrame:
    return c.sql("""SELECT 'corpus' AS repo_id, id, 'function' AS component_type, repeat('x + y ', CAST(end_line - start_line AS INT)) AS source_code
                    FROM fx_function""")


_FOCAL = "foc AS (SELECT id, repeat('x + y ', CAST(end_line - start_line AS INT)) AS source_code FROM fx_function)"


@query(f"""WITH {_pieces('fx_parts')}, {_FOCAL}
SELECT foc.id, CAST(0 AS BIGINT) AS part_no, coalesce(string_agg(text, '' ORDER BY place), '{C.NO_CONTEXT}') AS context FROM foc LEFT JOIN piece USING (id) GROUP BY 1""")
def render_context(c: Corpus) -> DataFrame:
    return C.render_context(c.parts, focal(c)).select("id", "part_no", "context")


@query(f"""WITH {_pieces('fx_parts')}, {_FOCAL},
full_text AS (SELECT foc.id, source_code, coalesce(string_agg(text, '' ORDER BY place), '{C.NO_CONTEXT}') AS context FROM foc LEFT JOIN piece USING (id) GROUP BY 1, 2),
sized AS (SELECT id, CAST(len(regexp_extract_all(context, '{TOKEN_PATTERN}')) + len(regexp_extract_all(source_code, '{TOKEN_PATTERN}')) AS BIGINT) AS tokens FROM full_text)
SELECT id, tokens, tokens <= 400 AS ok, greatest(tokens - 400, 0) AS overage FROM sized""")
def context_budget(c: Corpus) -> DataFrame:
    comps = focal(c)
    contexts = C.render_context(cut(c.parts), comps).join(comps.withColumnRenamed("source_code", "focal"), ["repo_id", "id"])
    return C.budget_check(contexts, 400, REGEX).select("id", "tokens", "ok", "overage")


# every step once and in this order; texts are measured where they are made and not kept
_PRUNED = f"""part_row AS MATERIALIZED (SELECT * FROM fx_parts), {_pieces('part_row')}, {_FOCAL},
sized AS MATERIALIZED (SELECT id, kind, pos, part_id, gone_at, len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS t FROM piece),
base AS (SELECT foc.id, len(regexp_extract_all(source_code, '{TOKEN_PATTERN}')) AS f, coalesce(sum(t), 0) AS total, count(t) AS n FROM foc LEFT JOIN sized USING (id) GROUP BY 1, source_code),
tried AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS gone FROM base UNION ALL
  SELECT id, gone_at, sum(t) OVER (PARTITION BY id ORDER BY gone_at) FROM sized WHERE gone_at <= 20),
size_at AS (SELECT id, k, CAST(f + CASE WHEN k = n THEN len(regexp_extract_all('{C.NO_CONTEXT}', '{TOKEN_PATTERN}')) ELSE total - gone END AS BIGINT) AS tokens FROM tried JOIN base USING (id)),
verdict AS MATERIALIZED (SELECT id, coalesce(min(k) FILTER (WHERE tokens <= 400), max(k)) AS removed, coalesce(arg_min(tokens, k) FILTER (WHERE tokens <= 400), arg_max(tokens, k)) AS tokens,
  count(*) FILTER (WHERE tokens <= 400) > 0 AS ok FROM size_at GROUP BY 1)"""


@query(f"WITH {_PRUNED} SELECT id, removed, tokens, ok FROM verdict")
def prune_context(c: Corpus) -> DataFrame:
    sized = C.truncate_focal(focal(c), 10_000, REGEX)
    return C.prune_context(cut(c.parts), sized, 400, tokenizer=REGEX)[1].select("id", "removed", "tokens", "ok")


@query(f"WITH {_PRUNED} SELECT id, kind, pos, part_id FROM sized JOIN verdict USING (id) WHERE gone_at > removed")
def pruned_parts(c: Corpus) -> DataFrame:
    sized = C.truncate_focal(focal(c), 10_000, REGEX)
    return C.prune_context(cut(c.parts), sized, 400, tokenizer=REGEX)[0].select("id", "kind", "pos", "part_id")


class Fours:
    """A codec whose counts do not add up: tokens of four characters."""

    longest = 16

    def encode(self, text: str) -> list[str]:
        return [text[at:at + 4] for at in range(0, len(text), 4)]

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


_FOURS = f"""{_pieces('fx_parts')}, {_FOCAL},
tries AS (SELECT id, source_code, unnest(range(0, least(20, coalesce(n_all, 0)) + 1)) AS k FROM foc LEFT JOIN cnt USING (id)),
texts AS MATERIALIZED (SELECT tries.id, k, coalesce(nullif(regexp_replace(string_agg(text, '' ORDER BY place), '^' || chr(10) || chr(10), ''), ''), '{C.NO_CONTEXT}') AS t
  FROM tries LEFT JOIN piece ON piece.id = tries.id AND gone_at > k GROUP BY 1, 2),
size_at AS MATERIALIZED (SELECT id, k, CAST(ceil(length(t) / 4.0) + ceil(length(source_code) / 4.0) AS BIGINT) AS tokens FROM texts JOIN foc USING (id)),
verdict AS MATERIALIZED (SELECT id, coalesce(min(k) FILTER (WHERE tokens <= 400), max(k)) AS removed, coalesce(arg_min(tokens, k) FILTER (WHERE tokens <= 400), arg_max(tokens, k)) AS tokens,
  count(*) FILTER (WHERE tokens <= 400) > 0 AS ok FROM size_at GROUP BY 1)"""


@query(f"""WITH {_FOURS} SELECT v.id, removed, tokens, ok, count(p.id) AS n_kept FROM verdict v LEFT JOIN piece p ON p.id = v.id AND gone_at > removed GROUP BY 1, 2, 3, 4""")
def prune_with_codec(c: Corpus) -> DataFrame:
    """Contexts within a budget of a codec's tokens; and how many parts are kept."""
    codec = from_codec("fours", Fours)
    kept, verdict = C.prune_context(cut(c.parts), C.truncate_focal(focal(c), 10_000, codec), 400, tokenizer=codec)
    n = kept.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n_kept"))
    return verdict.join(n, ["repo_id", "id"], "left").select("id", "removed", "tokens", "ok", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("SELECT doc_id, CAST(ceil(coalesce(length(text), 0) / 4.0) AS BIGINT) AS tokens, substr(text, 1, 40) AS head FROM {documents}")
def codec_tokens(c: Corpus) -> DataFrame:
    codec = from_codec("fours", Fours)
    return c.documents.select("doc_id", token_count("text", codec).alias("tokens"), truncate_tokens("text", 10, codec).alias("head"))


@query("""SELECT id, kind, pos, part_id, CASE WHEN kind IN ('parent', 'dependency') AND c.cid IS NOT NULL THEN 'src of ' || part_id ELSE content END AS content,
  CASE WHEN kind IN ('parent', 'dependency') AND c.cid IS NOT NULL THEN 'source_code (Expanded by request)' ELSE type END AS type
FROM fx_parts LEFT JOIN (SELECT id AS cid FROM fx_components WHERE component_type = 'method' AND start_line > 50) c ON c.cid = part_id""")
def expand_requested(c: Corpus) -> DataFrame:
    """Every part whose component starts below line 50 is asked for in full."""
    comps = c.components.where("component_type = 'method' AND start_line > 50").withColumn("source_code", F.concat(F.lit("src of "), F.col("id")))
    parts = cut(c.parts)
    return C.expand_requested(parts, parts.select("repo_id", "id", "part_id"), comps).select("id", "kind", "pos", "part_id", "content", "type")


@query("""WITH had AS (SELECT id, part_id AS query, content AS answer, pos AS seq FROM fx_parts WHERE kind = 'external'),
added AS (SELECT f.id, 'k' || CAST(o_orderkey AS STRING) AS query, 'new' AS answer, 1000000 + o_orderkey AS seq FROM {orders} JOIN fx_function f ON f.c_custkey = o_custkey),
m AS (SELECT id, query, min(seq) AS first, arg_max(answer, seq) AS content FROM (SELECT * FROM had UNION ALL SELECT * FROM added) t GROUP BY 1, 2)
SELECT id, query AS part_id, content, row_number() OVER (PARTITION BY id ORDER BY first, query) AS pos FROM m""")
def merge_external(c: Corpus) -> DataFrame:
    added = c.sql("""SELECT 'corpus' AS repo_id, f.id, o_orderkey AS seq, 'k' || CAST(o_orderkey AS STRING) AS query, 'new' AS answer
                     FROM {orders} JOIN fx_function f ON f.c_custkey = o_custkey""")
    merged = C.merge_external(c.parts, added)
    return merged.where("kind = 'external'").select("id", "part_id", "content", "pos")


@query(f"""SELECT doc_id AS id, array_to_string(string_split(regexp_replace(text, '({TOKEN_PATTERN})', '\\1' || chr(65535), 'g'), chr(65535))[1:
    CASE WHEN len(regexp_extract_all(text, '{TOKEN_PATTERN}')) <= 200 THEN 1000000 ELSE 200 END], '') AS focal,
  CAST(least(len(regexp_extract_all(text, '{TOKEN_PATTERN}')), 200) AS BIGINT) AS focal_tokens FROM {{documents}}""")
def truncate_focal(c: Corpus) -> DataFrame:
    rows = c.documents.select(F.lit("corpus").alias("repo_id"), F.col("doc_id").alias("id"), F.lit("function").alias("component_type"), F.col("text").alias("source_code"))
    return C.truncate_focal(rows, 200, REGEX).select("id", "focal", "focal_tokens")


# --- verification -----------------------------------------------------------

# per component: code parameters self, a<k%5>, documented **a<k%7> and b<k%3>; returns, raises and yields that partly agree
_CHECK = """
code AS (SELECT id, k, unnest(['self', 'a' || CAST(k % 5 AS STRING)]) AS name FROM fx_components),
doc AS (SELECT id, k, 1 AS at, '**a' || CAST(k % 7 AS STRING) AS raw, CASE k % 2 WHEN 0 THEN 'Dict[("str", int)]' ELSE 'int' END AS t FROM fx_components
  UNION ALL SELECT id, k, 2, 'b' || CAST(k % 3 AS STRING), '' FROM fx_components WHERE component_type <> 'class'),
docn AS (SELECT *, ltrim(raw, '*') AS name FROM doc),
found AS (
  SELECT id, 'missing_parameter' AS code, name AS subject FROM code WHERE name <> 'self' AND (id, name) NOT IN (SELECT id, name FROM docn)
  UNION ALL SELECT id, 'invented_parameter', raw FROM docn WHERE (id, name) NOT IN (SELECT id, name FROM code)
  UNION ALL SELECT id, 'parameter_type', raw FROM docn JOIN code USING (id, name) WHERE t = 'int'
  UNION ALL SELECT id, 'return_type', 'return' FROM fx_components WHERE k % 4 = 1
  UNION ALL SELECT id, 'missing_raise', 'E' || CAST(k % 3 AS STRING) FROM fx_components WHERE k % 3 <> k % 2
  UNION ALL SELECT id, 'invented_raise', 'E' || CAST(k % 2 AS STRING) FROM fx_components WHERE k % 3 <> k % 2
  UNION ALL SELECT id, 'missing_yields', 'yields' FROM fx_components WHERE k % 11 = 0 AND k % 3 <> 0
  UNION ALL SELECT id, 'invented_yields', 'yields' FROM fx_components WHERE k % 11 <> 0 AND k % 3 = 0),
every AS (SELECT * FROM found UNION ALL SELECT DISTINCT id, 'note', '' FROM found)"""


def checked(c: Corpus) -> tuple[DataFrame, DataFrame]:
    base = cut(c.components)
    docs = c.spark.sql("""SELECT repo_id, id, k, CASE WHEN k % 13 = 0 THEN NULL ELSE named_struct(
        'short_summary', 'S', 'parameters', concat(array(named_struct('name', '**a' || CAST(k % 7 AS STRING), 'type', CASE k % 2 WHEN 0 THEN 'Dict[("str", int)]' ELSE 'int' END)),
           CASE WHEN component_type = 'class' THEN array() ELSE array(named_struct('name', 'b' || CAST(k % 3 AS STRING), 'type', '')) END),
        'returns', array(named_struct('type', CASE k % 4 WHEN 0 THEN 'List [ int ]' WHEN 1 THEN 'str' WHEN 2 THEN '' ELSE 'List[int]' END, 'description', 'd')),
        'raises', array(named_struct('error', 'E' || CAST(k % 2 AS STRING), 'description', 'd')),
        'yields', CASE WHEN k % 3 = 0 THEN array(named_struct('type', 't', 'description', 'd')) END) END AS doc FROM {base}""", base=base)
    params = c.spark.sql("""SELECT repo_id, id AS component_id, explode(array('self', 'a' || CAST(k % 5 AS STRING))) AS name, "Dict[('str', int)]" AS annotation FROM {base}""", base=base)
    facts = c.spark.sql("SELECT repo_id, id AS component_id, 'List[int]' AS return_annotation, k % 11 = 0 AS has_yield FROM {base}", base=base)
    raises = c.spark.sql("SELECT repo_id, id AS component_id, 'E' || CAST(k % 3 AS STRING) AS name FROM {base}", base=base)
    return docs, V.static_findings(docs, params, facts, raises)


@query(f"WITH {_CHECK} SELECT e.id, code, subject FROM every e JOIN fx_components f ON f.id = e.id AND f.k % 13 <> 0")
def static_findings(c: Corpus) -> DataFrame:
    """Components without documentation have no findings."""
    return checked(c)[1].select("id", "code", "subject")


@query(f"""WITH {_CHECK}, n AS (SELECT id, count(*) AS n FROM every GROUP BY 1)
SELECT f.id, CAST(CASE WHEN k % 13 = 0 THEN 1 ELSE coalesce(n, 0) + CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1 END END AS BIGINT) AS n_findings,
  CASE WHEN k % 13 = 0 OR coalesce(n, 0) > 0 OR k % 4 = 3 THEN 'writer' WHEN k % 4 = 0 THEN 'finished' WHEN k % 4 = 1 THEN 'reader' ELSE 'finished' END AS step
FROM fx_components f LEFT JOIN n USING (id)""")
def merge_findings(c: Corpus) -> DataFrame:
    """Four kinds of reports: all accurate, one wrong with advice, one wrong but finished, failed call."""
    docs, static = checked(c)
    reports = c.sql("""SELECT repo_id, id, CASE WHEN k % 4 = 3 THEN NULL ELSE named_struct(
        'critiques', array(named_struct('section', 'notes', 'is_accurate', k % 4 = 0, 'critique', 'c'), named_struct('section', 'x', 'is_accurate', true, 'critique', 'd')),
        'suggested_next_step', CASE k % 4 WHEN 1 THEN 'reader' ELSE 'finished' END, 'suggestion_feedback', 'look') END AS report,
        CASE WHEN k % 4 = 3 THEN 'boom' END AS error FROM fx_components""")
    return V.merge_findings(docs, static, reports).select("id", F.size("findings").cast("long").alias("n_findings"), "step")


@query("""SELECT id, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 3 THEN
    '**Saran Perbaikan dari Verifier (untuk Writer):**' || chr(10) || repeat('-', 46) || chr(10) || 'Kesalahan Faktual (Statis):' || chr(10) || '- one ' || id
  WHEN k % 4 = 1 THEN '**Saran Perbaikan dari Verifier (untuk Reader):**' || chr(10) || repeat('-', 46) || chr(10) || 'Saran Pencarian Konteks (dari Verifier Agent):' || chr(10) || 'look'
  ELSE '**Saran Perbaikan dari Verifier (untuk Writer):**' || chr(10) || repeat('-', 46) || chr(10) || 'Kesalahan Faktual (Statis):' || chr(10) || '- one ' || id || chr(10) || chr(10)
    || 'Saran Perbaikan Konten (dari Verifier Agent):' || chr(10) || 'look' END AS feedback FROM fx_components""")
def feedback_text(c: Corpus) -> DataFrame:
    rows = c.sql("""SELECT id, CASE WHEN k % 4 IN (2, 3) THEN array('[Static] one ' || id, '[LLM - notes]: c') ELSE array('[LLM - notes]: c') END AS findings,
        CASE k % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'reader' ELSE 'writer' END AS step, CASE WHEN k % 4 = 3 THEN '' ELSE 'look' END AS suggestion,
        k % 4 <> 3 AS model_ok FROM fx_components""")
    return rows.select("id", V.feedback_text().alias("feedback"))


# --- rounds -----------------------------------------------------------------

@query("SELECT id, (row_number() OVER (ORDER BY id) - 1) % 3 AS endpoint FROM fx_components")
def assign_pool(c: Corpus) -> DataFrame:
    return N.assign_pool(c.components.select("id"), 3, [F.col("id")])


def stub_reader(prompts: list[str]) -> list[str]:
    """Wants as many external answers as the code says (``need<n>``), one more per attempt."""
    out = []
    for p in prompts:
        wanted, have = int(re.search(r"need(\d+)", p).group(1)), p.count("**Query:**")
        out.append(json.dumps({"info_need": have < wanted, "internal_expand": [], "external_retrieval": [f"q{have}"]}))
    return out


def stub_searcher(prompts: list[str]) -> list[str]:
    return [f"answer to {p}" for p in prompts]


@query("SELECT id, least(c_custkey % 5, 3) AS attempts, least(c_custkey % 5, 3) AS n_answers FROM fx_function")
def gather_rounds(c: Corpus) -> DataFrame:
    comps = c.sql("SELECT 'corpus' AS repo_id, id, 'function' AS component_type, 'need' || CAST(c_custkey % 5 AS STRING) AS source_code FROM fx_function")
    none = c.sql("SELECT 'corpus' AS repo_id, id, 'external' AS kind, CAST(1 AS BIGINT) AS pos, id AS part_id, '' AS type, '' AS content FROM fx_function").limit(0)
    state = comps.select("repo_id", "id", F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("feedback"))
    parts, final = N.gather_rounds(none, comps, state, stub_reader, stub_searcher, max_attempts=3)
    n = parts.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n_answers"))
    return final.join(n, ["repo_id", "id"], "left").select("id", "attempts", F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


# as gather_rounds, and how often each agent was asked in both runs together
@query("""SELECT id, least(c_custkey % 5, 3) AS attempts, least(c_custkey % 5, 3) AS n_answers, least(c_custkey % 5 + 1, 3) AS n_reader, least(c_custkey % 5, 3) AS n_searcher FROM fx_function""")
def resumed_rounds(c: Corpus) -> DataFrame:
    """A run that ends after its first attempts, and a second one that goes on from the log of the first."""
    comps = c.sql("SELECT 'corpus' AS repo_id, id, 'function' AS component_type, 'need' || CAST(c_custkey % 5 AS STRING) AS source_code FROM fx_function")
    none = c.sql("SELECT 'corpus' AS repo_id, id, 'external' AS kind, CAST(1 AS BIGINT) AS pos, id AS part_id, '' AS type, '' AS content FROM fx_function").limit(0)
    state = comps.select("repo_id", "id", F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("feedback"))
    log = N.CallLog(c.spark, f"{shared_folder(c.spark)}/calls-{uuid.uuid4().hex}")
    N.gather_rounds(none, comps, state, stub_reader, stub_searcher, max_attempts=1, log=log)
    parts, final = N.gather_rounds(none, comps, state, stub_reader, stub_searcher, max_attempts=3, log=log)
    n = parts.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n_answers"))
    calls = log.answers().groupBy("repo_id", "id").agg(*[F.count_if(F.col("agent") == a).alias(f"n_{a}") for a in ("reader", "searcher")])
    counted = final.join(n, ["repo_id", "id"], "left").join(calls, ["repo_id", "id"], "left")
    return counted.select("id", "attempts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_answers", "n_reader", "n_searcher")])


def stub_writer(prompts: list[str]) -> list[str]:
    """Documents with the number of the draft, read from the feedback."""
    return [json.dumps({"short_summary": "draft " + (re.search(r"again(\d)", p).group(1) if "again" in p else "0")}) for p in prompts]


@query("""SELECT id, CASE WHEN k % 5 = 0 THEN least(k % 4, 1) ELSE least(k % 4, 2) END AS rejections,
  'draft ' || CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE least(k % 4, 2) END AS STRING) AS summary FROM fx_components""")
def revise_rounds(c: Corpus) -> DataFrame:
    """Each component rejects its first k % 4 drafts; every fifth one asks for the reader, who has no attempts left."""
    def write(rows: DataFrame) -> DataFrame:
        asked = N.build_prompts(rows.withColumns({"context": F.lit("ctx"), "focal": F.col("id")}), N.Templates())
        return N.apply_model(asked.drop("context", "focal"), stub_writer).withColumn("doc", N.parse_doc("response")).drop("prompt", "response", "error")

    def verify(rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "needs_revision": F.col("rejections") < F.col("k") % 4, "step": F.when(F.col("k") % 5 == 0, "reader").otherwise("other"),
            "next_feedback": F.concat(F.lit("again"), (F.col("rejections") + 1).cast("string"))})

    state = c.components.select("repo_id", "id", "component_type", "k", F.lit(3).cast("long").alias("attempts"), F.lit(0).cast("long").alias("rejections"),
                                F.lit(None).cast("string").alias("feedback"))
    done = N.revise_rounds(state, write, verify, regather=lambda rows: rows, max_attempts=3)
    return done.select("id", "rejections", F.col("doc.short_summary").alias("summary"))


@query(f"""WITH RECURSIVE {CLOSURE}
SELECT m.repo_id, m.id, 'level ' || CAST(l.level AS STRING) || ' knows ' || CAST(count(CASE WHEN dl.level < l.level THEN 1 END) AS STRING) AS docstring
FROM member m JOIN leveled l ON l.g = m.root LEFT JOIN e ON e.s = m.n
LEFT JOIN rooted d ON d.n = e.d LEFT JOIN leveled dl ON dl.g = d.root GROUP BY m.repo_id, m.id, l.level""")
def generate_by_level(c: Corpus) -> DataFrame:
    """Every component writes how many of its dependencies were documented before it."""
    edges = cut(c.graph)
    order = cut(G.levels(c.graph_nodes, edges))
    needs = cut(edges.select("repo_id", F.col("src").alias("id"), F.col("dst").alias("dep")).join(
        order.select("repo_id", "id", "level"), ["repo_id", "id"]).repartitionByRange("level", "repo_id", "dep"))  # a level is a few files

    def make(rows: DataFrame, docs: DataFrame) -> DataFrame:
        level = rows.select("level").first()
        asked = needs.where(F.lit(False) if level is None else F.col("level") == level[0]).select("repo_id", "id", "dep")
        known = lookup_join(docs.select("repo_id", F.col("id").alias("dep")), asked, ["repo_id", "dep"]).groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n"))
        return rows.join(known, ["repo_id", "id"], "left").withColumn("docstring", F.format_string(
            "level %d knows %d", "level", F.coalesce("n", F.lit(0))))
    return N.generate_by_level(order, make).select("repo_id", "id", "docstring")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sum of ' || source WHEN 3 THEN 'fenced' END AS summary, doc_id % 4 = 1 AS need,
  CASE doc_id % 4 WHEN 2 THEN 'reader' END AS step FROM {documents}""")
def parse_structured(c: Corpus) -> DataFrame:
    """Responses of all three agents, well-formed, fenced, of another agent, or cut off by the document's text."""
    rows = _responses(c)
    return rows.select("doc_id", N.parse_doc("response")["short_summary"].alias("summary"), N.parse_need("response")["info_need"].alias("need"),
                       N.parse_report("response")["suggested_next_step"].alias("step"))


def _responses(c: Corpus) -> DataFrame:
    k = F.col("doc_id") % 4
    doc = F.to_json(F.struct(F.concat(F.lit("sum of "), F.col("source")).alias("short_summary"), F.col("text").alias("notes")))
    need = F.to_json(F.struct(F.lit(True).alias("info_need"), F.array("text").alias("external_retrieval")))
    report = F.to_json(F.struct(
        F.array(F.struct(F.lit("s").alias("section"), F.lit(True).alias("is_accurate"), F.col("text").alias("critique"))).alias("critiques"),
        F.lit("reader").alias("suggested_next_step"), F.col("text").alias("suggestion_feedback")))
    fenced = F.lit('```json\n{"short_summary": "fenced"}\n```')
    return c.documents.select("doc_id", F.when(k == 0, doc).when(k == 1, need).when(k == 2, report).otherwise(fenced).alias("response"))


@query(f"""SELECT doc_id, CASE WHEN length(text) > 2000 THEN NULL ELSE 'len ' || CAST(length(text) AS STRING) END AS response,
  CASE WHEN length(text) > 2000 THEN 'too long' END AS error FROM {{documents}}""")
def apply_model(c: Corpus) -> DataFrame:
    """A model that fails on long prompts: their rows are marked, the others of the batch are answered."""
    def model(prompts: list[str]) -> list[str]:
        if any(len(p) > 2000 for p in prompts):
            raise ValueError("too long")
        return [f"len {len(p)}" for p in prompts]
    return N.apply_model(c.documents.select("doc_id", "text"), model, "text").select("doc_id", "response", "error")
