"""Queries for documentation quality, usage and document views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.metrics import evaluate, register_metric
from codeloom.operators import completeness as Q
from codeloom.operators import documents as D
from codeloom.operators import helpfulness as H
from codeloom.operators import truthfulness as T
from codeloom.operators import usage as U
from codeloom.plans.corpus import Corpus
from codeloom.plans.registry import query
from codeloom.session import shared_folder
from codeloom.sources.records import write_report

# --- shared inputs ----------------------------------------------------------

FACTS = """SELECT f.*, starts_with(string_split(f.id, '.')[-1], '_') AS is_private FROM fx_facts f"""

REQUIRED = f"""
fact AS ({FACTS}),
need AS (SELECT id, component_type, list_filter(CASE WHEN component_type = 'class' THEN
    ['summary', 'description', CASE WHEN has_params THEN 'parameters' END, CASE WHEN has_attributes THEN 'attributes' END,
     CASE WHEN NOT is_private THEN 'examples' END]
  ELSE ['summary', 'description', CASE WHEN has_params THEN 'parameters' END,
     CASE WHEN returns_value AND NOT has_yield THEN 'returns' END, CASE WHEN has_yield THEN 'yields' END,
     CASE WHEN has_raise THEN 'raises' END, CASE WHEN has_warn THEN 'warns' END,
     CASE WHEN NOT is_private AND NOT is_abstract THEN 'examples' END] END, lambda x: x IS NOT NULL) AS required FROM fact),
have AS (SELECT id, list_filter([CASE WHEN length(trim(short_summary)) > 0 THEN 'summary' END,
    CASE WHEN length(trim(extended_summary)) > 0 THEN 'description' END, CASE WHEN doc_params THEN 'parameters' END,
    CASE WHEN doc_returns THEN 'returns' END, CASE WHEN doc_yields THEN 'yields' END, CASE WHEN doc_raises THEN 'raises' END,
    CASE WHEN doc_warns THEN 'warns' END, CASE WHEN doc_examples THEN 'examples' END,
    CASE WHEN doc_attributes THEN 'attributes' END], lambda x: x IS NOT NULL) AS present FROM fx_docs),
scored AS (SELECT id, component_type, required, list_filter(required, lambda x: NOT list_contains(present, x)) AS missing,
    (len(required) - len(list_filter(required, lambda x: NOT list_contains(present, x))))::DOUBLE / len(required) AS score
  FROM need JOIN have USING (id))"""


def facts(c: Corpus) -> DataFrame:
    return c.facts.withColumns({
        "is_private": F.substring_index("id", ".", -1).startswith("_"),
        "has_return_annotation": F.lit(False), "n_lines": F.lit(20)})


def docs(c: Corpus) -> DataFrame:
    """Documentation structs whose filled fields follow the flags of the docs view."""
    def listed(flag: str, *fields: str) -> F.Column:
        item = F.struct(*[(F.concat(F.lit(f + " "), F.col("k").cast("string")) if f != "default" else F.lit(None).cast("string")
                           ).alias(f) for f in fields])
        return F.when(F.col(flag), F.array(item)).otherwise(F.array().cast(
            "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"))

    none = F.lit(None).cast("string")
    return c.docs.select("repo_id", "id", "component_type", "k", F.struct(
        "short_summary", "extended_summary",
        listed("doc_params", "name", "type", "description", "default").alias("parameters"),
        listed("doc_attributes", "name", "type", "description", "default").alias("attributes"),
        listed("doc_returns", "type", "description").alias("returns"),
        listed("doc_yields", "type", "description").alias("yields"),
        F.lit(None).cast("array<struct<name:string,type:string,description:string,default:string>>").alias("receives"),
        listed("doc_raises", "error", "description").alias("raises"),
        listed("doc_warns", "warning", "description").alias("warns"),
        none.alias("warnings_section"),
        F.lit(None).cast("array<struct<name:string,description:string>>").alias("see_also"),
        F.when(F.col("k") % 3 == 0, F.lit("")).otherwise("note").alias("notes"),
        F.when(F.col("doc_examples"), F.lit(">>> run()")).alias("examples")).alias("doc"))


def scores(c: Corpus) -> DataFrame:
    return Q.completeness(Q.required_sections(facts(c)), docs(c))


# --- completeness -----------------------------------------------------------

@query(f"WITH {REQUIRED} SELECT id, array_to_string(required, ',') AS required FROM need")
def required_sections(c: Corpus) -> DataFrame:
    return Q.required_sections(facts(c)).select("id", F.array_join("required", ",").alias("required"))


@query(f"WITH {REQUIRED} SELECT id, component_type, array_to_string(missing, ',') AS missing, round(score, 6) AS score FROM scored")
def completeness(c: Corpus) -> DataFrame:
    return scores(c).select("id", "component_type", F.array_join("missing", ",").alias("missing"), F.round("score", 6).alias("score"))


@query(f"""WITH {REQUIRED} SELECT CASE WHEN GROUPING(component_type) = 1 THEN 'all' ELSE component_type END AS component_type,
  count(*) AS n, round(avg(score), 6) AS mean_score FROM scored GROUP BY ROLLUP (component_type)""")
def completeness_summary(c: Corpus) -> DataFrame:
    return Q.completeness_summary(scores(c)).select("component_type", "n", F.round("mean_score", 6).alias("mean_score"))


@query(f"""WITH {REQUIRED},
cell AS (SELECT id, upper(component_type[1]) || component_type[2:] AS t, printf('%.2f%%', score * 100) AS s,
  array_to_string(list_sort(required), ', ') AS r, CASE WHEN len(missing) = 0 THEN '-' ELSE array_to_string(list_sort(missing), ', ') END AS m FROM scored),
w AS (SELECT greatest(9, max(length(id))) AS w0, greatest(4, max(length(t))) AS w1, greatest(5, max(length(s))) AS w2,
  greatest(17, max(length(r))) AS w3, greatest(16, max(length(m))) AS w4, count(*) AS n FROM cell),
tot AS (SELECT printf('Overall Completeness Score: %.2f%%', avg(score) * 100) AS a, 'Total Components Evaluated: ' || CAST(count(*) AS STRING) AS b FROM scored)
SELECT CAST(1 AS BIGINT) AS section, id, concat_ws(' | ', rpad(id, w0::INT, ' '), rpad(t, w1::INT, ' '), rpad(s, w2::INT, ' '), rpad(r, w3::INT, ' '), rpad(m, w4::INT, ' ')) AS line FROM cell, w
UNION ALL SELECT 0, '0', a FROM tot UNION ALL SELECT 0, '1', b FROM tot
UNION ALL SELECT 0, '2', repeat('=', greatest(length(a), length(b))) FROM tot UNION ALL SELECT 0, '3', chr(10)
UNION ALL SELECT 0, '4', concat_ws(' | ', rpad('Component', w0::INT, ' '), rpad('Type', w1::INT, ' '), rpad('Score', w2::INT, ' '), rpad('Required Sections', w3::INT, ' '), rpad('Missing Sections', w4::INT, ' ')) FROM w
UNION ALL SELECT 0, '5', concat_ws('-+-', repeat('-', w0), repeat('-', w1), repeat('-', w2), repeat('-', w3), repeat('-', w4)) FROM w""")
def completeness_report(c: Corpus) -> DataFrame:
    return Q.completeness_report(scores(c)).select("section", "id", "line")


# --- evaluators and reports ---------------------------------------------------

@query("""SELECT id, 'brevity' AS metric, 1.0 / (1 + length(trim(short_summary)) // 8) AS score FROM fx_docs""")
def evaluate_metric(c: Corpus) -> DataFrame:
    """A metric of the caller's, registered under a name and applied to all documentation."""
    register_metric("brevity", "short summaries score high", lambda: F.lit(1.0) / (1 + F.floor(F.length(F.trim("short_summary")) / 8)))
    return evaluate(c.docs, "brevity").select("id", "metric", "score")


@query(f"""WITH {REQUIRED}, d AS (SELECT 'base' AS variant, 'sections' AS metric, id, size FROM (SELECT id, len(required) AS size FROM need) n)
SELECT 'summary' AS part, NULL AS id, variant, metric, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY variant, metric
UNION ALL SELECT 'details', id, variant, metric, size FROM d""")
def metric_report(c: Corpus) -> DataFrame:
    """A metric run written as a report, twice as after a failure, and read back."""
    details = scores(c).select("repo_id", F.lit("base").alias("variant"), F.lit("sections").alias("metric"), "id", F.size("required").cast("long").alias("size"))
    summary = details.groupBy("repo_id", "variant", "metric").agg(F.sum("size").alias("size"))
    path = f"{shared_folder(c.spark)}/report-{uuid.uuid4().hex}"
    for _ in range(2):
        write_report(summary, details, path, run="one")
    back = {part: c.spark.read.parquet(f"{path}/{part}") for part in ("summary", "details")}
    columns = ["part", "id", "variant", "metric", "size"]
    one = back["summary"].withColumns({"part": F.lit("summary"), "id": F.lit(None).cast("string")}).select(columns)
    return one.unionByName(back["details"].withColumn("part", F.lit("details")).select(columns))


# --- truthfulness -----------------------------------------------------------

# the quoted items of a bracketed list, whatever stands in front of it
MENTIONS = r"""
m AS (SELECT doc_id, unnest(CASE doc_id % 4
   WHEN 0 THEN ['x.m' || CAST(doc_id % 5000 AS STRING), 'Ghost' || CAST(doc_id AS STRING)]
   WHEN 1 THEN ['S' || CAST(doc_id % 40 AS STRING), 'a.b.f' || CAST(doc_id AS STRING), '__init__']
   WHEN 2 THEN [] ELSE ['m' || CAST(doc_id AS STRING), 'S1'] END) AS mention FROM {documents}),
named AS (SELECT doc_id, mention, string_split(mention, '.')[-1] AS check_name FROM m),
seg AS (SELECT DISTINCT string_split(id, '.')[-1] AS s FROM fx_components),
known AS (SELECT DISTINCT check_name FROM (SELECT DISTINCT check_name FROM named) n JOIN seg ON contains(s, check_name))"""


def answers(c: Corpus) -> DataFrame:
    """Answers that hold a list of their own; a text with brackets of its own is read from its first one."""
    return c.answers.select(F.lit("corpus").alias("repo_id"), F.col("doc_id").alias("component_id"), "response", "document")


@query(r"""WITH a AS (SELECT doc_id, response, regexp_matches(response, '(?s)<python_list>(.*?)</python_list>') AS tagged,
  regexp_extract(response, '(?s)<python_list>(.*?)</python_list>', 1) AS t, regexp_extract(response, '(?s)\[.*?\]', 0) AS b FROM fx_answers),
l AS (SELECT doc_id, CASE WHEN tagged THEN t ELSE b END AS body FROM a),
lit AS (SELECT doc_id, body, replace(regexp_replace(regexp_replace(body, '"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''', 'Q', 'g'), '\s', '', 'g'), ',Q', '') AS shape FROM l)
SELECT doc_id, unnest(CASE WHEN shape IN ('[]', '[Q]', '[Q,]') THEN list_transform(regexp_extract_all(body, '"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'''), lambda x: x[2:-2])
  ELSE regexp_extract_all(body, '"([^"]*)"', 1) END) AS mention FROM lit""")
def mentions(c: Corpus) -> DataFrame:
    return T.extract_mentions(answers(c)).select(F.col("component_id").alias("doc_id"), "mention")


@query(f"WITH {MENTIONS} SELECT doc_id, mention, check_name IN (SELECT check_name FROM known) AS exist FROM named")
def mention_exists(c: Corpus) -> DataFrame:
    return T.mention_exists(_mentions(c), c.components).select(F.col("component_id").alias("doc_id"), "mention", "exist")


def _mentions(c: Corpus) -> DataFrame:
    return c.sql(f"""SELECT 'corpus' AS repo_id, doc_id AS component_id, mention, substring_index(mention, '.', -1) AS check_name FROM (
      SELECT doc_id, explode(CASE doc_id % 4
       WHEN 0 THEN array('x.m' || CAST(doc_id % 5000 AS STRING), 'Ghost' || CAST(doc_id AS STRING))
       WHEN 1 THEN array('S' || CAST(doc_id % 40 AS STRING), 'a.b.f' || CAST(doc_id AS STRING), '__init__')
       WHEN 2 THEN CAST(array() AS array<string>) ELSE array('m' || CAST(doc_id AS STRING), 'S1') END) AS mention FROM {{documents}}) t""")


@query(f"""WITH {MENTIONS},
text AS (SELECT doc_id, lang AS t, 'equals' AS mode FROM {{documents}} UNION ALL SELECT doc_id, 'Ghost' || CAST(doc_id - doc_id % 3 AS STRING) || 'Tail', 'contains' FROM {{documents}}),
hit AS (SELECT DISTINCT doc_id, check_name FROM named JOIN text USING (doc_id)
        WHERE (mode = 'equals' AND t = check_name) OR (mode = 'contains' AND contains(t, check_name)))
SELECT doc_id, count(*) AS total_mentions, count(*) FILTER (WHERE check_name IN (SELECT check_name FROM known)
   OR (doc_id, check_name) IN (SELECT doc_id, check_name FROM hit)) AS total_exist FROM named GROUP BY 1""")
def truthfulness(c: Corpus) -> DataFrame:
    texts = c.sql("""SELECT 'corpus' AS repo_id, doc_id AS component_id, lang AS text, 'equals' AS mode FROM {documents}
        UNION ALL SELECT 'corpus', doc_id, 'Ghost' || CAST(doc_id - doc_id % 3 AS STRING) || 'Tail', 'contains' FROM {documents}""")
    kinds = c.sql("SELECT 'corpus' AS repo_id, CAST(doc_id AS STRING) AS id, 'function' AS component_type FROM {documents}")
    m = _mentions(c)
    found = T.mention_in_corpus(m, c.components)
    local = T.mention_in_local(m, texts, kinds.withColumn("id", F.col("id").cast("long").cast("string")))
    flagged = (
        m.join(found.withColumn("_a", F.lit(True)), ["repo_id", "check_name"], "left")
        .join(local.withColumn("_b", F.lit(True)), ["repo_id", "component_id", "check_name"], "left")
        .withColumn("exist", F.coalesce("_a", "_b", F.lit(False))))
    return T.truthfulness(flagged).select(F.col("component_id").alias("doc_id"), "total_mentions", "total_exist")


@query(f"""WITH {MENTIONS} SELECT count(*) AS total_mentions, count(*) FILTER (WHERE check_name IN (SELECT check_name FROM known)) AS total_exist,
  round(100.0::DOUBLE * count(*) FILTER (WHERE check_name IN (SELECT check_name FROM known)) / count(*), 6) AS score FROM named""")
def truthfulness_summary(c: Corpus) -> DataFrame:
    per = T.truthfulness(T.mention_exists(_mentions(c), c.components))
    return T.truthfulness_summary(per).select("total_mentions", "total_exist", F.round("score", 6).alias("score"))


# --- helpfulness ------------------------------------------------------------

def _rating_sql(metric: str) -> str:
    if metric == "description":
        pattern = H.OVERALL_PATTERN
        return f"""CASE WHEN contains(lower(response), '{H.NO_DESCRIPTION}') OR NOT regexp_matches(response, '{pattern}') THEN 3
                   ELSE CAST(regexp_extract(response, '{pattern}', 1) AS BIGINT) END"""
    options = []
    for p in H.RATING_PATTERNS[metric]:
        mean = f"CAST(round(list_avg(list_transform(regexp_extract_all(response, '{p}', 1), lambda x: CAST(x AS DOUBLE)))) AS BIGINT)"
        options.append(f"CASE WHEN {mean} BETWEEN 1 AND 5 THEN {mean} END")
    return f"coalesce({', '.join(options)}, 3)"


def responses(c: Corpus) -> DataFrame:
    return c.responses.withColumnRenamed("response", "raw_response").withColumn("id", F.col("component_id"))


for _metric in ("summary", "parameters", "description"):
    def _rating(c: Corpus, metric: str = _metric) -> DataFrame:
        return responses(c).select("event_id", H.parse_rating("raw_response", metric).cast("long").alias("score"))

    query(f"SELECT event_id, CAST({_rating_sql(_metric)} AS BIGINT) AS score FROM fx_responses", f"ratings_{_metric}")(_rating)


def _label_sql(patterns: list[str]) -> str:
    strip = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
    cases = " ".join(f"WHEN regexp_matches(response, '{p}') THEN " + strip.format(f"regexp_extract(response, '{p}', 1)") for p in patterns)
    return f"CASE {cases} END"


_HINT = " OR ".join(f"contains(lower(x), '{h}')" for h in H.SUMMARY_HINTS)
_LINE_HINT = " OR ".join(f"contains(lower(lines[i]), '{h}')" for h in H.PARAMETER_HINTS)


@query(rf"""
WITH r AS (SELECT event_id, response, {_label_sql(H.SUGGESTION_PATTERNS['summary'])} AS s, {_label_sql(H.SUGGESTION_PATTERNS['parameters'])} AS p,
  {_label_sql(H.SUGGESTION_PATTERNS['description'])} AS d, string_split(response, chr(10)) AS lines,
  list_filter(regexp_split_to_array(response, '[.!?]\s+'), lambda x: {_HINT}) AS hits FROM fx_responses),
l AS (SELECT *, list_filter(range(1, len(lines)), lambda i: {_LINE_HINT}) AS hint FROM r)
SELECT event_id,
  CASE WHEN coalesce(s, '') <> '' THEN s WHEN len(hits) > 0 THEN array_to_string(list_transform(hits, lambda x: trim(x)), ' ') || '.' ELSE '{H.DEFAULT_SUGGESTION['summary']}' END AS summary,
  CASE WHEN coalesce(p, '') <> '' THEN p WHEN len(hint) > 0 THEN trim(lines[hint[1] + 1]) ELSE '{H.DEFAULT_SUGGESTION['parameters']}' END AS parameters,
  CASE WHEN contains(lower(response), '{H.NO_DESCRIPTION}') THEN '{H.ADD_DESCRIPTION}' WHEN coalesce(d, '') <> '' THEN d ELSE '{H.DEFAULT_SUGGESTION['description']}' END AS description
FROM l""")
def suggestions(c: Corpus) -> DataFrame:
    return responses(c).select("event_id", *[H.parse_suggestion("raw_response", m).alias(m) for m in ("summary", "parameters", "description")])


@query(f"""SELECT repo_id, variant, round(avg(CASE WHEN event_id % 11 = 0 THEN 0 ELSE {_rating_sql('summary')} END), 6) AS mean_score, count(*) AS n
FROM fx_responses GROUP BY 1, 2""")
def rating_rollup(c: Corpus) -> DataFrame:
    """A null response is a failed call."""
    rows = responses(c).withColumns({"metric": F.lit("summary"), "raw_response": F.when(F.col("event_id") % 11 != 0, F.col("raw_response"))})
    return H.rating_summary(H.rate(rows, "summary")).select("repo_id", "variant", F.round("mean_score", 6).alias("mean_score"), "n")


@query(f"""SELECT repo_id, round(avg({_rating_sql('summary')}) FILTER (WHERE variant = 'click'), 6) AS click,
  round(avg({_rating_sql('summary')}) FILTER (WHERE variant = 'view'), 6) AS view, round(avg({_rating_sql('summary')}) FILTER (WHERE variant = 'purchase'), 6) AS purchase
FROM fx_responses GROUP BY 1""")
def compare_runs(c: Corpus) -> DataFrame:
    rated = H.rate(responses(c).withColumn("metric", F.lit("summary")), "summary")
    wide = H.compare_runs(rated, ["click", "view", "purchase"])
    return wide.select("repo_id", *[F.round(v, 6).alias(v) for v in ("click", "view", "purchase")])


_ASKED = "SELECT DISTINCT repo_id, CAST(event_id AS STRING) AS id FROM fx_responses"
_ANSWERED = "SELECT 'u' || CAST(user_id AS STRING) AS repo_id, CAST(event_id AS STRING) AS id FROM {events} WHERE event_type = 'click'"


@query(f"SELECT repo_id, id FROM ({_ASKED}) t EXCEPT SELECT repo_id, id FROM ({_ANSWERED}) u")
def pending(c: Corpus) -> DataFrame:
    return H.pending(c.sql(_ASKED), c.sql(_ANSWERED))


_SHOWN = "SELECT 'u' || CAST(user_id AS STRING) AS repo_id, CAST(event_id AS STRING) AS id FROM {events} WHERE event_type IN ('click', 'view')"


@query(f"""WITH comp AS ({_SHOWN})
SELECT repo_id, count(*) AS total_components, count(r.event_id) AS kept, round(coalesce(avg(r.score), 0), 6) AS mean_score
FROM comp LEFT JOIN (SELECT CAST(event_id AS STRING) AS id, event_id, {_rating_sql('parameters')} AS score FROM fx_responses WHERE variant <> 'view') r USING (id) GROUP BY 1""")
def rescore(c: Corpus) -> DataFrame:
    """Views were never rated, so their components count in the total only."""
    stored = responses(c).where("variant <> 'view'")
    _, summary = H.rescore(stored, c.sql(_SHOWN), "parameters")
    return summary.select("repo_id", "total_components", "kept", F.round("mean_score", 6).alias("mean_score"))


@query("""
SELECT id, 'Rate the ' || component_type || chr(10) || CASE WHEN component_type = 'class' THEN 'class example' ELSE 'other example' END || chr(10)
  || 'src of ' || id || chr(10) || 'Doc:' || chr(10) || short_summary AS prompt FROM fx_docs""")
def rubric_prompts(c: Corpus) -> DataFrame:
    rubric = c.spark.createDataFrame([
        ("summary", "any", 1, "type", "Rate the %s"), ("summary", "class", 2, "text", "class example"),
        ("summary", "other", 2, "text", "other example"), ("summary", "any", 3, "code", ""),
        ("summary", "any", 4, "text", "Doc:"), ("summary", "any", 5, "documentation", "")],
        "metric string, applies_to string, pos int, slot string, text string")
    comps = c.components.withColumn("source_code", F.concat(F.lit("src of "), F.col("id")))
    texts = c.docs.select("repo_id", "id", F.col("short_summary").alias("documentation"))
    return H.rubric_prompts(comps, texts, rubric, "summary").select("id", "prompt")


# --- usage ------------------------------------------------------------------

_AGENT_ROWS = """
agent(agent, input_price, output_price) AS (VALUES ('reader', 0.30::DOUBLE, 2.50::DOUBLE), ('searcher', 1.25, 10.0), ('writer', 0.30, 2.50), ('verifier', 0.30, 2.50)),
per AS (SELECT agent, coalesce(sum(call_count), 0)::BIGINT AS call_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
  coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens,
  any_value(input_price) AS ip, any_value(output_price) AS op FROM agent LEFT JOIN fx_usage USING (agent) GROUP BY 1),
money AS (SELECT *, input_tokens / 1000000.0::DOUBLE * ip + output_tokens / 1000000.0::DOUBLE * op AS usd FROM per),
tot AS (SELECT 'total' AS agent, sum(call_count)::BIGINT AS call_count, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(total_tokens)::BIGINT AS total_tokens, sum(usd) AS usd FROM money),
comp AS (SELECT count(DISTINCT component_id) AS n FROM fx_usage)"""


@query(f"WITH {_AGENT_ROWS} SELECT agent, call_count, input_tokens, output_tokens, total_tokens FROM per")
def usage_by_agent(c: Corpus) -> DataFrame:
    return U.usage_by_agent(c.usage).select("agent", *U.COUNTERS)


@query(f"""WITH {_AGENT_ROWS} SELECT agent, call_count, input_tokens, output_tokens, total_tokens FROM per
UNION ALL SELECT agent, call_count, input_tokens, output_tokens, total_tokens FROM tot""")
def usage_rollup(c: Corpus) -> DataFrame:
    return U.usage_rollup(c.usage).select("agent", *U.COUNTERS)


def _cell(agent: str) -> str:
    return (f"CAST(count(*) FILTER (WHERE agent = '{agent}') AS STRING) || ' x (' || "
            f"CAST(coalesce(sum(total_tokens) FILTER (WHERE agent = '{agent}'), 0)::BIGINT AS STRING) || ')' AS {agent}")


_CELLS = f"""SELECT component_id, {', '.join(_cell(a) for a in ('reader', 'searcher', 'writer', 'verifier'))},
  count(*) AS total_call, sum(total_tokens)::BIGINT AS total_token FROM fx_usage GROUP BY 1"""


@query(_CELLS)
def usage_by_component(c: Corpus) -> DataFrame:
    return U.usage_by_component(c.usage).drop("repo_id")


@query(f"""WITH {_AGENT_ROWS} SELECT agent, round(usd, 6) AS cost_usd, round(usd * 16739, 4) AS cost_local FROM money
UNION ALL SELECT agent, round(usd, 6), round(usd * 16739, 4) FROM tot""")
def usage_cost(c: Corpus) -> DataFrame:
    return U.usage_cost(c.usage, U.default_prices(c.spark)).select(
        "agent", F.round("cost_usd", 6).alias("cost_usd"), F.round("cost_local", 4).alias("cost_local"))


def _used(c: Corpus) -> DataFrame:
    return c.usage.select("repo_id", F.col("component_id").alias("id")).distinct()


@query(f"""WITH {_AGENT_ROWS} SELECT n AS components, round(total_tokens / n::DOUBLE, 6) AS avg_total, round(input_tokens / n::DOUBLE, 6) AS avg_input,
  round(output_tokens / n::DOUBLE, 6) AS avg_output, round(usd * 16739 / n, 4) AS avg_cost FROM tot, comp""")
def usage_averages(c: Corpus) -> DataFrame:
    avg = U.usage_averages(c.usage, _used(c), U.default_prices(c.spark))
    return avg.select("components", *[F.round(x, 6).alias(x) for x in ("avg_total", "avg_input", "avg_output")],
                      F.round("avg_cost", 4).alias("avg_cost"))


_NO = "CASE agent WHEN 'reader' THEN 1 WHEN 'searcher' THEN 2 WHEN 'writer' THEN 3 WHEN 'verifier' THEN 4 ELSE 5 END"


def _num(x: str, w: int) -> str:
    return f"lpad(format('{{{{:,}}}}', {x}), {w}, ' ')"


@query(f"""WITH {_AGENT_ROWS},
every AS (SELECT agent, call_count, input_tokens, output_tokens, total_tokens, usd, 'Flash' AS model FROM money WHERE agent <> 'searcher'
  UNION ALL SELECT agent, call_count, input_tokens, output_tokens, total_tokens, usd, 'Pro' FROM money WHERE agent = 'searcher'
  UNION ALL SELECT agent, call_count, input_tokens, output_tokens, total_tokens, usd, NULL FROM tot)
SELECT CAST(1 AS BIGINT) AS section, CAST({_NO} AS BIGINT) AS line_no, '' AS id,
  '| ' || rpad(upper(agent), 12, ' ') || ' | ' || {_num('input_tokens', 15)} || ' | ' || {_num('output_tokens', 15)} || ' | ' || {_num('total_tokens', 15)} || ' | ' || {_num('call_count', 12)} || ' |' AS line FROM every
UNION ALL SELECT 2, {_NO}, '', '| ' || rpad(CASE agent WHEN 'total' THEN 'GRAND TOTAL COST' ELSE upper(agent[1]) || agent[2:] || ' (' || model || ')' END, 22, ' ')
  || ' | $' || lpad(format('{{{{:,.5f}}}}', usd), 17, ' ') || ' | Rp ' || lpad(format('{{{{:,.2f}}}}', usd * 16739), 22, ' ') || ' |' FROM every
UNION ALL SELECT 3, 1, '', '  Average Total Tokens : ' || format('{{{{:,.2f}}}}', total_tokens / n::DOUBLE) FROM tot, comp
UNION ALL SELECT 3, 2, '', '  Average Input Tokens : ' || format('{{{{:,.2f}}}}', input_tokens / n::DOUBLE) FROM tot, comp
UNION ALL SELECT 3, 3, '', '  Average Output Tokens: ' || format('{{{{:,.2f}}}}', output_tokens / n::DOUBLE) FROM tot, comp
UNION ALL SELECT 3, 4, '', '  Average Cost (IDR)   : Rp ' || format('{{{{:,.2f}}}}', usd * 16739 / n) FROM tot, comp
UNION ALL SELECT 4, 1, component_id, rpad(component_id, 60, ' ') || ' | ' || rpad(reader, 22, ' ') || ' | ' || rpad(searcher, 22, ' ') || ' | ' || rpad(writer, 22, ' ')
  || ' | ' || rpad(verifier, 22, ' ') || ' | ' || rpad(CAST(total_call AS STRING), 15, ' ') || ' | ' || rpad(CAST(total_token AS STRING), 15, ' ') FROM ({_CELLS}) u
UNION ALL SELECT 1, 0, '', '| AGENT        |    INPUT TOKENS |   OUTPUT TOKENS |    TOTAL TOKENS |        CALLS |'
UNION ALL SELECT 2, 0, '', '| AGENT (MODEL)          |         COST (USD) |                COST (IDR) |'
UNION ALL SELECT 4, 0, '', rpad('COMPONENT ID', 60, ' ') || ' | ' || rpad('READER', 22, ' ') || ' | ' || rpad('SEARCHER', 22, ' ') || ' | ' || rpad('WRITER', 22, ' ')
  || ' | ' || rpad('VERIFIER', 22, ' ') || ' | ' || rpad('TOT CALL', 15, ' ') || ' | ' || rpad('TOT TOK', 15, ' ')""".replace("{{", "{").replace("}}", "}"))
def usage_report(c: Corpus) -> DataFrame:
    return U.usage_report(c.usage, _used(c), U.default_prices(c.spark)).select("section", "line_no", "id", "line")


# --- documents --------------------------------------------------------------

@query("""
SELECT m.class_id AS top_id, 'class' AS top_type, row_number() OVER (PARTITION BY m.class_id ORDER BY start_line, id) AS method_pos, id AS method_id FROM fx_method m
UNION ALL SELECT id, component_type, 0, NULL FROM fx_components WHERE component_type <> 'method'""")
def nest_methods(c: Corpus) -> DataFrame:
    return D.nest_methods(c.components).select("top_id", "top_type", "method_pos", "method_id")


@query("""
SELECT row_number() OVER (ORDER BY relative_path, id) AS pos, id, CASE WHEN component_type = 'method' THEN '• ' || id ELSE id END AS text,
  CAST(CASE WHEN component_type = 'method' THEN 1 ELSE 0 END AS BIGINT) AS indent FROM fx_components""")
def toc(c: Corpus) -> DataFrame:
    return D.toc(c.components.withColumnRenamed("relative_path", "file_path")).drop("repo_id")


def _paged(c: Corpus) -> DataFrame:
    return c.components.withColumns({"signature": F.concat(F.lit("def "), F.substring_index("id", ".", -1), F.lit("():")),
                                     "graph_url": F.lit("")}).drop("k")


def _section_sql(no: int, title: str, flag: str, fields: list[str], heads: list[str]) -> str:
    cells = " || ' | ' || ".join(f"'{f} ' || CAST(k AS STRING)" for f in fields)
    return (f"SELECT id, {no}, '{title}', 0, '| {' | '.join(heads)} |' FROM fx_docs WHERE {flag} UNION ALL "
            f"SELECT id, {no}, '{title}', 1, '| ' || {cells} || ' |' FROM fx_docs WHERE {flag}")


@query("SELECT id, CAST(a AS BIGINT) AS section_no, b AS section, CAST(d AS BIGINT) AS item_no, e AS text FROM (" + " UNION ALL ".join([
    """SELECT id, 1 AS a, id AS b, 0 AS d, 'Type: ' || upper(component_type[1]) || component_type[2:] || ' | File Path: ' || relative_path AS e FROM fx_components""",
    """SELECT id, 2, '', 0, 'def ' || string_split(id, '.')[-1] || '():' FROM fx_components""",
    """SELECT id, 4, 'Summary', 0, short_summary FROM fx_docs""",
    """SELECT id, 5, 'Description', 0, extended_summary FROM fx_docs WHERE extended_summary <> ''""",
    _section_sql(6, "Parameters", "doc_params", ["name", "type", "description"], ["Name", "Type", "Description"]),
    _section_sql(7, "Attributes", "doc_attributes", ["name", "type", "description"], ["Name", "Type", "Description"]),
    _section_sql(8, "Returns", "doc_returns", ["type", "description"], ["Type", "Description"]),
    _section_sql(9, "Yields", "doc_yields", ["type", "description"], ["Type", "Description"]),
    _section_sql(11, "Raises", "doc_raises", ["error", "description"], ["Name", "Description"]),
    _section_sql(12, "Warns", "doc_warns", ["warning", "description"], ["Warning Type", "Description"]),
    """SELECT id, 15, 'Notes', 0, 'note' FROM fx_docs WHERE k % 3 <> 0""",
    """SELECT id, 16, 'Examples', 0, '>>> run()' FROM fx_docs WHERE doc_examples"""]) + ") t")
def doc_sections(c: Corpus) -> DataFrame:
    return D.doc_sections(_paged(c), docs(c).select("repo_id", "id", "doc"), "en", "table").select(
        "id", "section_no", "section", "item_no", "text")


def _numpy_sql(title: str, flag: str, head: str, wrapped: bool = True) -> str:
    body = "chr(10) || '    description ' || CAST(k AS STRING)" if wrapped else "' : description ' || CAST(k AS STRING)"
    return (f"CASE WHEN {flag} THEN chr(10) || chr(10) || '{title}' || chr(10) || repeat('-', {len(title)}) || chr(10) || {head} || {body} ELSE '' END")


_NAMED = "'name ' || CAST(k AS STRING) || ' : type ' || CAST(k AS STRING)"
NUMPY = " || ".join([
    "short_summary", "CASE WHEN extended_summary <> '' THEN chr(10) || chr(10) || extended_summary ELSE '' END",
    _numpy_sql("Parameters", "doc_params", _NAMED), _numpy_sql("Attributes", "doc_attributes", _NAMED),
    _numpy_sql("Returns", "doc_returns", "'type ' || CAST(k AS STRING)"), _numpy_sql("Yields", "doc_yields", "'type ' || CAST(k AS STRING)"),
    _numpy_sql("Raises", "doc_raises", "'error ' || CAST(k AS STRING)", False), _numpy_sql("Warns", "doc_warns", "'warning ' || CAST(k AS STRING)", False),
    "CASE WHEN k % 3 <> 0 THEN chr(10) || chr(10) || 'Notes' || chr(10) || '-----' || chr(10) || 'note' ELSE '' END",
    "CASE WHEN doc_examples THEN chr(10) || chr(10) || 'Examples' || chr(10) || '--------' || chr(10) || '>>> run()' ELSE '' END"])


@query(f"SELECT id, {NUMPY} AS docstring FROM fx_docs")
def render_docstring(c: Corpus) -> DataFrame:
    return D.render_docstring(docs(c).select("repo_id", "id", "doc")).select("id", "docstring")


@query(f"""WITH chosen AS (SELECT id, k, row_number() OVER (ORDER BY id) AS pos, regexp_replace(regexp_replace({NUMPY}, '^\\s+', ''), '\\s+$', '') AS doc FROM fx_docs WHERE component_type = 'class')
SELECT k AS pos, id, CASE WHEN pos > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '[INPUT]' || chr(10) || 'src of ' || id || chr(10) || chr(10) || '[OUTPUT]' || chr(10) || '\"\"\"' || chr(10)
  || doc || chr(10) || '\"\"\"' AS text FROM (SELECT *, row_number() OVER (ORDER BY k) AS pos FROM (SELECT id, k, doc FROM chosen) a) b""")
def few_shot(c: Corpus) -> DataFrame:
    """Example set made of all classes, in the order of their numbers."""
    keys = c.components.where("component_type = 'class'").select(F.col("k").alias("pos"), "repo_id", "id")
    comps = c.components.withColumn("source_code", F.concat(F.lit(" src of "), F.col("id")))
    texts = D.render_docstring(docs(c).select("repo_id", "id", "doc"))
    return D.few_shot(comps, texts, keys).select("pos", "id", "text")


@query("""
SELECT module AS repo_id, count(DISTINCT s_suppkey) AS n_files, count(*) AS n_components, CAST(count(*) * 7 AS DOUBLE) AS seconds,
  CAST(count(*) * 7 // 3600 AS STRING) || ':' || lpad(CAST(count(*) * 7 % 3600 // 60 AS STRING), 2, '0') || ':' || lpad(CAST(count(*) * 7 % 60 AS STRING), 2, '0') AS formatted
FROM fx_method JOIN fx_module ON n_nationkey = s_nationkey GROUP BY 1""")
def run_metadata(c: Corpus) -> DataFrame:
    rows = c.sql("SELECT module AS repo_id, s_suppkey, id FROM fx_method JOIN fx_module ON n_nationkey = s_nationkey")
    runs = rows.groupBy("repo_id").agg((F.count(F.lit(1)) * 7).cast("double").alias("seconds"))
    return D.run_metadata(rows.select("repo_id", "s_suppkey").distinct(), rows, runs)
