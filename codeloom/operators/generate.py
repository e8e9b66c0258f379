"""Batch generation: prompts, model calls, gather and revise rounds, level order.

The model is the caller's: a function from a list of prompts to a list of
responses.  Every round is a DataFrame job over the rows still open; rows that
are done leave the loop.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.tokens import Tokenizer
from codeloom.operators.context import MAX_TOKENS, assemble, expand_requested, merge_external
from codeloom.operators.skew import numbered
from codeloom.schemas import DOCUMENTATION, NEED, REPORT
from codeloom.session import cut, moves_deleted, shared_folder

# --- fixed values -----------------------------------------------------------
MAX_REJECTIONS = 2
MAX_ATTEMPTS = 3
# ----------------------------------------------------------------------------

Model = Callable[[list[str]], Sequence[str | None]]
KEY = ["repo_id", "id"]


# --- model calls ------------------------------------------------------------

def apply_model(df: DataFrame, model: Model, prompt: str = "prompt", retries: int = 1) -> DataFrame:
    """Adds ``response`` and ``error``.

    A batch that fails is asked row by row, each row up to ``retries`` more
    times; a row that keeps failing has a null response and its error text.  The
    result is kept, so a later step never calls the model again for it.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def one(text: str) -> tuple[str | None, str | None]:
        problem = None
        for _ in range(retries + 1):
            try:
                return list(model([text]))[0], None
            except Exception as e:  # noqa: BLE001 - whatever the caller's model raises marks the row
                problem = str(e) or type(e).__name__
        return None, problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(prompt).to_pylist()
            try:
                answers = [(r, None) for r in model(prompts)]
                if len(answers) != len(prompts):
                    raise ValueError("one response per prompt expected")
            except Exception:  # noqa: BLE001
                answers = [one(p) for p in prompts]
            columns = [*batch.columns, pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return cut(df.mapInArrow(run, schema))


class CallLog:
    """Answers of models in a folder, so that a run that was stopped does not pay for them again.

    A call is known by the agent, the component, the round (whatever of ``attempts`` and ``rejections`` the rows carry)
    and the prompt.  ``apply`` takes answers from the log and calls the model for the rest; those answers are written
    before they are used.  Calls that failed are not kept and so are made again by the next run.
    """

    ROUND = ("attempts", "rejections")
    SCHEMA = "call string, repo_id string, id string, response string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def answers(self, agent: str | None = None) -> DataFrame:
        """What the log holds: agent, call, repo_id, id, response."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], f"{self.SCHEMA}, agent string")
        rows = self.spark.read.schema(f"{self.SCHEMA}, agent string").option("basePath", self.path).parquet(f"{self.path}/agent=*/part=*")
        return rows if agent is None else rows.where(F.col("agent") == agent)

    def apply(self, df: DataFrame, model: Model, agent: str, prompt: str = "prompt", retries: int = 1) -> DataFrame:
        """As ``apply_model``."""
        rounds = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.ROUND if c in df.columns]
        own = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in KEY], *rounds, F.md5(F.coalesce(F.col(prompt), F.lit("")).cast("binary")))
        rows = cut(df.withColumn("_call", F.sha2(own, 256)))
        known = cut(self.answers(agent).groupBy("call").agg(F.min("response").alias("response")).withColumnRenamed("call", "_call"))
        fresh = apply_model(rows.join(known, "_call", "left_anti"), model, prompt, retries)
        fresh.where("error IS NULL").select(F.col("_call").alias("call"), *KEY, "response").write.parquet(f"{self.path}/agent={agent}/part={uuid.uuid4().hex}")
        old = rows.join(known, "_call").withColumn("error", F.lit(None).cast("string"))
        columns = [*df.columns, "response", "error"]
        return old.select(*columns).unionByName(fresh.select(*columns))


def _calls(log: CallLog | None) -> Callable[..., DataFrame]:
    def call(df: DataFrame, model: Model, agent: str) -> DataFrame:
        return apply_model(df, model) if log is None else log.apply(df, model, agent)
    return call


def assign_pool(df: DataFrame, size: int, order: Sequence[Column], name: str = "endpoint") -> DataFrame:
    """Round robin: the n-th row in ``order`` gets endpoint (n - 1) mod size."""
    placed = numbered(df, [], order, "_n")
    return placed.withColumn(name, F.pmod(F.col("_n") - 1, F.lit(size)).cast("long")).drop("_n")


# --- prompts and responses --------------------------------------------------

@dataclass(frozen=True)
class Templates:
    """Prompt texts of the caller.  Slots: {context} {rules} {code} {feedback} {documentation} {checklist}."""

    reader: str = "Context:\n{context}\n\nComponent:\n{code}\n{feedback}"
    writer_first: str = "Context: {context}\n\n{rules}\n\n{code}\n"
    writer_again: str = "{feedback}\n\n{rules}\n\n{code}\n"
    verifier: str = "Context: {context}\n\n{checklist}\n\n{code}\n\n{documentation}\n"
    class_rules: str = "Document this class."
    function_rules: str = "Document this function."
    class_checklist: str = "Check this class."
    function_checklist: str = "Check this function."


def fill(template: str, **slots: Column) -> Column:
    """The template with its {slots} replaced by columns; braces inside the values are left alone."""
    parts = [F.coalesce(slots[p[1:-1]], F.lit("")) if p[1:-1] in slots and p[0] == "{" else F.lit(p)
             for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def _by_type(for_class: str, for_function: str) -> Column:
    return F.when(F.col("component_type") == "class", for_class).otherwise(for_function)


def build_prompts(df: DataFrame, templates: Templates) -> DataFrame:
    """Writer prompts: the first attempt in full, later ones (``feedback`` not null) the short form."""
    slots = dict(context=F.col("context"), code=F.col("focal"), feedback=F.col("feedback"),
                 rules=_by_type(templates.class_rules, templates.function_rules))
    return df.withColumn("prompt", F.when(F.col("feedback").isNull(), fill(templates.writer_first, **slots))
                         .otherwise(fill(templates.writer_again, **slots)))


def parse_structured(response: Column | str, schema: T.StructType, required: Sequence[str] = ()) -> Column:
    """A JSON response (with or without a code fence) as a struct; null if it is broken or lacks a required field."""
    text = F.col(response) if isinstance(response, str) else response
    body = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    corrupt = "_corrupt_record"
    parsed = F.from_json(body, T.StructType(schema.fields + [T.StructField(corrupt, T.StringType())]),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    ok = parsed.isNotNull() & parsed[corrupt].isNull() & (F.trim(F.coalesce(body, F.lit(""))) != "")
    for name in required:
        ok = ok & parsed[name].isNotNull()
    return F.when(ok, parsed.dropFields(corrupt))


def parse_doc(response: Column | str) -> Column:
    return parse_structured(response, DOCUMENTATION, ["short_summary"])


def parse_need(response: Column | str) -> Column:
    """A reader's answer; a broken one needs nothing."""
    nothing = F.struct(F.lit(False).alias("info_need"), *[
        F.lit(None).cast("array<string>").alias(n) for n in ("internal_expand", "external_retrieval")])
    return F.coalesce(parse_structured(response, NEED, ["info_need"]), nothing)


def parse_report(response: Column | str) -> Column:
    """A verifier's answer; null if broken (the caller routes that to the writer)."""
    return parse_structured(response, REPORT, ["critiques", "suggested_next_step", "suggestion_feedback"])


# --- rounds -----------------------------------------------------------------

def gather_rounds(parts: DataFrame, components: DataFrame, state: DataFrame, reader: Model, searcher: Model,
                  templates: Templates = Templates(), max_attempts: int = MAX_ATTEMPTS, max_tokens: int = MAX_TOKENS,
                  tokenizer: Tokenizer | None = None, log: CallLog | None = None) -> tuple[DataFrame, DataFrame]:
    """Ask whether the context suffices and extend it until it does or the attempts are used up.

    With a ``log``, answers of an earlier run are used again.

    ``state(repo_id, id, attempts, feedback)`` lists the components to ask
    about.  Returns (parts, state with the new attempts).  The extension that
    uses the last attempt is not asked about again.
    """
    state, call = cut(state), _calls(log)
    open_, closed = state, state.limit(0)
    sources = components.select(*KEY, "component_type", "source_code")
    for _ in range(max_attempts + 1):
        asked = cut(open_)
        if not asked.take(1):
            break
        mine = asked.select(*KEY)
        contexts = assemble(parts.join(mine, KEY, "left_semi"), sources.join(mine, KEY, "left_semi"), max_tokens, tokenizer)
        prompts = _whole(contexts).join(asked, KEY).withColumn("prompt", fill(
            templates.reader, context=F.col("context"), code=F.col("focal"), feedback=F.col("feedback")))
        answered = call(prompts.select(*state.columns, "prompt"), reader, "reader").withColumn("need", parse_need("response"))
        more = F.col("need.info_need") & (F.col("attempts") < max_attempts)
        answered = cut(answered.withColumn("_more", more))
        extended = answered.where("_more").withColumn("attempts", F.col("attempts") + 1)
        requests = extended.select(*KEY, F.explode("need.internal_expand").alias("part_id"))
        queries = extended.select(*KEY, "attempts", F.posexplode("need.external_retrieval").alias("at", "query")).where("query <> ''")
        replies = call(queries.withColumn("prompt", F.col("query")), searcher, "searcher").select(
            *KEY, (F.col("attempts") * 1_000_000 + F.col("at")).alias("seq"), "query", F.trim(F.coalesce("response", F.lit(""))).alias("answer"))
        parts = cut(merge_external(expand_requested(parts, requests, components), replies))
        left = extended.select(*state.columns)
        closed = closed.unionByName(answered.where("NOT _more").select(*state.columns)).unionByName(
            left.where(F.col("attempts") >= max_attempts))
        open_ = left.where(F.col("attempts") < max_attempts)
    return parts, cut(closed.unionByName(open_))


def _whole(contexts: DataFrame) -> DataFrame:
    """Context texts in one row per component (a prompt is one text)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "context"))), lambda x: x["context"]), "")
    return contexts.groupBy(*KEY, "component_type", "focal").agg(text.alias("context"))


def revise_rounds(state: DataFrame, write: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame],
                  regather: Callable[[DataFrame], DataFrame] | None = None,
                  max_rejections: int = MAX_REJECTIONS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Write, verify, route.

    ``state(repo_id, id, attempts, rejections, feedback, ...)``.  ``write`` adds
    ``doc``; ``verify`` adds ``needs_revision``, ``step`` and ``next_feedback``
    (rows it leaves out count as rejected, next step writer).  A draft made
    after the last rejection is accepted unverified.  Step ``reader`` goes
    through ``regather`` (which sets ``attempts``) if attempts remain and ends
    otherwise; any other step goes back to the writer.
    """
    names = state.columns
    out = [n for n in names if n != "feedback"] + ["doc"]
    open_ = cut(state)
    done: list[DataFrame] = []
    for _ in range(max_rejections + 1):
        if not open_.take(1):
            break
        drafted = cut(write(open_))
        done.append(drafted.where(F.col("rejections") >= max_rejections).select(*out))
        check = drafted.where(F.col("rejections") < max_rejections)
        verdict = verify(check).select(*KEY, "needs_revision", "step", "next_feedback")
        judged = cut(check.join(verdict, KEY, "left").withColumns({
            "needs_revision": F.coalesce("needs_revision", F.lit(True)), "step": F.coalesce("step", F.lit("writer"))}))
        done.append(judged.where("NOT needs_revision").select(*out))
        again = judged.where("needs_revision").withColumn("rejections", F.col("rejections") + 1).withColumn("feedback", F.col("next_feedback"))
        to_reader = again.where("step = 'reader'")
        ended = (F.col("attempts") >= max_attempts) if regather is not None else F.lit(True)
        done.append(to_reader.where(ended).select(*out))
        open_ = again.where("step <> 'reader'").select(*names)
        if regather is not None:
            # the writer starts afresh after more context was gathered
            fresh = regather(to_reader.where(~ended).select(*names)).withColumn("feedback", F.lit(None).cast("string"))
            open_ = open_.unionByName(fresh.select(*names))
        open_ = cut(open_)
    result = done[0]
    for df in done[1:]:
        result = result.unionByName(df)
    return cut(result)


def generate_by_level(order: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], place: str | None = None) -> DataFrame:
    """Generate level by level, so a component sees the documentation of what it depends on.

    ``make(rows, docs)`` gets the rows of one level and the table of all
    documentation so far (``repo_id, id, docstring``; empty for the first level)
    and returns ``repo_id, id, docstring`` for them.  Every level is appended to
    one table; nothing is made twice.  ``place`` names the table's folder: a run
    that finds finished levels there goes on behind them (None: a new folder in
    the shared one).
    """
    spark = order.sparkSession
    place = place or f"{shared_folder(spark)}/docs-{uuid.uuid4().hex}"
    schema = "repo_id string, id string, docstring string"
    order = cut(order.repartitionByRange("level", "repo_id", "id"))  # a level is read from its own files
    top = order.agg(F.max("level")).first()[0]
    docs = spark.createDataFrame([], schema)
    for level in range((-1 if top is None else top) + 1):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/level={level}/_SUCCESS")  # written when a level is whole
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            made = make(order.where(F.col("level") == level), docs).select(*KEY, "docstring")
            with moves_deleted(spark):
                made.write.mode("overwrite").parquet(f"{place}/level={level}")
        docs = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(place)
    return docs


def final_state(written: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """The stored generation state: context form of the documentation, counters and usage map."""
    from codeloom.functions.exprs import context_doc
    state = F.struct(
        F.coalesce(context_doc("doc"), F.lit("")).alias("docstring"),
        F.col("attempts").cast("long").alias("reader_search_attempts"),
        F.col("rejections").cast("long").alias("verifier_rejection_count"),
        F.col("doc").alias("documentation_json"))
    rows = written.select(*KEY, state.alias("final_state"))
    if usage is None:
        return rows
    cell = F.struct("call_count", "input_tokens", "output_tokens", "total_tokens")
    counted = ["call_count", "input_tokens", "output_tokens", "total_tokens"]
    per_agent = usage.groupBy("repo_id", F.col("component_id").alias("id"), "agent").agg(*[F.sum(c).alias(c) for c in counted])
    # one entry per agent: a handful
    stats = per_agent.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("agent", cell))).alias("components"),
                                        F.struct(*[F.sum(c).alias(c) for c in counted]).alias("total"))
    return rows.join(stats.select(*KEY, F.struct("components", "total").alias("usage_stats")), KEY, "left")
