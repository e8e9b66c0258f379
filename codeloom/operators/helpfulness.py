"""Ratings by a model: prompts, parsing of ratings and suggestions, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import is_present_text, round_half_up
from codeloom.operators.skew import lookup_join

# --- fixed values -----------------------------------------------------------
DEFAULT_RATING = 3
RATING_PATTERNS = {
    "summary": [
        r"(?i)<skor>\s*(\d)\s*</skor>",
        r"(?i)<score>\s*(\d)\s*</score>",
        r"(?i)skor:\s*(\d)",
        r"(?i)skor\s*=\s*(\d)",
        r"(?i)(\d)\s*/\s*5",
        r"(?i)level\s*(\d)",
    ],
    "parameters": [
        r"(?i)<skor>\s*(\d)\s*</skor>",
        r"(?i)<score>\s*(\d)\s*</score>",
        r"(?i)skor:\s*(\d)",
        r"(?i)skor\s*=\s*(\d)",
        r"(?i)(\d)\s*/\s*5",
    ],
}
OVERALL_PATTERN = r"(?i)Keseluruhan:\s*\[?(\d)\.?\d*\]?"
NO_DESCRIPTION = "tidak memiliki bagian deskripsi"
SUGGESTION_PATTERNS = {
    "summary": [
        r"(?is)<saran>(.*?)</saran>",
        r"(?is)<suggestions>(.*?)</suggestions>",
        r"(?is)saran:\s*(.+?)(?:\n\n|\z)",
        r"(?is)perbaikan:?\s*(.+?)(?:\n\n|\z)",
    ],
    "parameters": [
        r"(?is)<saran>(.*?)</saran>",
        r"(?is)<suggestions>(.*?)</suggestions>",
        r"(?is)saran:\s*(.+?)(?:\n\n|\z)",
        r"(?is)perbaikan:?\s*(.+?)(?:\n\n|\z)",
    ],
    "description": [
        r"(?is)Saran:\s*(.+?)(?:\n\n|\z)",
        r"(?is)<saran>(.*?)</saran>",
        r"(?is)Suggestions:\s*(.+?)(?:\n\n|\z)",
    ],
}
SUMMARY_HINTS = ["sebaiknya", "bisa", "mungkin", "pertimbangkan", "sarankan", "perbaiki"]
PARAMETER_HINTS = ["saran", "sarankan", "sebaiknya", "perbaiki"]
DEFAULT_SUGGESTION = {
    "summary": "Pertimbangkan untuk menambahkan lebih banyak konteks dan tujuan pada ringkasan.",
    "parameters": "Pertimbangkan untuk menambahkan deskripsi parameter yang lebih rinci.",
    "description": "Pertimbangkan untuk menambahkan lebih banyak detail ke bagian deskripsi.",
}
ADD_DESCRIPTION = "Tambahkan bagian deskripsi ke dokumentasi kode."
EMPTY_DESCRIPTION_PROMPT = "Dokumentasi kode ini tidak memiliki bagian deskripsi untuk dievaluasi."
# ----------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def parse_rating(response: Column | str, metric: str) -> Column:
    """Rating 1..5 read from a response.

    Summary and parameters: the first pattern whose matches have a mean that
    rounds (half up) into 1..5.  Description: the first overall digit as it
    stands, any fraction cut off.
    """
    r = _c(response)
    if metric == "description":
        overall = F.regexp_extract(r, OVERALL_PATTERN, 1)
        return F.when(F.lower(r).contains(NO_DESCRIPTION) | (overall == ""), DEFAULT_RATING).otherwise(
            F.try_to_number(overall, F.lit("9")).cast("int"))
    options = []
    for pattern in RATING_PATTERNS[metric]:
        found = F.regexp_extract_all(r, F.lit(pattern), 1)
        total = F.aggregate(found, F.lit(0), lambda acc, d: acc + d.cast("int"))
        mean = round_half_up(F.try_divide(total, F.size(found)))
        options.append(F.when(mean.between(1, 5), mean))
    return F.coalesce(*options, F.lit(DEFAULT_RATING))


def _has_hint(text: Column, hints: Sequence[str]) -> Column:
    low = F.lower(text)
    flag = low.contains(hints[0])
    for h in hints[1:]:
        flag = flag | low.contains(h)
    return flag


def parse_suggestion(response: Column | str, metric: str) -> Column:
    """Suggestion text: first tag or label; else hint sentences (summary), the line
    behind a hint line (parameters), else a default."""
    r = _c(response)
    labelled = F.coalesce(*[
        F.when(F.regexp_like(r, F.lit(p)), _strip(F.regexp_extract(r, p, 1))) for p in SUGGESTION_PATTERNS[metric]])
    default = F.lit(DEFAULT_SUGGESTION[metric])
    if metric == "summary":
        hits = F.filter(F.split(r, r"[.!?]\s+"), lambda s: _has_hint(s, SUMMARY_HINTS))
        other = F.when(F.size(hits) > 0, F.concat(F.array_join(F.transform(hits, _strip), " "), F.lit("."))).otherwise(default)
    elif metric == "parameters":
        lines = F.split(r, "\n")
        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i < F.size(lines) - 1) & _has_hint(F.get(lines, i), PARAMETER_HINTS))
        other = F.when(F.size(at) > 0, _strip(F.get(lines, F.get(at, F.lit(0)) + 1))).otherwise(default)
    else:
        other = default
    text = F.when(F.coalesce(labelled, F.lit("")) != "", labelled).otherwise(other)
    if metric == "description":
        return F.when(F.lower(r).contains(NO_DESCRIPTION), ADD_DESCRIPTION).otherwise(text)
    return text


def rate(responses: DataFrame, metric: str) -> DataFrame:
    """Adds ``score`` and ``suggestion``; a failed call (null response) has score 0."""
    failed = F.col("raw_response").isNull()
    return responses.withColumns({
        "score": F.when(failed, F.lit(0)).otherwise(parse_rating("raw_response", metric)),
        "suggestion": F.when(failed, "Error during evaluation").otherwise(parse_suggestion("raw_response", metric))})


def rubric_prompts(components: DataFrame, docs: DataFrame, rubric: DataFrame, metric: str) -> DataFrame:
    """One rating prompt per component.

    ``rubric(metric, applies_to, pos, slot, text)`` is the caller's template, one
    row per line: slot ``text`` is copied, ``type``, ``code`` and ``documentation``
    are filled in (a ``type`` line holds ``%s``).  ``applies_to`` is ``class``,
    ``other`` or ``any``.  ``docs(repo_id, id, documentation)``.
    """
    lines = rubric.where(F.col("metric") == metric)
    kind = F.when(F.col("component_type") == "class", "class").otherwise("other")
    template = (
        lines.withColumn("kind", F.explode(
            F.when(F.col("applies_to") == "any", F.array(F.lit("class"), F.lit("other"))).otherwise(F.array("applies_to"))))
        # a rubric is a hand-written page: a bounded number of lines per kind
        .groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("pos", "slot", "text"))).alias("_lines"))
    )
    rows = lookup_join(
        components.join(docs, ["repo_id", "id"], "left").withColumn("kind", kind), template, ["kind"])

    def fill(line: Column) -> Column:
        return (
            F.when(line["slot"] == "code", F.coalesce("source_code", F.lit("")))
            .when(line["slot"] == "documentation", F.coalesce("documentation", F.lit("")))
            .when(line["slot"] == "type", F.replace(line["text"], F.lit("%s"), F.col("component_type")))
            .otherwise(line["text"]))

    prompt = F.array_join(F.transform("_lines", fill), "\n")
    if metric == "description":
        prompt = F.when(is_present_text("documentation"), prompt).otherwise(EMPTY_DESCRIPTION_PROMPT)
    return rows.select("repo_id", "id", "component_type", F.lit(metric).alias("metric"), prompt.alias("prompt"))


def has_parameters(components: DataFrame, params: DataFrame) -> DataFrame:
    """Components with parameters besides a leading ``self`` or ``cls``.

    ``params`` holds a class's constructor parameters under the class itself.
    Only an ordinary positional first parameter is exempt.
    """
    first = F.min(F.when(F.col("kind") == "positional", F.struct("position", "name")))["name"]
    counted = params.groupBy("repo_id", F.col("component_id").alias("id")).agg(
        (F.count(F.lit(1)) - F.when(first.isin("self", "cls"), 1).otherwise(0)).alias("_n")).where("_n > 0")
    return components.join(counted.select("repo_id", "id"), ["repo_id", "id"], "left_semi")


def rating_summary(scores: DataFrame) -> DataFrame:
    """Mean and count per run; failed calls count as 0."""
    return scores.groupBy("repo_id", "variant", "metric").agg(
        F.avg(F.coalesce("score", F.lit(0))).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def pending(components: DataFrame, existing: DataFrame) -> DataFrame:
    """Components that have no result yet."""
    return components.join(existing.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_anti")


def rescore(responses: DataFrame, components: DataFrame, metric: str, params: DataFrame | None = None
            ) -> tuple[DataFrame, DataFrame]:
    """Re-read stored responses of components that still exist.

    Returns (details, summary).  For the parameter metric pass ``params`` to keep
    only components with parameters.  ``total_components`` counts all components
    of the repository, the mean is taken over the kept rows.
    """
    keep = components if params is None else has_parameters(components, params)
    kept = responses.join(keep.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_semi")
    details = kept.withColumn("score", parse_rating("raw_response", metric))
    totals = components.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_components"))
    means = details.groupBy("repo_id").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("kept"))
    summary = totals.join(means, "repo_id", "left").withColumns({
        "mean_score": F.coalesce("mean_score", F.lit(0.0)), "kept": F.coalesce("kept", F.lit(0))})
    return details, summary


def compare_runs(scores: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Mean score per repository and metric, one column per generator variant."""
    return scores.groupBy("repo_id", "metric").pivot("variant", list(variants)).agg(F.avg("score"))
