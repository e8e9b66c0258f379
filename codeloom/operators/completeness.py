"""Which documentation sections a component needs, which it has, and the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import is_present_list, is_present_text
from codeloom.operators.skew import lookup_join

# --- fixed values: section -> field of the documentation, in report order ----
FUNCTION_SECTIONS = ["summary", "description", "parameters", "returns", "yields", "raises", "warns", "examples"]
CLASS_SECTIONS = ["summary", "description", "parameters", "attributes", "examples"]
TEXT_FIELDS = {"summary": "short_summary", "description": "extended_summary", "examples": "examples"}
REPORT_COLUMNS = ["Component", "Type", "Score", "Required Sections", "Missing Sections"]
# ----------------------------------------------------------------------------


def parameter_flags(params: DataFrame) -> DataFrame:
    """Per component: does it have parameters to document, i.e. more than a lone ``self``."""
    return params.groupBy("repo_id", F.col("component_id").alias("id")).agg(
        ((F.count(F.lit(1)) > 1) | (F.min("name") != "self")).alias("has_params"))


def _sections(rules: list[tuple[str, Column | bool]]) -> Column:
    return F.array_compact(F.array(*[
        F.lit(name) if rule is True else F.when(rule, F.lit(name)) for name, rule in rules]))


def required_function(facts: DataFrame) -> Column:
    """Sections a function or method needs.

    A generator documents what it yields, never what it returns.
    """
    c = F.col
    return _sections([
        ("summary", True), ("description", True), ("parameters", c("has_params")),
        ("returns", (c("has_return_annotation") | c("returns_value")) & ~c("has_yield")),
        ("yields", c("has_yield")), ("raises", c("has_raise")), ("warns", c("has_warn")),
        ("examples", ~c("is_private") & ~c("is_abstract")),
    ])


def required_class(facts: DataFrame) -> Column:
    """Sections a class needs; a class on one line needs no description."""
    c = F.col
    return _sections([
        ("summary", True), ("description", c("n_lines") > 1), ("parameters", c("has_params")),
        ("attributes", c("has_attributes")), ("examples", ~c("is_private")),
    ])


def required_sections(facts: DataFrame) -> DataFrame:
    """``facts`` (one row per component) -> repo_id, id, component_type, required."""
    is_class = F.col("component_type") == "class"
    return facts.select("repo_id", "id", "component_type",
                        F.when(is_class, required_class(facts)).otherwise(required_function(facts)).alias("required"))


def present_sections(docs: DataFrame) -> DataFrame:
    """Sections with something in them; ``docs(repo_id, id, doc)``."""
    def has(section: str) -> Column:
        if section in TEXT_FIELDS:
            return is_present_text(f"doc.{TEXT_FIELDS[section]}")
        return is_present_list(f"doc.{section}")

    every = list(dict.fromkeys(FUNCTION_SECTIONS + CLASS_SECTIONS))
    return docs.select("repo_id", "id", _sections([(s, has(s)) for s in every]).alias("present"))


def completeness(required: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of the required sections that are present, with the missing ones."""
    joined = required.join(present_sections(docs), ["repo_id", "id"], "left")
    missing = F.array_except("required", F.coalesce("present", F.array().cast("array<string>")))
    n = F.size("required")
    score = F.when(n > 0, (n - F.size(missing)) / n).otherwise(
        F.when(F.col("component_type") == "class", 1.0).otherwise(0.0))
    return joined.select("repo_id", "id", "component_type", "required", missing.alias("missing"),
                         score.cast("double").alias("score"))


def completeness_summary(scores: DataFrame) -> DataFrame:
    """Mean and count per component type and per repository (type ``all``)."""
    rolled = scores.rollup("repo_id", "component_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.grouping_id().alias("_g"))
    return rolled.where("_g < 2").select(
        "repo_id", F.when(F.col("_g") == 1, "all").otherwise(F.col("component_type")).alias("component_type"),
        "n", "mean_score")


def percent(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.format_string("%.2f%%", (s * 100).cast("double"))


def completeness_report(scores: DataFrame) -> DataFrame:
    """Text table per repository: (repo_id, section, id, line); section 0 is the head."""
    def listed(col: str) -> Column:
        return F.when(F.size(col) == 0, "-").otherwise(F.array_join(F.array_sort(col), ", "))

    cells = scores.select(
        "repo_id", "id", "score", F.array(
            F.col("id"), F.initcap("component_type"), percent("score"), listed("required"), listed("missing")
        ).alias("cells"))
    widths = cells.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"),
        F.array(*[F.greatest(F.lit(len(h)), F.max(F.length(F.col("cells")[i]))) for i, h in enumerate(REPORT_COLUMNS)]
                ).alias("w"))

    def row(values: list[Column]) -> Column:
        return F.concat_ws(" | ", *[F.rpad(v, F.col("w")[i], F.lit(" ")) for i, v in enumerate(values)])

    body = lookup_join(cells, widths, ["repo_id"]).select(
        "repo_id", F.lit(1).cast("long").alias("section"), "id",
        row([F.col("cells")[i] for i in range(len(REPORT_COLUMNS))]).alias("line"))
    first = F.concat(F.lit("Overall Completeness Score: "), percent("mean"))
    second = F.format_string("Total Components Evaluated: %d", "n")
    dashes = F.concat_ws("-+-", *[F.repeat(F.lit("-"), F.col("w")[i]) for i in range(len(REPORT_COLUMNS))])
    head = widths.select("repo_id", F.posexplode(F.array(
        first, second, F.repeat(F.lit("="), F.greatest(F.length(first), F.length(second))), F.lit("\n"),
        row([F.lit(h) for h in REPORT_COLUMNS]), dashes)).alias("pos", "line"))
    return body.unionByName(head.select(
        "repo_id", F.lit(0).cast("long").alias("section"), F.format_string("%d", "pos").alias("id"), "line"))
