"""Document views of a corpus: nesting, contents, sections, docstrings, example sets."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.exprs import fmt_elapsed, owner_id
from codeloom.operators.skew import lookup_join, numbered

# --- fixed values: labels in the two document languages ----------------------
LABELS = {
    "id": {
        "type": "Tipe", "file": "Lokasi File", "parameters": "Parameters", "attributes": "Attributes",
        "returns": "Returns", "yields": "Yields", "receives": "Receives", "raises": "Raises", "warns": "Warns",
        "warnings_section": "Warnings", "see_also": "See Also", "notes": "Notes", "examples": "Examples",
        "summary": "Summary", "description": "Description", "graph": "Visualisasi Dependensi",
        "name": "Nama", "col_type": "Tipe", "desc": "Deskripsi", "warning": "Warning Type", "ref": "Reference",
    },
    "en": {
        "type": "Type", "file": "File Path", "parameters": "Parameters", "attributes": "Attributes",
        "returns": "Returns", "yields": "Yields", "receives": "Receives", "raises": "Raises", "warns": "Warns",
        "warnings_section": "Warnings", "see_also": "See Also", "notes": "Notes", "examples": "Examples",
        "summary": "Summary", "description": "Description", "graph": "Dependency Visualization",
        "name": "Name", "col_type": "Type", "desc": "Description", "warning": "Warning Type", "ref": "Reference",
    },
}
# section of the documentation -> (fields shown, column labels)
ITEM_SECTIONS = {
    "parameters": (["name", "type", "description"], ["name", "col_type", "desc"]),
    "attributes": (["name", "type", "description"], ["name", "col_type", "desc"]),
    "returns": (["type", "description"], ["col_type", "desc"]),
    "yields": (["type", "description"], ["col_type", "desc"]),
    "receives": (["name", "type", "description"], ["name", "col_type", "desc"]),
    "raises": (["error", "description"], ["name", "desc"]),
    "warns": (["warning", "description"], ["warning", "desc"]),
    "see_also": (["name", "description"], ["ref", "desc"]),
}
SECTION_ORDER = ["parameters", "attributes", "returns", "yields", "receives", "raises", "warns",
                 "warnings_section", "see_also", "notes", "examples"]
WRAP_WIDTH = 75
# ----------------------------------------------------------------------------


def nest_methods(components: DataFrame) -> DataFrame:
    """Sidebar rows: (repo_id, top_id, top_type, method_pos, method_id).

    A class is followed by its methods in source order; its own row has position
    0 and no method.  A method without a class in the corpus is a top row.
    """
    cols = components.select("repo_id", "id", "component_type", "start_line")
    classes = cols.where("component_type = 'class'").select("repo_id", F.col("id").alias("top_id"), F.lit(True).alias("_in"))
    methods = cols.where("component_type = 'method'").withColumn("top_id", owner_id("id")).join(
        classes.distinct(), ["repo_id", "top_id"], "left")
    inner = methods.where("_in")
    placed = numbered(inner.select("repo_id", "top_id", "id", "start_line"), ["repo_id", "top_id"],
                      [F.coalesce("start_line", F.lit(0)), F.col("id")], "method_pos")
    nested = placed.select("repo_id", "top_id", F.lit("class").alias("top_type"), "method_pos", F.col("id").alias("method_id"))
    top = cols.where("component_type <> 'method'").unionByName(methods.where("_in IS NULL").select(*cols.columns))
    return nested.unionByName(top.select(
        "repo_id", F.col("id").alias("top_id"), F.col("component_type").alias("top_type"),
        F.lit(0).cast("long").alias("method_pos"), F.lit(None).cast("string").alias("method_id")))


def nested_lists(nested: DataFrame, size: int = 10_000) -> DataFrame:
    """Method lists per class, at most ``size`` per row (``part`` 0, 1, ...)."""
    part = F.greatest(F.floor((F.col("method_pos") - 1) / size), F.lit(0)).cast("long").alias("part")
    listed = F.array_sort(F.collect_list(F.when(F.col("method_pos") > 0, F.struct("method_pos", "method_id"))))
    return nested.groupBy("repo_id", "top_id", "top_type", part).agg(
        F.transform(listed, lambda m: m["method_id"]).alias("methods"))


def toc(components: DataFrame) -> DataFrame:
    """Table of contents in document order; methods are indented with a bullet."""
    placed = numbered(components.select("repo_id", "file_path", "id", "component_type"), ["repo_id"],
                      [F.col("file_path"), F.col("id")], "pos")
    is_method = F.col("component_type") == "method"
    return placed.select(
        "repo_id", "pos", "id", F.when(is_method, F.concat(F.lit("• "), F.col("id"))).otherwise(F.col("id")).alias("text"),
        F.when(is_method, 1).otherwise(0).cast("long").alias("indent"))


def legacy_returns(doc_json: Column | str, schema: str) -> Column:
    """Parse documentation JSON whose ``returns`` may be one object instead of a list."""
    doc = F.from_json(doc_json, schema)
    lone = F.from_json(doc_json, "returns struct<type:string,description:string>")["returns"]
    return F.when(doc["returns"].isNull() & lone.isNotNull(), doc.withField("returns", F.array(lone))).otherwise(doc)


def doc_sections(components: DataFrame, docs: DataFrame, lang: str = "id", mode: str = "table") -> DataFrame:
    """Document content, one row per (component, section, item).

    Columns: repo_id, id, section_no, section (heading), item_no, text.  Empty
    sections have no rows; a component without documentation has none at all.
    ``mode='table'`` gives table rows (item 0 is the head row), ``'text'`` gives
    Markdown items.  An unknown language falls back to ``id``.
    """
    lab = LABELS.get(lang, LABELS["id"])
    rows = components.join(docs.where("doc IS NOT NULL"), ["repo_id", "id"])
    blocks: list[Column] = []

    def block(no: int, title: Column, items: Column) -> None:
        blocks.append(F.struct(F.lit(no).cast("long").alias("section_no"), title.alias("section"), items.alias("items")))

    def one(text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(F.array().cast("array<string>"))

    block(1, F.col("id"), F.array(F.concat(
        F.lit(lab["type"] + ": "), F.initcap("component_type"), F.lit(" | " + lab["file"] + ": "), F.col("relative_path"))))
    block(2, F.lit(""), one(F.col("signature")))
    block(3, F.lit(lab["graph"]), one(F.col("graph_url")))
    block(4, F.lit(lab["summary"]), one(F.col("doc.short_summary")))
    block(5, F.lit(lab["description"]), one(F.col("doc.extended_summary")))
    for no, section in enumerate(SECTION_ORDER, start=6):
        value = F.col(f"doc.{section}")
        if section not in ITEM_SECTIONS:
            block(no, F.lit(lab[section]), one(value))
            continue
        fields, heads = ITEM_SECTIONS[section]
        some = F.coalesce(F.size(value) > 0, F.lit(False))
        if mode == "table":
            head = "| " + " | ".join(lab[h] for h in heads) + " |"
            cell = lambda item: F.concat(F.lit("| "), F.concat_ws(" | ", *[
                F.coalesce(item[f], F.lit("")) for f in fields]), F.lit(" |"))  # noqa: B023
            items = F.concat(F.array(F.lit(head)), F.transform(value, cell))
        else:
            items = F.transform(value, lambda item: _text_item(item, fields))  # noqa: B023
        block(no, F.lit(lab[section]), F.when(some, items).otherwise(F.array().cast("array<string>")))
    exploded = rows.select("repo_id", "id", F.explode(F.array(*blocks)).alias("b"))
    return exploded.select("repo_id", "id", "b.section_no", "b.section", F.posexplode("b.items").alias("item_no", "text")
                           ).withColumn("item_no", F.col("item_no").cast("long"))


def _text_item(item: Column, fields: list[str]) -> Column:
    main, *rest = fields
    name = F.coalesce(item[main], F.lit(""))
    head = F.when(name != "", F.concat(F.lit("**"), name, F.lit("**"))).otherwise("")
    if "type" in rest:
        kind = F.coalesce(item["type"], F.lit(""))
        head = F.concat(head, F.when(kind != "", F.concat(F.lit(" *("), kind, F.lit(")*"))).otherwise(""))
    desc = F.coalesce(item["description"], F.lit(""))
    return F.concat(head, F.when(desc != "", F.concat(F.lit("\n    "), desc)).otherwise(""))


# --- docstrings -------------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.StringType()))
def _wrapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Descriptions filled to the line width and indented by four blanks."""
    def fill(text):
        return textwrap.indent(textwrap.fill(text, width=WRAP_WIDTH), "    ") if text else ""
    for batch in batches:
        yield batch.map(lambda texts: [fill(t) for t in texts])


def render_docstring(docs: DataFrame) -> DataFrame:
    """Numpy-style docstring per component: (repo_id, id, docstring).

    Sections without content are left out.  Raises and warns are listed under
    their own key (error, warning).
    """
    wrapped_in = ["parameters", "attributes", "returns", "yields", "receives"]
    empty = F.array().cast("array<string>")
    descs = [F.coalesce(F.transform(f"doc.{s}", lambda x: x["description"]), empty) for s in wrapped_in]
    rows = docs.where("doc IS NOT NULL").withColumn("_w", _wrapped(F.concat(*descs)))
    start: Column = F.lit(1)
    parts: list[Column] = []

    def section(title: str, lines: Column, present: Column) -> None:
        head = F.array(F.lit(""), F.lit(title), F.lit("-" * len(title)))
        parts.append(F.when(F.coalesce(present, F.lit(False)), F.concat(head, lines)).otherwise(empty))

    short, extended = F.col("doc.short_summary"), F.col("doc.extended_summary")
    has_short = F.coalesce(short, F.lit("")) != ""
    parts.append(F.when(has_short, F.array(short)).otherwise(empty))
    parts.append(F.when(F.coalesce(extended, F.lit("")) != "", F.when(has_short, F.array(F.lit(""), extended)).otherwise(F.array(extended))).otherwise(empty))

    texts: dict[str, Column] = {}
    for s in wrapped_in:
        size = F.greatest(F.coalesce(F.size(f"doc.{s}"), F.lit(0)), F.lit(0))
        texts[s] = F.slice("_w", start, size)
        start = start + size

    def entries(s: str, head, bare: bool) -> Column:
        """Head line and indented description; ``bare`` items without a head are just their description."""
        def one(item: Column, i: Column) -> Column:
            text, line = F.get(texts[s], i), head(item)
            body = F.when(text != "", F.array(text)).otherwise(empty)
            full = F.concat(F.array(line), body)
            if not bare:
                return full
            desc = F.coalesce(item["description"], F.lit(""))
            return F.when(line != "", full).when(desc != "", F.array(desc)).otherwise(empty)
        none = F.array().cast(rows.schema["doc"].dataType[s].dataType)
        return F.flatten(F.transform(F.coalesce(F.col(f"doc.{s}"), none), one))

    def typed(item: Column) -> Column:
        kind = F.coalesce(item["type"], F.lit(""))
        return F.concat(F.coalesce(item["name"], F.lit("")), F.when(kind != "", F.concat(F.lit(" : "), kind)).otherwise(""))

    def returned(item: Column) -> Column:
        return F.trim(F.coalesce(item["type"], F.lit("")))

    def received(item: Column) -> Column:
        name = F.coalesce(item["name"], F.lit(""))
        return F.trim(F.concat(F.when(name != "", F.concat(name, F.lit(" : "))).otherwise(""), F.coalesce(item["type"], F.lit(""))))

    def simple(s: str, key: str) -> Column:
        return F.transform(f"doc.{s}", lambda x: F.concat(F.coalesce(x[key], F.lit("")), F.lit(" : "), F.coalesce(x["description"], F.lit(""))))

    for s, head, bare in (("parameters", typed, False), ("attributes", typed, False), ("returns", returned, True),
                          ("yields", returned, True), ("receives", received, True)):
        section(s.capitalize(), entries(s, head, bare), F.size(f"doc.{s}") > 0)
    section("Raises", simple("raises", "error"), F.size("doc.raises") > 0)
    section("Warns", simple("warns", "warning"), F.size("doc.warns") > 0)
    section("Warnings", F.array("doc.warnings_section"), F.col("doc.warnings_section") != "")
    section("See Also", simple("see_also", "name"), F.size("doc.see_also") > 0)
    section("Notes", F.array("doc.notes"), F.col("doc.notes") != "")
    section("Examples", F.array("doc.examples"), F.col("doc.examples") != "")
    return rows.select("repo_id", "id", F.array_join(F.concat(*parts), "\n").alias("docstring"))


def few_shot(components: DataFrame, docstrings: DataFrame, keys: DataFrame) -> DataFrame:
    """Example texts for chosen components, in key order: (pos, id, text).

    ``keys(pos, repo_id, id)``.  Components without source or documentation are
    left out.  Every text but the first begins with the separator, so the texts
    written one after the other are the example file.
    """
    def strip(col: str) -> Column:
        return F.regexp_replace(F.col(col), r"^\s+|\s+$", "")

    picked = (
        lookup_join(components.select("repo_id", "id", "source_code"), keys, ["repo_id", "id"])
        .where("source_code IS NOT NULL AND source_code <> ''")
        .join(docstrings, ["repo_id", "id"])
    )
    text = F.concat(F.lit("[INPUT]\n"), strip("source_code"), F.lit('\n\n[OUTPUT]\n"""\n'), strip("docstring"), F.lit('\n"""'))
    placed = numbered(picked.select("pos", "repo_id", "id", text.alias("text")), [], [F.col("pos")], "_n")
    return placed.select("pos", "repo_id", "id", F.when(F.col("_n") > 1, F.concat(F.lit("\n\n---\n\n"), F.col("text"))).otherwise(F.col("text")).alias("text"))


def run_metadata(files: DataFrame, components: DataFrame, runs: DataFrame) -> DataFrame:
    """Per repository: discovered files, components, and elapsed time from ``runs(repo_id, seconds)``."""
    f = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
    c = components.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_components"))
    return (
        runs.join(f, "repo_id", "left").join(c, "repo_id", "left").na.fill(0, ["n_files", "n_components"])
        .select("repo_id", "n_files", "n_components", "seconds", fmt_elapsed("seconds").alias("formatted"))
    )
