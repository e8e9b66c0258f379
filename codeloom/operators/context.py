"""Context of a component under a token budget.

A context is a table of parts, ``parts(repo_id, id, kind, pos, part_id, type,
content)``: ``kind`` is class, parent, dependency, usage or external, ``pos``
counts from 1 inside the kind.  Ranking, budgeting and pruning work on part
rows; text is put together only at the end, in pieces of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.exprs import last_seg, owner_id
from codeloom.functions.tokens import Tokenizer, get_tokenizer, token_count, truncate_tokens
from codeloom.operators.graph import degrees
from codeloom.operators.skew import first_rows, numbered
from codeloom.session import cut, kept

# --- fixed values: limits and the wording of a rendered context ---------------
MAX_TOKENS = 10_000
MAX_REMOVALS = 20
USAGE_SAMPLES = 2
DEPENDENCY_DOC_LENGTH = 30
PARENT_DOC_LENGTH = 15
EXPANDED = "source_code (Expanded by request)"
CLASS_HEAD = "### CLASS CONTEXT\n\nThe component is a method within the `%s` class:\n\n"
PARENT_HEAD = "### PARENT CLASS CONTEXT\n\nThe component's class inherits from the following parent class(es):\n\n"
INTERNAL_HEAD = "### INTERNAL CONTEXT\n\n"
DEPENDENCY_HEAD = "#### Dependencies\n\nThe component to be documented depends on the following internal components:\n\n"
USAGE_HEAD = "#### Usage Examples (`used_by`)\n\nHere are examples of how the component is used:\n\n"
EXTERNAL_HEAD = "### EXTERNAL CONTEXT\n\nInformation retrieved from external sources:\n\n"
PARENT_LINE = "**Parent Class:** `"
COMPONENT_LINE = "**Component:** `"
SOURCE_LINE = "**Source Component:** `"
TYPE_LINE = "`\n**Context Type:** "
QUERY_LINE = "**Query:** `"
RESULT_LINE = "`\n**Result:**\n"
CODE_OPEN, CODE_CLOSE = "```python\n", "\n```"
BLOCK_BREAK = "\n---\n"
SECTION_BREAK = "\n\n"
NO_CONTEXT = "Tidak terdapat konteks untuk komponen tersebut."
# order in the text, and order in which kinds are given up when the budget is exceeded
RENDER_ORDER = ["class", "parent", "dependency", "usage", "external"]
REMOVAL_ORDER = ["external", "class", "usage", "dependency", "parent"]
# ----------------------------------------------------------------------------

PART_COLUMNS = ["repo_id", "id", "kind", "pos", "part_id", "type", "content"]


# --- choosing parts ---------------------------------------------------------

def _scored(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    scores = ranks.select("repo_id", F.col("id").alias("part_id"), "score")
    return pairs.join(scores, ["repo_id", "part_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranked_deps(components: DataFrame, edges: DataFrame, ranks: DataFrame, parents: DataFrame | None = None,
                for_classes: bool = False) -> DataFrame:
    """Dependencies by rank (ties by id): repo_id, id, part_id, score, pos.

    Classes list none unless asked to; a dependency that is also a parent is left out.
    """
    key = ["repo_id", "id"]
    laid = kept(edges).select("repo_id", F.col("src").alias("id"), F.col("dst").alias("part_id"))
    pairs = _scored(laid, ranks)
    # a component's rows meet once, what is known of it: its type and its parents
    up = None if parents is None else parents.groupBy(*key).agg(F.collect_set("parent_id").alias("_up"))
    if not for_classes:
        plain = components.where(F.col("component_type") != "class").select(*key)
        pairs = pairs.join(plain if up is None else plain.join(up, key, "left"), key)
    elif up is not None:
        pairs = pairs.join(up, key, "left")
    if up is not None:
        pairs = pairs.where(~F.coalesce(F.array_contains("_up", F.col("part_id")), F.lit(False))).drop("_up")
    pairs = pairs.distinct()
    return numbered(pairs, key, [F.col("score").desc(), F.col("part_id")], "pos", laid=laid)


def ranked_parents(parents: DataFrame, ranks: DataFrame) -> DataFrame:
    pairs = parents.select("repo_id", "id", F.col("parent_id").alias("part_id")).distinct()
    return numbered(_scored(pairs, ranks), ["repo_id", "id"], [F.col("score").desc(), F.col("part_id")], "pos")


def top_dependencies(components: DataFrame, edges: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best ranked dependencies of every component, with the component's degrees."""
    scored = _scored(edges.select("repo_id", F.col("src").alias("id"), F.col("dst").alias("part_id")), ranks)
    # an edge that comes several times has one rank, so edges need not be told apart before the best are chosen
    by = Window.partitionBy("repo_id", "id").orderBy(F.col("score").desc(), F.col("part_id"))
    top = scored.withColumn("pos", F.dense_rank().over(by).cast("long")).where(F.col("pos") <= k).distinct()
    return top.join(degrees(components, edges), ["repo_id", "id"]).withColumnRenamed("part_id", "dep_id")


def part_content(ranked: DataFrame, components: DataFrame, docs: DataFrame, threshold: int, kind: str) -> DataFrame:
    """Generated documentation if it is long enough, else the source.

    ``docs(repo_id, id, docstring)``.
    """
    texts = components.select("repo_id", F.col("id").alias("part_id"), F.col("source_code").alias("_source")).join(
        docs.select("repo_id", F.col("id").alias("part_id"), "docstring"), ["repo_id", "part_id"], "left")
    documented = F.length(F.coalesce("docstring", F.lit(""))) >= threshold
    return ranked.join(texts, ["repo_id", "part_id"]).select(
        "repo_id", "id", F.lit(kind).alias("kind"), "pos", "part_id",
        F.when(documented, "documentation").otherwise("source_code").alias("type"),
        F.when(documented, F.col("docstring")).otherwise(F.coalesce("_source", F.lit(""))).alias("content"))


def class_context(components: DataFrame, skeletons: DataFrame) -> DataFrame:
    """For every method the skeleton of its class; ``skeletons(repo_id, id, skeleton)``."""
    methods = components.where("component_type = 'method'").select("repo_id", "id", owner_id("id").alias("part_id"))
    outline = skeletons.select("repo_id", F.col("id").alias("part_id"), F.col("skeleton").alias("content"))
    return methods.join(outline, ["repo_id", "part_id"]).select(
        "repo_id", "id", F.lit("class").alias("kind"), F.lit(1).cast("long").alias("pos"), "part_id",
        F.lit("class_skeleton").alias("type"), "content")


def usage_samples(components: DataFrame, edges: DataFrame, k: int = USAGE_SAMPLES,
                  skeletons: DataFrame | None = None) -> DataFrame:
    """The ``k`` shortest users of every component; a method's own class does not count.

    A user without a known length comes last.  Without ``skeletons`` only the
    choice is returned (repo_id, id, part_id, pos), else parts with content.
    """
    lengths = components.select(
        "repo_id", F.col("id").alias("part_id"), F.col("component_type").alias("_user_type"),
        F.when(F.col("end_line") > 0, F.col("end_line") - F.col("start_line") + 1).alias("_lines"))
    types = components.select("repo_id", "id", "component_type")
    pairs = edges.select("repo_id", F.col("dst").alias("id"), F.col("src").alias("part_id")).distinct().join(
        types, ["repo_id", "id"])
    own_class = (F.col("component_type") == "method") & (F.col("part_id") == owner_id("id"))
    best = first_rows(
        pairs.where(~F.coalesce(own_class, F.lit(False))).join(lengths, ["repo_id", "part_id"], "left"),
        ["repo_id", "id"], [F.col("_lines").asc_nulls_last(), F.col("part_id")], k, "pos")
    chosen = best.select("repo_id", "id", "part_id", "pos", "_user_type")
    if skeletons is None:
        return chosen.drop("_user_type")
    # texts are fetched for the chosen users only
    texts = components.select("repo_id", F.col("id").alias("part_id"), "source_code").join(
        skeletons.select("repo_id", F.col("id").alias("part_id"), "skeleton"), ["repo_id", "part_id"], "left")
    snippet = F.when(F.col("_user_type") == "class", F.col("skeleton")).otherwise(F.col("source_code"))
    return chosen.join(texts, ["repo_id", "part_id"], "left").select(
        "repo_id", "id", F.lit("usage").alias("kind"), "pos", "part_id", F.lit("snippet").alias("type"),
        F.coalesce(snippet, F.lit("")).alias("content"))


def initial_parts(components: DataFrame, edges: DataFrame, ranks: DataFrame, parents: DataFrame, docs: DataFrame,
                  skeletons: DataFrame, k: int = USAGE_SAMPLES) -> DataFrame:
    """The context every component starts with."""
    deps = part_content(ranked_deps(components, edges, ranks, parents), components, docs, DEPENDENCY_DOC_LENGTH, "dependency")
    ups = part_content(ranked_parents(parents, ranks), components, docs, PARENT_DOC_LENGTH, "parent")
    return (
        class_context(components, skeletons).unionByName(ups).unionByName(deps)
        .unionByName(usage_samples(components, edges, k, skeletons))
    )


def expand_requested(parts: DataFrame, requests: DataFrame, components: DataFrame) -> DataFrame:
    """Full source for requested ids (``requests(repo_id, id, part_id)``) that are parents or dependencies."""
    sources = components.where("source_code <> ''").select("repo_id", F.col("id").alias("part_id"), F.col("source_code").alias("_full"))
    asked = requests.select("repo_id", "id", "part_id").distinct().join(sources, ["repo_id", "part_id"])
    able = F.coalesce(F.col("kind").isin("parent", "dependency"), F.lit(False))
    hit = F.col("_full").isNotNull()
    # parts of other kinds stay where they are
    return parts.where(able).join(asked, ["repo_id", "id", "part_id"], "left").withColumns({
        "type": F.when(hit, EXPANDED).otherwise(F.col("type")),
        "content": F.when(hit, F.col("_full")).otherwise(F.col("content"))}).select(*PART_COLUMNS).unionByName(parts.where(~able).select(*PART_COLUMNS))


def merge_external(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """Add answers (``repo_id, id, seq, query, answer``); a repeated query keeps its place, its last answer wins."""
    had = parts.where("kind = 'external'").select(
        "repo_id", "id", (F.col("pos") - F.lit(1 << 40)).alias("seq"), F.col("part_id").alias("query"), F.col("content").alias("answer"))
    merged = had.unionByName(answers.select("repo_id", "id", F.col("seq").cast("long"), "query", "answer")).groupBy(
        "repo_id", "id", "query").agg(F.min("seq").alias("_first"), F.max_by("answer", "seq").alias("content"))
    placed = numbered(merged, ["repo_id", "id"], [F.col("_first"), F.col("query")], "pos")
    return parts.where("kind <> 'external'").select(*PART_COLUMNS).unionByName(placed.select(
        "repo_id", "id", F.lit("external").alias("kind"), "pos", F.col("query").alias("part_id"),
        F.lit("answer").alias("type"), "content"))


def truncate_focal(components: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """The component's own code cut to the budget, with its token count."""
    focal = components.select("repo_id", "id", "component_type", truncate_tokens("source_code", max_tokens, tokenizer).alias("focal"))
    return focal.withColumn("focal_tokens", token_count("focal", tokenizer))


# --- rendering --------------------------------------------------------------

def _with_counts(parts: DataFrame) -> DataFrame:
    """Adds the number of parts of each kind to every part of a component."""
    counts = parts.groupBy("repo_id", "id").agg(*[
        F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in RENDER_ORDER],
        F.count_if((F.col("kind") == "class") & (F.col("content") != "")).alias("n_shown"))
    return parts.join(counts, ["repo_id", "id"])


def _piece() -> Column:
    """A part's share of the text: what separates it from the part before, then its block."""
    kind, part = F.col("kind"), F.col("part_id")
    code = F.concat(F.lit("\n" + CODE_OPEN), F.coalesce("content", F.lit("")), F.lit(CODE_CLOSE))
    kind_line = F.concat(F.lit(TYPE_LINE), F.col("type"), code)
    block = (
        F.when(kind == "class", F.concat(F.lit(CODE_OPEN), F.col("content"), F.lit(CODE_CLOSE)))
        .when(kind == "parent", F.concat(F.lit(PARENT_LINE), part, kind_line))
        .when(kind == "dependency", F.concat(F.lit(COMPONENT_LINE), part, kind_line))
        .when(kind == "usage", F.concat(F.lit(SOURCE_LINE), part, F.lit("`"), code))
        .otherwise(F.concat(F.lit(QUERY_LINE), part, F.lit(RESULT_LINE), F.coalesce("content", F.lit("")))))
    before = F.lit(0)
    earlier = F.lit(0)
    for k in RENDER_ORDER:
        count = F.col("n_shown") if k == "class" else F.col(f"n_{k}")
        before = F.when(kind == k, earlier).otherwise(before)
        earlier = earlier + count
    internal = (kind == "dependency") | ((kind == "usage") & (F.col("n_dependency") == 0))
    head = (
        F.when(kind == "class", F.format_string(CLASS_HEAD, last_seg(part)))
        .when(kind == "parent", PARENT_HEAD)
        .when(kind == "dependency", DEPENDENCY_HEAD)
        .when(kind == "usage", USAGE_HEAD)
        .otherwise(EXTERNAL_HEAD))
    opening = F.concat(F.when(before > 0, SECTION_BREAK).otherwise(""), F.when(internal, INTERNAL_HEAD).otherwise(""), head)
    text = F.concat(F.when(F.col("pos") == 1, opening).otherwise(BLOCK_BREAK), block)
    return F.when((kind == "class") & (F.coalesce("content", F.lit("")) == ""), "").otherwise(text)


def _place() -> Column:
    """Position of a part in the whole text, from 1."""
    place, earlier = F.col("pos"), F.lit(0)
    for k in RENDER_ORDER:
        place = F.when(F.col("kind") == k, earlier + F.col("pos")).otherwise(place)
        earlier = earlier + F.col(f"n_{k}")
    return place


def render_context(parts: DataFrame, components: DataFrame, parts_per_row: int = 1000) -> DataFrame:
    """Context text: (repo_id, id, part_no, context).

    A context of more than ``parts_per_row`` parts spans several rows, which put
    together in order are its text.  A component without parts gets the fallback
    sentence.
    """
    pieces = _with_counts(parts).select(
        "repo_id", "id", _place().alias("place"), _piece().alias("piece"))
    no = F.floor((F.col("place") - 1) / parts_per_row).cast("long").alias("part_no")
    ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
    texts = pieces.groupBy("repo_id", "id", no).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("context"))
    shown = components.select("repo_id", "id").join(texts, ["repo_id", "id"], "left")
    text = F.when(F.col("context").isNull() | ((F.col("part_no") == 0) & (F.col("context") == "")), NO_CONTEXT).otherwise(F.col("context"))
    return shown.select("repo_id", "id", F.coalesce("part_no", F.lit(0)).alias("part_no"), text.alias("context"))


# --- budget -----------------------------------------------------------------

def budget_check(contexts: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``contexts(repo_id, id, context, focal)`` -> tokens, ok, overage."""
    total = token_count("context", tokenizer) + token_count("focal", tokenizer)
    return contexts.withColumn("tokens", total).withColumns({
        "ok": F.col("tokens") <= max_tokens, "overage": F.greatest(F.col("tokens") - max_tokens, F.lit(0))})


def _removal_no() -> Column:
    """The step at which a part is given up, 1 = first.  Inside a kind the last goes first."""
    step, earlier = F.lit(0), F.lit(0)
    for k in REMOVAL_ORDER:
        step = F.when(F.col("kind") == k, earlier + F.col(f"n_{k}") - F.col("pos") + 1).otherwise(step)
        earlier = earlier + F.col(f"n_{k}")
    return step


def prune_context(parts: DataFrame, focal: DataFrame, max_tokens: int = MAX_TOKENS, max_steps: int = MAX_REMOVALS,
                  tokenizer: Tokenizer | None = None) -> tuple[DataFrame, DataFrame]:
    """Give up parts one at a time until context and focal code fit.

    ``focal(repo_id, id, focal_tokens)``.  Returns (kept parts, verdict(repo_id,
    id, removed, tokens, ok)).  At most ``max_steps`` parts go; the result may
    still be too large.

    With an additive tokenizer the text's size after k removals is the full size
    minus the sizes of the first k parts to go, so it follows from sums: only
    the first ``max_steps`` removals of a component are ever brought together.
    A codec counts in the tasks, one pass over the components' parts; column
    functions that do not add up are left with rendering in rounds.
    """
    tokenizer = tokenizer or get_tokenizer()
    if not tokenizer.additive and tokenizer.load is not None:
        return _prune_in_tasks(parts, focal, max_tokens, max_steps, tokenizer.load)
    if not tokenizer.additive:
        return _prune_by_rendering(parts, focal, max_tokens, max_steps, tokenizer)
    sized = cut(_with_counts(parts).select(
        *PART_COLUMNS, _removal_no().alias("_no"), tokenizer.count(_piece()).alias("_tokens")))
    key = ["repo_id", "id"]
    totals = focal.select(*key, "focal_tokens").join(
        sized.groupBy(*key).agg(F.sum("_tokens").alias("_all"), F.count(F.lit(1)).alias("_n")), key, "left"
    ).na.fill(0, ["_all", "_n"])
    steps = sized.where(F.col("_no") <= max_steps).select(
        *key, "_no", F.sum("_tokens").over(Window.partitionBy(*key).orderBy("_no")).alias("_gone"))
    start = totals.select(*key, F.lit(0).alias("_no"), F.lit(0).cast("long").alias("_gone"))
    none = tokenizer.count(F.lit(NO_CONTEXT))
    tried = start.unionByName(steps).join(totals, key).withColumn(
        "_tokens", F.col("focal_tokens") + F.when(F.col("_no") == F.col("_n"), none).otherwise(F.col("_all") - F.col("_gone")))
    fits = F.col("_tokens") <= max_tokens
    chosen = tried.groupBy(*key).agg(
        F.min(F.when(fits, F.struct("_no", "_tokens"))).alias("_fit"), F.max(F.struct("_no", "_tokens")).alias("_last"))
    verdict = cut(chosen.select(
        *key, F.coalesce("_fit._no", "_last._no").cast("long").alias("removed"),
        F.coalesce("_fit._tokens", "_last._tokens").alias("tokens"), F.col("_fit").isNotNull().alias("ok")))
    kept = sized.join(verdict.select(*key, "removed"), key).where(F.col("_no") > F.col("removed")).select(*PART_COLUMNS)
    return kept, verdict


def _prune_in_tasks(parts: DataFrame, focal: DataFrame, max_tokens: int, max_steps: int, load: Callable[[], object]) -> tuple[DataFrame, DataFrame]:
    """The same with a codec: each component's pieces in one row, where texts are joined, and counted until one fits.

    A text of more than ``longest`` bytes for each token that is left cannot fit and is not encoded.  What is given up
    first are whole sections from the end or the class; the section that is then the first loses its break.
    """
    key = ["repo_id", "id"]
    ordered = _with_counts(kept(parts)).select(*PART_COLUMNS, _removal_no().alias("_no"), _place().alias("_at"), F.coalesce(_piece(), F.lit("")).alias("_text"))
    # a prompt is one text, so its pieces fit into one row; they are collected where the parts have met their counts
    held = ordered.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_no").cast("long").alias("_no"), "_text"))).alias("pieces"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load()
        longest = getattr(codec, "longest", None)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces, own, result = row["pieces"] or [], row["focal_tokens"], None
                last = min(len(pieces), max_steps)
                for step in range(last + 1):
                    text = "".join(p["_text"] for p in pieces if p["_no"] > step).removeprefix(SECTION_BREAK) or NO_CONTEXT
                    if step < last and longest and len(text.encode()) > longest * max(0, max_tokens - own):
                        continue
                    result = step, own + len(codec.encode(text))
                    if result[1] <= max_tokens:
                        break
                out.append((row["repo_id"], row["id"], *result, result[1] <= max_tokens))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["repo_id", "id", "removed", "tokens", "ok"])

    rows = focal.select(*key, F.col("focal_tokens").cast("long").alias("focal_tokens")).join(held, key, "left")
    verdict = cut(rows.mapInArrow(choose, "repo_id string, id string, removed long, tokens long, ok boolean"))
    left = ordered.join(verdict.select(*key, "removed"), key).where(F.col("_no") > F.col("removed")).select(*PART_COLUMNS)
    return left, verdict


def _prune_by_rendering(parts: DataFrame, focal: DataFrame, max_tokens: int, max_steps: int,
                        tokenizer: Tokenizer) -> tuple[DataFrame, DataFrame]:
    """The same for tokenizers whose counts do not add up: render, count, give up one more part."""
    key = ["repo_id", "id"]
    ordered = cut(_with_counts(parts).select(*PART_COLUMNS, _removal_no().alias("_no")))
    sizes = ordered.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    open_ = cut(focal.select(*key, "focal_tokens").join(sizes, key, "left").na.fill(0, ["_n"]))
    done: DataFrame | None = None
    for step in range(max_steps + 1):
        kept = ordered.join(open_.select(*key), key, "left_semi").where(F.col("_no") > step).select(*PART_COLUMNS)
        texts = render_context(kept, open_, 1 << 30).select(*key, tokenizer.count(F.col("context")).alias("_c"))
        counted = cut(open_.join(texts, key).withColumn("tokens", F.col("focal_tokens") + F.col("_c")))
        fits = F.col("tokens") <= max_tokens
        over = (F.col("_n") <= step) | F.lit(step == max_steps)
        verdict = counted.where(fits | over).select(*key, F.lit(step).cast("long").alias("removed"), "tokens", fits.alias("ok"))
        done = verdict if done is None else done.unionByName(verdict)
        open_ = cut(counted.where(~(fits | over)).select(*key, "focal_tokens", "_n"))
        if not open_.take(1):
            break
    assert done is not None
    kept = ordered.join(done.select(*key, "removed"), key).where(F.col("_no") > F.col("removed")).select(*PART_COLUMNS)
    return kept, done


def assemble(parts: DataFrame, components: DataFrame, max_tokens: int = MAX_TOKENS,
             tokenizer: Tokenizer | None = None) -> DataFrame:
    """Pruned, rendered context with the focal code: (repo_id, id, part_no, context, focal)."""
    focal = truncate_focal(components, max_tokens, tokenizer)
    kept, _ = prune_context(parts, focal, max_tokens, tokenizer=tokenizer)
    return render_context(kept, components).join(
        focal.select("repo_id", "id", "component_type", "focal"), ["repo_id", "id"])
