"""Name resolution: from raw callee names and references to dependency edges.

Tables: ``components(repo_id, id, component_type, relative_path, ...)``,
``calls(repo_id, caller_id, caller_type, raw_callee)``,
``edges(repo_id, src, dst, kind)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import _c, last_seg, normalize_callee, owner_id, short_name
from codeloom.operators.skew import first_containing, first_rows, lookup_join, numbered
from codeloom.session import cut

BUILTIN = "<builtin>"
CONSTRUCTOR = ".__init__"
#: Ids of one ending that a call is compared with where it meets them.
FEW_IDS = 64


def match_callers(components: DataFrame, callgraph: DataFrame) -> DataFrame:
    """Attach raw call graph entries to components.

    The graph writes the module part of a caller as a path and the names behind
    it with dots, so the component's id is rewritten to that form.
    """
    stem = F.regexp_replace("relative_path", r"\.py$", "")
    keyed = components.select(
        "repo_id", F.col("id").alias("caller_id"), F.col("component_type").alias("caller_type"),
        F.replace(F.col("id"), normalize_callee(stem), stem).alias("caller_key"))
    return (
        callgraph.join(keyed, ["repo_id", "caller_key"])
        .select("repo_id", "caller_id", "caller_type", F.col("callee").alias("raw_callee"))
    )


def without_builtins(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("raw_callee").startswith(BUILTIN))


def _scopes(caller_id: Column, caller_type: Column) -> Column:
    """The caller's enclosing module paths, longest first, without the empty one."""
    parts = F.split(caller_id, r"\.")
    depth = F.size(parts) - F.when(caller_type == "method", 2).otherwise(1)
    lengths = F.when(depth >= 1, F.sequence(depth, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def callee_candidates(raw: Column | str, caller_id: Column | str, caller_type: Column | str,
                      root: Column | str | None = None) -> Column:
    """Ids a callee may stand for, in the order they are tried.

    The name itself, the name without the repository's own top name, then the
    name inside each enclosing module of the caller, innermost first.
    """
    name, stripped = _plain_names(raw, root)
    return F.concat(
        F.array(name, stripped),
        F.transform(_scopes(_c(caller_id), _c(caller_type)), lambda scope: F.concat_ws(".", scope, name)))


def _plain_names(raw: Column | str, root: Column | str | None) -> tuple[Column, Column]:
    """The name itself, and without the repository's own top name (null if it does not begin with it)."""
    name = normalize_callee(raw)
    top = F.lit("") if root is None else (F.lit(root) if isinstance(root, str) else root)
    return name, F.when(
        (top != "") & F.startswith(name, F.concat(top, F.lit("."))),
        F.substring(name, F.length(top) + 2, F.length(name)))


def resolve_callees(calls: DataFrame, components: DataFrame, root: Column | str | None = None) -> DataFrame:
    """First existing candidate per call.

    Adds ``callee_id`` (null when no candidate exists), ``step`` (0 exact, 1 top
    name removed, 2 enclosing scope or none) and ``constructs`` (the callee is
    the constructor of a class among the components).  All candidates of a
    call end in the same one or two names, so a call travels once, to the ids
    with that ending.  Where these are more than ``FEW_IDS`` its candidates are
    exploded and met with them in an equi join.
    """
    key = ["repo_id", "caller_id", "caller_type", "raw_callee"]
    dots = F.length("caller_id") - F.length(F.replace("caller_id", F.lit(".")))
    depth = F.greatest(dots - F.when(F.col("caller_type") == "method", 1).otherwise(0), F.lit(0))
    positions = F.sequence(F.lit(0), depth + 1)
    index = _by_ending(components)
    held = cut(first_rows(index, ["repo_id", "_end"], [F.col("id")], FEW_IDS + 1, "_n").groupBy("repo_id", "_end").agg(
        F.collect_list(F.struct("id", "_owned")).alias("_ids"))
        .select("repo_id", "_end", F.when(F.size("_ids") <= FEW_IDS, F.col("_ids")).alias("_ids"), (F.size("_ids") > FEW_IDS).alias("_many")))
    name, stripped = _plain_names("raw_callee", root)
    met = (
        without_builtins(calls).select(*key, _ending(F.coalesce(stripped, name), -2).alias("_end"))
        .join(held, ["repo_id", "_end"], "left")
    )
    tried = F.transform(positions, lambda p: F.struct(p.alias("pos"), _candidate(p, depth, root).alias("id")))
    hit = F.get(F.filter(tried, lambda c: F.exists("_ids", lambda i: i["id"] == c["id"])), F.lit(0))
    owned = F.exists("_ids", lambda i: (i["id"] == F.col("_hit.id")) & i["_owned"])
    # equal calls meet with their ids, so nothing travels again to tell them apart
    found = cut(
        met.withColumn("_hit", F.when(F.col("_ids").isNotNull(), hit))
        .select(*key, "_end", F.col("_hit.pos").alias("_pos"), F.coalesce(owned, F.lit(False)).alias("_owned"), F.coalesce("_many", F.lit(False)).alias("_many"))
        .distinct().drop("_end"))
    rest = found.where("_many")
    if held.where("_many").take(1) and rest.take(1):
        many = index.join(held.where("_many").select("repo_id", "_end"), ["repo_id", "_end"], "left_semi").select("repo_id", "id", "_owned").distinct()
        each = rest.select(*key, F.explode(positions).alias("_pos")).withColumn("id", _candidate(F.col("_pos"), depth, root)).where(F.col("id").isNotNull())
        hits = each.join(many.withColumn("_known", F.lit(True)), ["repo_id", "id"], "left")
        best = hits.groupBy(*key).agg(F.min(F.when(F.col("_known"), F.struct("_pos", "_owned"))).alias("_hit"))
        looked = best.select(*key, F.col("_hit._pos").alias("_pos"), F.coalesce("_hit._owned", F.lit(False)).alias("_owned"))
        found = found.where("NOT _many").drop("_many").unionByName(looked)
    return found.select(
        *key,
        F.when(F.col("_pos").isNotNull(), _candidate(F.col("_pos"), depth, root)).alias("callee_id"),
        F.least(F.col("_pos"), F.lit(2)).cast("long").alias("step"),
        F.col("_owned").alias("constructs"),
    )


def _ending(name: Column | str, n: int) -> Column:
    """A number for the last names of a dotted name.  Ids that share it by chance only lie in one list: ids themselves are compared."""
    return F.hash(F.substring_index(_c(name), ".", n))


def _by_ending(components: DataFrame) -> DataFrame:
    """Every id under its last name and its last two, ``(repo_id, _end, id, _owned)``; ``_owned``: the constructor of a class."""
    no, yes = F.lit(False), F.lit(True)
    names = components.select("repo_id", "component_type", F.explode(F.array(
        F.struct("id", yes.alias("known"), no.alias("owned")),
        F.when(F.col("component_type") == "class", F.struct(F.concat("id", F.lit(CONSTRUCTOR)).alias("id"), no.alias("known"), yes.alias("owned"))))).alias("_c"))
    ids = (
        names.where("repo_id IS NOT NULL AND _c.id IS NOT NULL").groupBy("repo_id", F.col("_c.id").alias("id"))
        .agg(F.max("_c.known").alias("_known"), F.max("_c.owned").alias("_owned")).where("_known")
    )
    ends = F.array_distinct(F.array(*[_ending("id", n) for n in (-2, -1)]))
    return ids.select("repo_id", F.explode(ends).alias("_end"), "id", "_owned")


def _candidate(pos: Column, depth: Column, root: Column | str | None) -> Column:
    """Item ``pos`` of ``callee_candidates``, the array itself not being made."""
    name, stripped = _plain_names("raw_callee", root)
    scope = F.call_function("substring_index", F.col("caller_id"), F.lit("."), (depth + 2 - pos).cast("int"))
    return F.when(pos == 0, name).when(pos == 1, stripped).otherwise(F.concat_ws(".", scope, name))


def _known(components: DataFrame) -> DataFrame:
    return components.select("repo_id", "id").distinct().withColumn("_known", F.lit(True))


def call_edges(resolved: DataFrame, components: DataFrame, distinct: bool = True) -> DataFrame:
    """Resolved calls as edges: constructors collapsed, self edges and unknown targets dropped.

    ``resolved`` may say whether a callee ``constructs``, as ``resolve_callees``
    does; else the classes are looked up.  An edge may come several times
    without ``distinct``.
    """
    hits = resolved.where(F.col("callee_id").isNotNull() & (F.col("callee_id") != F.col("caller_id")))
    if "constructs" in resolved.columns:
        edges = hits.select("repo_id", F.col("caller_id").alias("src"), F.when(F.col("constructs"), owner_id("callee_id")).otherwise(F.col("callee_id")).alias("dst"))
    else:
        edges = collapse_init(hits.select("repo_id", F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), components)
    return (edges.distinct() if distinct else edges).withColumn("kind", F.lit("calls"))


def collapse_init(edges: DataFrame, components: DataFrame) -> DataFrame:
    """An edge to ``C.__init__`` becomes an edge to the class ``C`` if there is one.

    A class whose own ``__init__`` is called from inside keeps the edge to itself
    (the self test happens before the collapse)."""
    classes = (
        components.where(F.col("component_type") == "class")
        .select("repo_id", F.col("id").alias("_class")).distinct()
    )
    target = F.when(F.col("dst").endswith(CONSTRUCTOR), owner_id("dst"))
    return (
        edges.withColumn("_class", target)
        .join(classes.withColumn("_is_class", F.lit(True)), ["repo_id", "_class"], "left")
        .withColumn("dst", F.when(F.col("_is_class"), F.col("_class")).otherwise(F.col("dst")))
        .select(*edges.columns)
    )


def restrict_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between different nodes whose target is a component."""
    ids = components.select("repo_id", F.col("id").alias("dst")).distinct()
    return edges.where(F.col("src") != F.col("dst")).join(ids, ["repo_id", "dst"], "left_semi").select(*edges.columns)


def class_method_edges(components: DataFrame) -> DataFrame:
    """A class depends on its methods, the constructor excepted."""
    methods = components.where((F.col("component_type") == "method") & (last_seg("id") != "__init__")).select(
        "repo_id", owner_id("id").alias("src"), F.col("id").alias("dst"))
    classes = components.where(F.col("component_type") == "class").select("repo_id", F.col("id").alias("src")).distinct()
    return methods.join(classes, ["repo_id", "src"], "left_semi").withColumn("kind", F.lit("member"))


def all_edges(*edge_tables: DataFrame) -> DataFrame:
    """Distinct union; ``kinds`` lists (in order) why the edge exists."""
    cols = ["repo_id", "src", "dst", "kind"]
    union = edge_tables[0].select(*cols)
    for other in edge_tables[1:]:
        union = union.unionByName(other.select(*cols))
    return union.groupBy("repo_id", "src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def used_by(edges: DataFrame) -> DataFrame:
    """The reverse index, one row per (component, user)."""
    return edges.select("repo_id", F.col("dst").alias("id"), F.col("src").alias("used_by")).distinct()


def used_by_lists(edges: DataFrame, size: int = 10_000) -> DataFrame:
    """The reverse index as sorted lists of at most ``size`` users.

    A component with more users gets several rows (``part`` 0, 1, ...); together
    they hold all of them, and no task ever builds a longer list.
    """
    placed = numbered(used_by(edges), ["repo_id", "id"], [F.col("used_by")], "_n")
    return placed.groupBy("repo_id", "id", _part(size)).agg(F.array_sort(F.collect_list("used_by")).alias("used_by"))


def _part(size: int) -> Column:
    return F.floor((F.col("_n") - 1) / size).cast("long").alias("part")


def with_dependency_lists(components: DataFrame, edges: DataFrame, size: int = 10_000) -> DataFrame:
    """Component rows with their ``depends_on`` and ``used_by`` lists (export form).

    A component with more than ``size`` of either comes in several rows (``part``
    0, 1, ...); together they hold all of them.
    """
    key = ["repo_id", "id", "part"]
    edges = cut(edges.select("repo_id", "src", "dst").distinct())  # once for both directions
    up = used_by_lists(edges, size)
    flipped = edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    down = used_by_lists(flipped, size).withColumnRenamed("used_by", "depends_on")
    none = F.array().cast("array<string>")
    lists = down.join(up, key, "full")
    return (
        components.join(lists, ["repo_id", "id"], "left")
        .withColumns({c: F.coalesce(F.col(c), none) for c in ("depends_on", "used_by")})
        .withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    )


# --- references by import ---------------------------------------------------

def name_prefixes(name: Column) -> Column:
    """All dotted prefixes of a name as (number of parts, prefix)."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        n.alias("parts"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("prefix")))


def expand_wildcards(imports: DataFrame, components: DataFrame) -> DataFrame:
    """``from m import *``: the public classes and functions of module ``m``.

    With ``target_file`` (the file an import leads to, as the symbol table has it)
    the module is met by its file, so that relative imports count as well;
    without it by its written name.
    """
    by_file = "target_file" in imports.columns
    star = imports.where("is_wildcard")
    public = (
        components.where(F.col("component_type").isin("class", "function"))
        .select("repo_id", F.col("relative_path").alias("target_file"), owner_id("id").alias("module"), last_seg("id").alias("visible_name"))
        .where(~F.col("visible_name").startswith("_"))
        # a package file exports under the package's name
        .withColumn("module", F.regexp_replace("module", r"\.__init__$", ""))
        .distinct()
    )
    if by_file:
        met = star.select("repo_id", "file_path", "seq", "target_file").join(public, ["repo_id", "target_file"])
    else:
        met = star.select("repo_id", "file_path", "seq", "module").join(public.drop("target_file").distinct(), ["repo_id", "module"])
    return met.select("repo_id", "file_path", "seq", "visible_name", F.concat_ws(".", "module", "visible_name").alias("target"))


def import_targets(imports: DataFrame) -> DataFrame:
    """Visible name -> dotted target, for named imports that state their module."""
    named = imports.where(~F.col("is_wildcard") & F.col("module").isNotNull())
    target = F.when(F.col("is_from"), F.concat_ws(".", "module", "original_name")).otherwise(F.col("original_name"))
    return named.select("repo_id", "file_path", "seq", "visible_name", target.alias("target"))


def qualify_refs(refs: DataFrame, imports: DataFrame, components: DataFrame) -> DataFrame:
    """Dotted meaning of each reference.

    ``refs(repo_id, file_path, module_path, component_id, name)``.  The longest
    imported prefix is replaced by its target; an explicit import wins over a
    wildcard one, a later import over an earlier one.  Without a match the name
    belongs to the current module.
    """
    targets = import_targets(imports).withColumn("_explicit", F.lit(1)).unionByName(
        expand_wildcards(imports, components).withColumn("_explicit", F.lit(0)))
    latest = targets.groupBy("repo_id", "file_path", "visible_name").agg(
        F.max(F.struct("_explicit", "seq", "target")).alias("_t"))
    key = ["repo_id", "file_path", "module_path", "name"]
    names = refs.select(*key).distinct()  # one lookup per file and name, however often it is used
    tried = names.select(*key, F.explode(name_prefixes(F.col("name"))).alias("_p")).select(
        *key, F.col("_p.parts").alias("_n"), F.col("_p.prefix").alias("visible_name"))
    found = (
        tried.join(latest, ["repo_id", "file_path", "visible_name"])
        .groupBy(*key).agg(F.max(F.struct(F.col("_n"), F.col("_t.target").alias("target"))).alias("_best"))
    )
    parts = F.split("name", r"\.")
    rest = F.slice(parts, F.col("_best._n") + 1, F.size(parts))
    qualified = F.when(F.col("_best").isNull(), F.concat_ws(".", "module_path", "name")).otherwise(
        F.concat_ws(".", F.col("_best.target"), F.array_join(rest, ".")))
    resolved = names.join(found, key, "left").select(
        *key, F.regexp_replace(qualified, r"\.$", "").alias("qualified_name"))
    return refs.join(resolved, key)


def filter_known(refs: DataFrame, components: DataFrame, modules: DataFrame) -> DataFrame:
    """References that are components, or whose first segment is a known module."""
    ids = _known(components).withColumnRenamed("id", "name").withColumnRenamed("_known", "_is_id")
    tops = modules.select("repo_id", F.col("module").alias("_top")).distinct().withColumn("_is_top", F.lit(True))
    tagged = refs.withColumn("_top", F.substring_index("name", ".", 1))
    return (
        lookup_join(tagged.join(ids, ["repo_id", "name"], "left"), tops, ["repo_id", "_top"], "left")
        .where(F.col("_is_id") | F.col("_is_top"))
        .select(*refs.columns)
    )


def resolve_by_short_name(unresolved: DataFrame, components: DataFrame) -> DataFrame:
    """Second strategy: look the last one or two segments up among the short names.

    Two segments are tried before one, except for a doubled name (``x.x``) whose
    last segment is unique on its own.  A component is accepted if the leading
    part of the callee occurs in its id; of several the smallest id is taken.
    """
    key = ["repo_id", "caller_id", "raw_callee"]
    parts = F.split(normalize_callee("raw_callee"), r"\.")
    n = F.size(parts)
    named = unresolved.select(*key).distinct().withColumns({"_parts": parts, "_size": n}).where("_size >= 2")
    tail = lambda k: F.array_join(F.slice(F.col("_parts"), F.col("_size") - k + 1, F.lit(k)), ".")
    head = lambda k: F.array_join(F.slice(F.col("_parts"), F.lit(1), F.col("_size") - k), ".")
    index = components.select("repo_id", "id", short_name("id", "component_type").alias("short"))
    counts = index.groupBy("repo_id", "short").agg(F.count(F.lit(1)).alias("_count"))
    two = counts.select("repo_id", F.col("short").alias("_two"), F.col("_count").alias("_n2"))
    one = counts.select("repo_id", F.col("short").alias("_one"), F.col("_count").alias("_n1"))
    looked = (
        named.withColumns({"_two": F.when(F.col("_size") > 2, tail(2)), "_one": tail(1)})
        .join(two, ["repo_id", "_two"], "left").join(one, ["repo_id", "_one"], "left")
    )
    doubled = (F.get("_parts", F.col("_size") - 2) == F.get("_parts", F.col("_size") - 3)) & (F.col("_n1") == 1)
    use_two = F.col("_n2").isNotNull() & ~F.coalesce(doubled, F.lit(False))
    picked = looked.select(
        *key,
        F.when(use_two, F.col("_two")).when(F.col("_n1").isNotNull(), F.col("_one")).alias("short"),
        F.when(use_two, head(2)).otherwise(head(1)).alias("prefix"),
    ).where(F.col("short").isNotNull())
    best = first_containing(picked, index, ["repo_id", "short"], "prefix", "id", "callee_id")
    return picked.join(best, ["repo_id", "short", "prefix"]).select(*key, "callee_id")


def module_files(imports: DataFrame, files: DataFrame, root: str = "", root_name: str = "") -> DataFrame:
    """The file an import refers to (``target_file``), null if the corpus has none.

    Absolute names start at ``root`` (a folder of the repository, ``root_name``
    being the name it is imported by); relative ones climb from the importing
    file.  ``name.py`` is preferred over ``name/__init__.py``.
    """
    parts = F.split("module", r"\.")
    absolute = F.array_join(F.concat(
        F.array(F.lit(root)) if root else F.array().cast("array<string>"),
        F.when(F.get(parts, F.lit(0)) == root_name, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)), "/")
    folders = F.split("file_path", "/")
    up = F.size(folders) - F.col("level").cast("int")
    package = F.when(up >= 0, F.slice(folders, F.lit(1), F.greatest(up, F.lit(0))))
    relative = F.array_join(F.concat(package, F.coalesce(parts, F.array().cast("array<string>"))), "/")
    base = F.when(F.col("level") == 0, F.when(F.col("module") != "", absolute)).otherwise(relative)
    located = imports.withColumn("_base", base)
    wanted = located.select("repo_id", "_base").where(F.col("_base").isNotNull()).distinct()
    as_file = F.when(F.col("_base") != "", F.concat("_base", F.lit(".py")))
    as_package = F.when(F.col("_base") == "", "__init__.py").otherwise(F.concat("_base", F.lit("/__init__.py")))
    names = files.select("repo_id", F.col("relative_path").alias("_file")).distinct()
    found = (
        wanted.select("repo_id", "_base", F.posexplode(F.array(as_file, as_package)).alias("_pos", "_file"))
        .join(names, ["repo_id", "_file"], "left_semi")
        .groupBy("repo_id", "_base").agg(F.min("_pos").alias("_pos"))
        .select("repo_id", "_base", F.when(F.col("_pos") == 0, as_file).otherwise(as_package).alias("target_file"))
    )
    return located.join(found, ["repo_id", "_base"], "left").drop("_base")


# --- strategies -------------------------------------------------------------

Strategy = Callable[..., DataFrame]
_STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, fn: Strategy) -> None:
    _STRATEGIES[name] = fn


def resolve(calls: DataFrame, components: DataFrame, strategy: str = "main-alternatif", **options) -> DataFrame:
    """Call edges by a registered strategy; an unknown name is an error."""
    if strategy not in _STRATEGIES:
        raise ValueError(f"unknown resolver strategy {strategy!r}, known: {sorted(_STRATEGIES)}")
    return _STRATEGIES[strategy](calls, components, **options)


def _main(calls: DataFrame, components: DataFrame, root: Column | str | None = None,
          fallback: Callable[[DataFrame], DataFrame] | None = None, distinct: bool = True) -> DataFrame:
    """Candidates first; ``fallback`` maps unresolved calls to (call key, callee_id)."""
    resolved = resolve_callees(calls, components, root)
    hits = resolved.where(F.col("callee_id").isNotNull())
    if fallback is None:
        return call_edges(hits, components, distinct)
    missing = resolved.where(F.col("callee_id").isNull()).drop("constructs")
    named = hits.select("repo_id", "caller_id", "callee_id").unionByName(fallback(missing).select("repo_id", "caller_id", "callee_id"))
    return call_edges(named, components, distinct)


def _second(calls: DataFrame, components: DataFrame, root: Column | str | None = None) -> DataFrame:
    """Candidates first, then short names; constructors stay as they are."""
    resolved = resolve_callees(calls, components, root)
    missing = resolved.where(F.col("callee_id").isNull())
    hits = resolved.where(F.col("callee_id").isNotNull()).select("repo_id", "caller_id", "callee_id").unionByName(
        resolve_by_short_name(missing, components).select("repo_id", "caller_id", "callee_id"))
    raw = hits.select("repo_id", F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    return restrict_edges(raw, components).distinct().withColumn("kind", F.lit("calls"))


register_strategy("main-alternatif", _main)
register_strategy("second-alternatif", _second)


def parents_of(edges: DataFrame) -> DataFrame:
    """(child, parent) pairs among typed edges."""
    return edges.where(F.col("kind") == "inherits").select(
        "repo_id", F.col("src").alias("id"), F.col("dst").alias("parent_id")).distinct()

