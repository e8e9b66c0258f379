"""Facts about Python sources.

Every file is parsed once, in the task that holds it; parsing emits flat fact
rows and nothing else.  What the rows mean (which duplicate counts, which names
are ignored, which sections follow) is decided by the relational views below.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.exprs import last_seg, line_slice, owner_id
from codeloom.operators.skew import first_rows

# --- fixed values: names that never count as references -----------------------
STANDARD_MODULES = [
    "abc", "argparse", "array", "asyncio", "base64", "collections", "copy", "csv", "datetime", "enum",
    "functools", "glob", "io", "itertools", "json", "logging", "math", "os", "pathlib", "random", "re",
    "shutil", "string", "sys", "time", "typing", "uuid", "warnings", "xml",
]
EXCLUDED_NAMES = ["self", "cls"]
# ----------------------------------------------------------------------------

# One row per fact.  ``seq`` is the number of the definition (or import) inside its file, ``stmt``
# the top-level statement it belongs to.  The other columns are used as each fact needs them.
FACT_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()), T.StructField("file_path", T.StringType()),
    T.StructField("fact", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("stmt", T.LongType()),
    T.StructField("owner", T.StringType()), T.StructField("name", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("extra", T.StringType()), T.StructField("source", T.StringType()), T.StructField("a", T.LongType()),
    T.StructField("b", T.LongType()), T.StructField("c", T.LongType()), T.StructField("flag", T.BooleanType()),
])
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST, partial: bool = False) -> str | None:
    """``a.b.c`` of a name or attribute chain; with ``partial`` the attributes of any other base."""
    attrs: list[str] = []
    while isinstance(node, ast.Attribute):
        attrs.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        attrs.append(node.id)
    elif not partial:
        return None
    return ".".join(reversed(attrs))


def _first_line(node) -> int:
    return node.decorator_list[0].lineno if node.decorator_list else node.lineno


def _text(node: ast.AST | None) -> str | None:
    """The text of an expression; the plainest are written here, since an unparser costs more than all else about them."""
    if node is None:
        return None
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if kind is ast.Constant and type(node.value) in _PLAIN and not node.kind:
        return repr(node.value)
    if kind is ast.Attribute and (name := _dotted(node)):
        return name
    if kind is ast.Call and not node.keywords and type(node.func) is ast.Name and all(type(a) is ast.Name for a in node.args):
        return f"{node.func.id}({', '.join([a.id for a in node.args])})"
    return ast.unparse(node)


_PLAIN = {str, int, bool, type(None)}


def _listed(node) -> list[tuple]:
    """Parameters as (kind, name, annotation, default), positional ones first."""
    args = node.args
    ordinary = args.posonlyargs + args.args
    defaults = dict(zip(reversed(ordinary), reversed(args.defaults))) | dict(zip(args.kwonlyargs, args.kw_defaults))
    kinds = [("positional_only", args.posonlyargs), ("positional", args.args), ("keyword_only", args.kwonlyargs),
             ("vararg", [args.vararg]), ("kwarg", [args.kwarg])]
    return [(kind, arg.arg, _text(arg.annotation), _text(defaults.get(arg))) for kind, group in kinds for arg in group if arg]


def _arguments(listed: list[tuple]) -> str:
    """Parameters as they are written between the brackets."""
    parts: dict[str, list[str]] = {"positional_only": [], "positional": [], "vararg": [], "keyword_only": [], "kwarg": []}
    stars = {"vararg": "*", "kwarg": "**"}
    for kind, name, annotation, default in listed:
        typed = name if annotation is None else f"{name}: {annotation}"
        parts[kind].append(stars.get(kind, "") + (typed if default is None else f"{typed}={default}"))
    slash = ["/"] if parts["positional_only"] else []
    star = ["*"] if parts["keyword_only"] and not parts["vararg"] else []
    return ", ".join(parts["positional_only"] + slash + parts["positional"] + parts["vararg"] + star + parts["keyword_only"] + parts["kwarg"])


def _signature(node, listed: list[tuple] | None) -> str:
    generic = ", ".join(map(_text, getattr(node, "type_params", None) or []))
    name = f"{node.name}[{generic}]" if generic else node.name
    if listed is None:
        inside = ", ".join(map(_text, [*node.bases, *node.keywords]))
        return f"class {name}({inside}):" if inside else f"class {name}:"
    arrow = f" -> {_text(node.returns)}" if node.returns else ""
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{word} {name}({_arguments(listed)}){arrow}:"


def _is_self(target: ast.AST) -> bool:
    return isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self"


def _targets(node: ast.AST) -> list[ast.AST]:
    return node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []


# the parts of each kind of node in which statements stand (an expression holds none), and those that hold nodes at all
_BLOCKS = {kind: tuple(f for f in kind._fields if f in ("body", "orelse", "finalbody", "handlers", "cases"))
           for kind in [*ast.stmt.__subclasses__(), ast.ExceptHandler, ast.match_case]}
_BLOCKS = {kind: fields for kind, fields in _BLOCKS.items() if fields}
_SCALARS = {"ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "names", "module", "level", "is_async"}
_INSIDE = {kind: tuple(f for f in kind._fields if f not in _SCALARS and (f != "name" or kind is getattr(ast, "TypeAlias", None)))
           for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)}


def _below(node: ast.AST) -> list[ast.AST]:
    """The statements (and handlers and cases, which hold them) directly below a statement, in the order of ``ast.walk``."""
    return [sub for field in _BLOCKS.get(type(node), ()) for sub in getattr(node, field)]


def _attributes(body: list, nested: bool = False) -> Iterator[tuple]:
    """(name, origin, is_direct) below a class body; plain methods are only entered to read the constructor."""
    for node in body:
        if isinstance(node, ast.FunctionDef):
            if any(isinstance(d, ast.Name) and d.id == "property" for d in node.decorator_list):
                yield node.name, "property", True
            if node.name == "__init__":
                for stmt in node.body:
                    todo = [stmt]
                    while todo:
                        sub = todo.pop()
                        todo += _below(sub)
                        for t in filter(_is_self, _targets(sub)):
                            yield t.attr, "nested" if nested else "init", sub is stmt
            continue
        for t in _targets(node):
            if isinstance(t, ast.Name) or isinstance(node, ast.Assign):
                yield _text(t), "nested" if nested else "class_level", isinstance(t, ast.Name)
        yield from _attributes(_below(node), nested or isinstance(node, ast.ClassDef))


class _Unit:
    """A component's node, the names below it and what its body does."""

    __slots__ = ("node", "kind", "cid", "names", "does", "_listed")

    def __init__(self, node, kind: str, cid: str):
        self.node, self.kind, self.cid = node, kind, cid
        self.names: set[str] | None = None
        self.does: set[tuple[str, str]] = set()
        self._listed: list[tuple] | None = None

    def listed(self) -> list[tuple]:
        if self._listed is None:
            self._listed = _listed(self.node)
        return self._listed


def _read(todo: list, names: set, does: set, units: dict[int, _Unit]) -> None:
    """Add the names below some nodes and what they do.

    Every node is visited once: a component within another hands what it has found on to it.  What stands in the head of
    a component (decorators, parameters, bases) is done by what is around it.
    """
    while todo:
        node = todo.pop()
        kind = type(node)
        if kind is ast.Name:
            names.add(node.id)
            continue
        if kind is ast.Constant:
            continue
        if kind is ast.Attribute:
            names.add(_dotted(node, True))
            todo.append(node.value)
            continue
        if kind is ast.Call:
            func = node.func
            plain = type(func) is ast.Name
            if (plain and func.id == "warn") or (not plain and _dotted(func) == "warnings.warn"):
                if not plain:
                    does.add(("does", "has_warn"))
                does.update([("contains", _text(arg)) for arg in node.args])
        elif kind is ast.Return:
            if node.value is not None:
                does.add(("does", "returns_value"))
        elif kind is ast.Raise:
            does.add(("does", "has_raise"))
            named = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
            if isinstance(named, ast.Name):
                does.add(("raise", named.id))
            if node.exc is not None:
                does.add(("contains", _text(node.exc)))
        elif kind is ast.Yield or kind is ast.YieldFrom:
            does.add(("does", "has_yield"))
        elif (unit := units.get(id(node))) is not None:
            unit.names = set()
            around: list = []
            for field in _INSIDE[kind]:
                if field != "body":
                    value = getattr(node, field, None)
                    around += value if type(value) is list else [value]
            _read(around, unit.names, does, units)
            _read(list(node.body), unit.names, unit.does, units)
            names |= unit.names
            does |= unit.does
            continue
        for field in _INSIDE.get(kind, ()):
            value = getattr(node, field, None)
            if type(value) is list:
                if value:
                    todo += value
            elif value is not None:
                todo.append(value)


def _definition(out: list[tuple], seq: int, stmt: int | None, unit: _Unit, units: dict[int, _Unit], lines: list[str]) -> None:
    """Add all facts of one component."""
    node, kind, cid = unit.node, unit.kind, unit.cid
    start, end = _first_line(node), node.end_lineno
    head = node.body[0]
    doc = head.value.value if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) else None
    has_doc = isinstance(doc, str)
    text = _signature(node, None if kind == "class" else unit.listed())
    out.append(("component", seq, stmt, cid, kind, text, doc if has_doc else "", "\n".join(lines[start - 1:end]), start, end, end, has_doc))
    signature = unit
    if kind == "class":
        for at, base in enumerate(node.bases):
            if name := _dotted(base):
                out.append(("base", seq, stmt, cid, name, None, node.name, None, at, None, None, None))
        out += [("attribute", seq, stmt, cid, name, None, origin, None, None, None, None, direct) for name, origin, direct in _attributes(node.body)]
        signature = next((units[id(m)] for m in node.body if isinstance(m, ast.FunctionDef) and m.name == "__init__"), None)
    if signature is not None:
        out += [("param", seq, stmt, cid, name, annotation, default, where, at, None, None, None)
                for at, (where, name, annotation, default) in enumerate(signature.listed())]
    returns = None if signature is None else _text(getattr(signature.node, "returns", None))
    out.append(("body", seq, stmt, cid, None, returns, None, None, end - node.lineno + 1, None, None, None))
    does = {d for d in unit.does if d[0] != "contains"} if kind == "class" else set(unit.does)
    for dec in node.decorator_list:
        named = dec.func if isinstance(dec, ast.Call) else dec
        if getattr(named, "id", getattr(named, "attr", None)) == "abstractmethod":
            does.add(("does", "is_abstract"))
    returns = getattr(node, "returns", None)
    if returns is not None and not (isinstance(returns, ast.Constant) and returns.value is None):
        does.add(("does", "has_return_annotation"))
    out += [(fact, seq, stmt, cid, name, None, None, None, None, None, None, None) for fact, name in sorted(does)]
    for at, dec in enumerate(node.decorator_list):
        out.append(("decorator", seq, stmt, cid, _text(dec.func if isinstance(dec, ast.Call) else dec), None, None, None, at, None, None, None))
    out += [("ref", seq, stmt, cid, name, None, None, None, None, None, None, None) for name in sorted(unit.names)]


def _file_facts(module: str, source: str) -> list[tuple]:
    """Facts of a file in the order of ``_COLUMNS``."""
    tree = ast.parse(source)
    lines, seq = source.splitlines(), 0
    out: list[tuple] = []
    top = {id(node): at for at, node in enumerate(tree.body)}
    units: dict[int, _Unit] = {}
    numbered: list[tuple[int, int | None, _Unit]] = []
    level = tree.body
    while level:
        below: list[ast.AST] = []
        for node in level:
            kind = type(node)
            if kind is ast.Import or kind is ast.ImportFrom:
                is_from = kind is ast.ImportFrom
                for at, alias in enumerate(node.names):
                    seq += 1
                    out.append(("import", seq, top.get(id(node)), None, alias.asname or alias.name, node.module if is_from else alias.name, alias.name,
                                "from" if is_from else "import", at, node.level if is_from else 0, int(alias.asname is not None), alias.name == "*"))
                continue
            if kind is ast.ClassDef or kind in _FUNCS:
                stmt = top.get(id(node))
                out.append(("span", None, None, None, None, None, None, None, _first_line(node), node.end_lineno, None, None))
                wanted = []
                if kind is ast.ClassDef:
                    cid = f"{module}.{node.name}"
                    wanted = [(node, "class", cid)] + [(m, "method", f"{cid}.{m.name}") for m in node.body if type(m) in _FUNCS]
                elif stmt is not None:
                    wanted = [(node, "function", f"{module}.{node.name}")]
                for item in wanted:
                    seq += 1
                    units[id(item[0])] = unit = _Unit(*item)
                    numbered.append((seq, stmt, unit))
            if kind in _BLOCKS:
                below += _below(node)
        level = below
    for seq, stmt, unit in numbered:
        if unit.names is None:
            _read([unit.node], set(), set(), units)
        _definition(out, seq, stmt, unit, units, lines)
    for stmt, node in enumerate(tree.body):
        if isinstance(node, (ast.ClassDef, *_FUNCS)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append(("definition", None, stmt, None, node.name, None, kind, None, None, None, None, None))
        for t in _targets(node):
            if isinstance(t, ast.Name):
                out.append(("definition", None, stmt, None, t.id, None, "variable", None, None, None, None, None))
    return out


_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()])
                    for f in FACT_SCHEMA])
_COLUMNS = _ARROW.names[2:]  # as _file_facts lists them: what is left after repo_id and file_path


def _batch(rows: list[tuple], owners: list[tuple[str, str, int]]) -> pa.RecordBatch:
    """Fact rows of some files as a batch; ``owners`` are (repo_id, file_path, number of rows) of the files."""
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=_ARROW)
    of = np.repeat(np.arange(len(owners)), [n for _, _, n in owners])
    columns = [pa.array([o[i] for o in owners], pa.string()).take(pa.array(of)) for i in (0, 1)]
    columns += [pa.array(values, _ARROW.field(name).type) for name, values in zip(_COLUMNS, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        owners: list[tuple[str, str, int]] = []
        for repo, path, module, source in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "relative_path", "module_path", "source")), strict=True):
            try:
                if source is None:
                    raise ValueError("not valid UTF-8")
                found = _file_facts(module, source)
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                found = [("error", None, None, None, None, f"{type(e).__name__}: {e}", None, None, None, None, None, None)]
            rows += found
            owners.append((repo, path, len(found)))
            if len(rows) > 20_000:
                yield _batch(rows, owners)
                rows, owners = [], []
        yield _batch(rows, owners)


def extract_facts(files: DataFrame) -> DataFrame:
    """``files(repo_id, relative_path, module_path, source)`` -> fact rows.

    Parsing costs far more than moving a source, and a table of many small files
    often sits in few partitions: the files are dealt out evenly first.
    """
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("repo_id", "relative_path", "module_path", "source").repartition(width, "repo_id", "relative_path")
    return dealt.mapInArrow(_parse, FACT_SCHEMA)


# --- views of the facts -----------------------------------------------------

def _of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("fact").isin(*kinds))


def extract_components(facts: DataFrame) -> DataFrame:
    """One row per id; of several definitions the last in source order counts."""
    named = _of(facts, "component").select(
        "repo_id", F.col("owner").alias("id"), F.col("name").alias("component_type"), F.col("file_path"),
        F.col("file_path").alias("relative_path"), F.col("text").alias("signature"), F.col("a").alias("start_line"),
        F.col("b").alias("end_line"), F.col("c").alias("header_end_line"), F.col("flag").alias("has_docstring"),
        F.col("extra").alias("docstring"), F.col("source").alias("source_code"), "seq")
    return first_rows(named, ["repo_id", "id"], [F.col("file_path").desc(), F.col("seq").desc()], 1, "_n").drop("_n")


def of_winners(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Only the facts of definitions that count (not of ones a later definition replaces)."""
    win = components.select("repo_id", "file_path", F.col("id").alias("component_id"), "seq")
    return rows.join(win, ["repo_id", "file_path", "component_id", "seq"], "left_semi")


def _owned(facts: DataFrame, *kinds: str) -> DataFrame:
    return _of(facts, *kinds).withColumnRenamed("owner", "component_id")


def extract_imports(facts: DataFrame) -> DataFrame:
    return _of(facts, "import").select(
        "repo_id", "file_path", "seq", "stmt", F.col("a").alias("alias_pos"), F.col("name").alias("visible_name"),
        F.col("text").alias("module"), F.col("extra").alias("original_name"), F.col("b").alias("level"),
        F.col("flag").alias("is_wildcard"), (F.col("source") == "from").alias("is_from"), (F.col("c") == 1).alias("has_alias"))


def extract_refs(facts: DataFrame) -> DataFrame:
    """Names a component refers to, without builtins, ``self``/``cls`` and standard modules."""
    spark = facts.sparkSession
    stop = sorted({*dir(builtins), *EXCLUDED_NAMES, *STANDARD_MODULES})  # fixed by the interpreter
    ignored = spark.createDataFrame([(n,) for n in stop], "name string")
    return _owned(facts, "ref").select("repo_id", "file_path", "component_id", "seq", "name").join(
        F.broadcast(ignored), "name", "left_anti")


def extract_bases(facts: DataFrame) -> DataFrame:
    return _owned(facts, "base").select("repo_id", "file_path", "component_id", "seq", "stmt", "name",
                                        F.col("extra").alias("class_name"), F.col("a").alias("pos"))


def extract_decorators(facts: DataFrame) -> DataFrame:
    return _owned(facts, "decorator").select("repo_id", "file_path", "component_id", "seq", "name", F.col("a").alias("pos"))


def extract_params(facts: DataFrame) -> DataFrame:
    """Parameters; a class has the ones of its constructor."""
    return _owned(facts, "param").select(
        "repo_id", "file_path", "component_id", "seq", "name", F.col("text").alias("annotation"),
        F.col("extra").alias("default_text"), F.col("source").alias("kind"), F.col("a").alias("position"))


def extract_attributes(facts: DataFrame) -> DataFrame:
    return _owned(facts, "attribute").select("repo_id", "file_path", "component_id", "seq", "name",
                                             F.col("extra").alias("origin"), F.col("flag").alias("is_direct")).distinct()


def extract_raises(facts: DataFrame) -> DataFrame:
    return _owned(facts, "raise").select("repo_id", "file_path", "component_id", "seq", "name")


def extract_code_facts(facts: DataFrame) -> DataFrame:
    """One row of flags per definition."""
    flags = ["returns_value", "has_return_annotation", "has_yield", "has_raise", "has_warn", "is_abstract"]
    key = ["repo_id", "file_path", "component_id", "seq"]
    rows = _owned(facts, "body", "does", "param", "attribute")
    fact = F.col("fact")
    n_params = F.count_if(fact == "param")
    per = rows.groupBy(*key).agg(
        F.max(F.when(fact == "body", F.col("a"))).alias("n_lines"),
        F.max(F.when(fact == "body", F.col("text"))).alias("return_annotation"),
        *[F.coalesce(F.max((fact == "does") & (F.col("name") == f)), F.lit(False)).alias(f) for f in flags],
        ((n_params > 1) | ((n_params == 1) & (F.min(F.when(fact == "param", F.col("name"))) != "self"))).alias("has_params"),
        (F.count_if((fact == "attribute") & F.col("extra").isin("class_level", "init")) > 0).alias("has_attributes"))
    return per.withColumns({"has_params": F.coalesce("has_params", F.lit(False)),
                            "is_private": last_seg("component_id").startswith("_")})


def local_texts(facts: DataFrame) -> DataFrame:
    """Texts a documentation may quote from the component itself (repo_id, component_id, mode, text)."""
    rows = _owned(facts, "param", "body", "contains", "attribute")
    fact = F.col("fact")

    def entry(mode: str, text) -> F.Column:
        return F.struct(F.lit(mode).alias("mode"), text.alias("text"))

    entries = (
        F.when(fact == "param", F.array(entry("equals", F.col("name")), entry("contains", F.col("text")), entry("contains", F.col("extra"))))
        .when(fact == "body", F.array(entry("contains", F.col("text"))))
        .when(fact == "contains", F.array(entry("contains", F.col("name"))))
        .when(F.col("flag"), F.array(entry("attribute", F.col("name")))))
    return rows.select("repo_id", "file_path", "component_id", "seq", F.explode(entries).alias("e")).select(
        "repo_id", "file_path", "component_id", "seq", "e.mode", "e.text").where(F.col("text").isNotNull())


def parse_errors(facts: DataFrame) -> DataFrame:
    return _of(facts, "error").select("repo_id", "file_path", F.col("text").alias("error"))


def modules(files: DataFrame) -> DataFrame:
    return files.select("repo_id", F.substring_index("module_path", ".", 1).alias("module")).distinct()


# --- stored components and sources ------------------------------------------

def hydrate(components: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored components with their source again, and why a row could not get it.

    ``status`` is ok, no_location, no_file, unparsable or no_span; rows that are
    not ok have no source.
    """
    spans = _of(facts, "span").select("repo_id", F.col("file_path").alias("relative_path"), F.col("a").alias("start_line"),
                                      F.col("b").alias("end_line")).distinct().withColumn("_span", F.lit(True))
    bad = parse_errors(facts).select("repo_id", F.col("file_path").alias("relative_path"), F.lit(True).alias("_bad")).distinct()
    texts = files.select("repo_id", "relative_path", F.col("source").alias("_text"), F.lit(True).alias("_file"))
    joined = (
        components.drop("source_code")
        .join(spans, ["repo_id", "relative_path", "start_line", "end_line"], "left")
        .join(bad, ["repo_id", "relative_path"], "left")
        .join(texts, ["repo_id", "relative_path"], "left")
    )
    status = (
        F.when(F.col("relative_path").isNull() | (F.coalesce("start_line", F.lit(0)) == 0), "no_location")
        .when(F.col("_file").isNull(), "no_file").when(F.col("_bad"), "unparsable")
        .when(F.col("_span").isNull(), "no_span").otherwise("ok"))
    return joined.withColumn("status", status).withColumn("source_code", F.when(
        F.col("status") == "ok", line_slice("_text", F.col("start_line").cast("int"), F.col("end_line").cast("int")))
    ).drop("_span", "_bad", "_text", "_file")


def class_skeletons(components: DataFrame, files: DataFrame) -> DataFrame:
    """Class text from its first line to the end of its constructor, else to the end of its header."""
    inits = components.where((F.col("component_type") == "method") & (last_seg("id") == "__init__")).select(
        "repo_id", owner_id("id").alias("id"), F.col("end_line").alias("_end"))
    classes = components.where("component_type = 'class'").select("repo_id", "id", "relative_path", "start_line", "header_end_line")
    spans = classes.join(inits, ["repo_id", "id"], "left").withColumn("_to", F.coalesce("_end", "header_end_line"))
    return spans.join(files.select("repo_id", "relative_path", "source"), ["repo_id", "relative_path"]).select(
        "repo_id", "id", line_slice("source", F.col("start_line").cast("int"), F.col("_to").cast("int")).alias("skeleton"))
