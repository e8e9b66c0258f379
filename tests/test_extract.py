"""Extraction from small hand-made sources."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import extract as E
from codeloom.session import cut

BASIC = '''import os, a.b as ab
from .near import x as y, z
from pkg import *

@deco.make(1)
class Thing(Base, mod.Other, metaclass=M):
    """Doc of thing."""
    size: int = 3
    a, b = 1, 2

    def __init__(self, left: "int" = 1, *rest, key=None, **more):
        self.left = left
        if left:
            self.deep = 1

    @property
    def area(self) -> float:
        return self.left * helper(os.path.sep).x

    @area.setter
    def area(self, value):
        raise ValueError("bad")

    async def later(self):
        local = 1
        yield local

    class Inner:
        inner_attr = 1
        def go(self): pass

def outer(self):
    "Doc."
    def nested():
        raise KeyError
    warnings.warn("old", DeprecationWarning)
    raise errors.Bad

if True:
    def conditional(): pass

def _quiet() -> None:
    raise

@abc.abstractmethod
def late(a, /, b): return
'''


@pytest.fixture(scope="module")
def facts(make_files):
    return cut(E.extract_facts(make_files({"m/basic.py": BASIC, "m/broken.py": "def (", "m/bytes.py": None})))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_components(facts):
    got = {r.id: r for r in E.extract_components(facts).collect()}
    assert set(got) == {"m.basic." + n for n in (
        "Thing", "Thing.__init__", "Thing.area", "Thing.later", "Inner", "Inner.go", "outer", "_quiet", "late")}
    thing = got["m.basic.Thing"]
    assert (thing.component_type, thing.start_line, thing.docstring) == ("class", 5, "Doc of thing.")
    assert thing.header_end_line == thing.end_line
    assert thing.signature == "class Thing(Base, mod.Other, metaclass=M):"
    assert got["m.basic.Thing.__init__"].signature == "def __init__(self, left: 'int'=1, *rest, key=None, **more):"
    assert got["m.basic.Thing.area"].start_line == 20 and not got["m.basic.Thing.area"].has_docstring  # the setter is last
    assert got["m.basic.Thing.later"].signature == "async def later(self):"
    assert got["m.basic._quiet"].source_code == "def _quiet() -> None:\n    raise"


def test_errors(facts):
    assert {r.file_path for r in E.parse_errors(facts).collect()} == {"m/broken.py", "m/bytes.py"}


def test_imports(facts):
    assert rows(E.extract_imports(facts), "visible_name", F.coalesce("module", F.lit("-")), "original_name", "level", "is_wildcard", "is_from") == sorted([
        ("os", "os", "os", 0, False, False), ("ab", "a.b", "a.b", 0, False, False), ("y", "near", "x", 1, False, True),
        ("z", "near", "z", 1, False, True), ("*", "pkg", "*", 0, True, True)])


def test_refs(facts):
    refs = E.extract_refs(facts).where("component_id = 'm.basic.Thing.area'")
    # two definitions; "self" and builtins are not references, the dotted whole name is
    assert {r.name for r in refs.collect()} == {"self.left", "helper", "os.path.sep", "os.path", "x", "property", "area", "area.setter", "float"} - {"property", "float"}


def test_bases_and_decorators(facts):
    assert rows(E.extract_bases(facts), "component_id", "name", "pos") == [("m.basic.Thing", "Base", 0), ("m.basic.Thing", "mod.Other", 1)]
    deco = {(r.component_id, r.name) for r in E.extract_decorators(facts).collect()}
    assert ("m.basic.Thing", "deco.make") in deco and ("m.basic.late", "abc.abstractmethod") in deco


def test_params(facts):
    got = rows(E.extract_params(facts).where("component_id = 'm.basic.Thing'"), "position", "name", "kind",
               F.coalesce("annotation", F.lit("")), F.coalesce("default_text", F.lit("")))
    assert got == [(0, "self", "positional", "", ""), (1, "left", "positional", "'int'", "1"), (2, "key", "keyword_only", "", "None"),
                   (3, "rest", "vararg", "", ""), (4, "more", "kwarg", "", "")]


def test_code_facts(facts):
    winners = E.extract_components(facts)
    got = {r.component_id: r for r in E.of_winners(E.extract_code_facts(facts), winners).collect()}
    outer, quiet, late = (got["m.basic." + n] for n in ("outer", "_quiet", "late"))
    assert outer.has_raise and outer.has_warn and not outer.has_params and not outer.returns_value
    assert quiet.is_private and not quiet.has_return_annotation and quiet.has_raise
    assert late.is_abstract and late.has_params and not late.returns_value
    assert got["m.basic.Thing.later"].has_yield and got["m.basic.Thing"].has_attributes and got["m.basic.Thing"].has_params
    raised = rows(E.extract_raises(facts), "component_id", "name")
    assert ("m.basic.outer", "KeyError") in raised and ("m.basic.Thing.area", "ValueError") in raised
    assert not any(n == "Bad" for _, n in raised)


def test_attributes(facts):
    got = set(rows(E.extract_attributes(facts).where("component_id = 'm.basic.Thing'"), "name", "origin", "is_direct"))
    assert got == {("size", "class_level", True), ("(a, b)", "class_level", False), ("left", "init", True), ("deep", "init", False),
                   ("area", "property", True), ("local", "class_level", True), ("inner_attr", "nested", True)}


def test_hydrate(spark, facts, make_files):
    files = make_files({"m/basic.py": BASIC, "m/broken.py": "def ("})
    outer = E.extract_components(facts).where("id = 'm.basic.outer'").first()
    stored = spark.createDataFrame([
        ("r", "ok", "m/basic.py", outer.start_line, outer.end_line), ("r", "span", "m/basic.py", outer.start_line, outer.end_line + 1),
        ("r", "gone", "m/x.py", 1, 2), ("r", "bad", "m/broken.py", 1, 1), ("r", "zero", "m/basic.py", 0, 2), ("r", "nowhere", None, 1, 2)],
        "repo_id string, id string, relative_path string, start_line long, end_line long")
    got = {r.id: (r.status, r.source_code) for r in E.hydrate(stored, files, facts).collect()}
    assert got == {"ok": ("ok", outer.source_code), "span": ("no_span", None), "gone": ("no_file", None),
                   "bad": ("unparsable", None), "zero": ("no_location", None), "nowhere": ("no_location", None)}


def test_skeletons(facts, make_files):
    files = make_files({"m/basic.py": BASIC})
    got = {r.id: r.skeleton for r in E.class_skeletons(E.extract_components(facts), files).collect()}
    assert got["m.basic.Thing"].startswith("@deco.make(1)") and got["m.basic.Thing"].endswith("self.deep = 1")
    assert got["m.basic.Inner"].endswith("def go(self): pass")


NESTED = '''@made((yield_ for yield_ in ()))
class A(base.B, key=lambda: (yield)):
    long: dict[str, "x"] = {**more, "k": -1.5}
    @first(warnings.warn("head", old.kind))
    def run(self, a, /, b: int = 1, *, c=(1, 2), **rest: tuple[int, ...]) -> "None":
        class Deep[T](Generic[T]):
            def go(self, *, only: str = 'q') -> x.y:
                match self.left:
                    case Point(px=0, other=[first, *_]) if first.ok: raise Odd(self.a[b].c, key=1) from e
                    case {"k": v, **others}: return v
        try: warn(f"{a!r:>{b}}")
        except (E1, mod.E2) as e: raise
        async def inner(z=lambda q: (yield)): return [i async for i in z]
if (walrus := top()):
    class InIf:
        def late(*args: int): yield from args
'''


def test_nested_components_have_what_a_plain_walk_finds(make_files):
    import ast
    tree, want, does = ast.parse(NESTED), {}, {}
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            for cid, node in [(f"n.{c.name}", c)] + [(f"n.{c.name}.{m.name}", m) for m in c.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]:
                want[cid] = {E._dotted(s, True) for s in ast.walk(node) if isinstance(s, (ast.Name, ast.Attribute))}
                inside = [s for stmt in node.body for s in ast.walk(stmt)]
                does[cid] = {n for n, kinds in (("has_yield", (ast.Yield, ast.YieldFrom)), ("has_raise", ast.Raise)) if any(isinstance(s, kinds) for s in inside)}
    found = cut(E.extract_facts(make_files({"n.py": NESTED})))
    got = {cid: set() for cid in want}
    for r in found.where("fact = 'ref'").collect():
        got[r.owner].add(r.name)
    assert got == want
    did = {cid: set() for cid in does}
    for r in found.where("fact = 'does' AND name IN ('has_yield', 'has_raise')").collect():
        did[r.owner].add(r.name)
    assert did == does
    signatures = {r.owner: r.text for r in found.where("fact = 'component'").collect()}
    assert signatures["n.A.run"] == "def run(self, a, /, b: int=1, *, c=(1, 2), **rest: tuple[int, ...]) -> 'None':"
    assert signatures["n.Deep.go"] == "def go(self, *, only: str='q') -> x.y:" and signatures["n.Deep"] == "class Deep[T](Generic[T]):"


def test_nodes_are_read_once_however_deep_components_nest(monkeypatch):
    depth = 20
    lines = [" " * d + f"class C{d}:" for d in range(depth)] + [" " * depth + "def go(self): raise Odd(a.b[0], key=1)"]
    made = []
    plain = E.ast.unparse
    monkeypatch.setattr(E.ast, "unparse", lambda node: made.append(node) or plain(node))
    walked = []
    walk = E.ast.walk
    monkeypatch.setattr(E.ast, "walk", lambda node: (walked.append(s) or s for s in walk(node)))
    rows = list(E._file_facts("m", "\n".join(lines)))
    assert len(made) <= 5 and len(walked) <= 200 and len(rows) > depth


def test_long_sums_in_class_bodies(make_files):
    facts = cut(E.extract_facts(make_files({"m/long.py": "class Long:\n    text = " + " + ".join(["'a'"] * 1500) + "\n"})))
    assert not E.parse_errors(facts).take(1)
    assert rows(E.extract_attributes(facts), "name", "origin") == [("text", "class_level")]
