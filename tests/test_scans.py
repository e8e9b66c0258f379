"""The tree data source and archives read by member."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from codeloom.sources import files as S
from codeloom.sources import tree, zips
from tests.test_sources import put, zipped


def test_tree(spark, tmp_path, monkeypatch):
    put(tmp_path, {"one/a.py": "x = 1", "one/sub/b.py": "y", "one/tests/deep/c.py": "z", "one/test_d.py": "z", "one/readme.md": "no", "two/Docs/e.py": "z",
                   "two/f_test.py": "z", "two/bad.py": b"\xff\xfe", "two/pkg/__init__.py": "", "tests/g.py": "z", "lone.py": "in the root"})
    table = lambda df: {(r.repo_id, r.relative_path): (r.module_path, r.source) for r in df.collect()}
    root = str(tmp_path)
    got = table(tree.read_tree(spark, root))
    assert got == {("one", "a.py"): ("a", "x = 1"), ("one", "sub/b.py"): ("sub.b", "y"), ("two", "bad.py"): ("bad", None), ("two", "pkg/__init__.py"): ("pkg.__init__", ""), ("lone.py", "lone.py"): ("lone", "in the root")}
    assert got == table(S.scan_sources(spark, root))
    assert len(table(tree.read_tree(spark, f"file:{root}/one", repo="r", relevant="false"))) == 4
    assert table(tree.read_tree(spark, root).where("repo_id = 'two' AND relative_path LIKE 'pkg/%'")) == {("two", "pkg/__init__.py"): ("pkg.__init__", "")}
    assert table(tree.read_tree(spark, root).where("repo_id IN ('two', 'x') AND length(relative_path) > 7")) == {("two", "pkg/__init__.py"): ("pkg.__init__", "")}
    assert tree.read_tree(spark, root).where("repo_id = 'none'").count() == 0


def test_folders_are_listed_once_or_never(tmp_path, monkeypatch):
    put(tmp_path, {"one/a.py": "1", "one/sub/b.py": "2", "one/tests/deep/c.py": "3", "two/x/y/d.py": "4", "two/z/e.py": "5"})
    from pyarrow import fs
    from pyspark.sql.datasource import EqualTo, StringStartsWith
    listed = []

    class Seen:
        def __init__(self, inner):
            self.inner = inner

        def get_file_info(self, selector):
            listed.append(selector.base_dir.removeprefix(str(tmp_path)))
            return self.inner.get_file_info(selector)

        def __getattr__(self, name):
            return getattr(self.inner, name)
    monkeypatch.setattr(tree, "opened", lambda uri: (Seen(fs.LocalFileSystem()), uri))

    def scan(*filters):
        listed.clear()
        reader = tree.TreeReader(str(tmp_path), {})
        left = list(reader.pushFilters(list(filters)))
        return sorted(x for p in reader.partitions() for b in reader.read(p) for x in b.column("relative_path").to_pylist()), sorted(listed), left
    files, folders, _ = scan()
    assert files == ["a.py", "sub/b.py", "x/y/d.py", "z/e.py"] and folders == ["", "/one", "/one/sub", "/two", "/two/x", "/two/x/y", "/two/z"]
    begin = StringStartsWith(("relative_path",), "x/")
    files, folders, left = scan(EqualTo(("repo_id",), "two"), begin)
    assert files == ["x/y/d.py"] and folders == ["", "/two", "/two/x", "/two/x/y"] and left == [begin]


def test_archives_by_member(spark, tmp_path):
    r = random.Random(1)
    big = "".join(f"v{i} = {r.random()}\n" for i in range(150_000))  # larger than what one worker would like to hold many of
    odd = io.BytesIO()
    with zipfile.ZipFile(odd, "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("a.py", "other compression")
        z.writestr(zipfile.ZipInfo("b.py"), "stored", zipfile.ZIP_STORED)
    broken = bytearray(zipped({"top/a.py": "A" * 100, "top/b.py": "fine"}))
    broken[broken.index(b"A" * 50) + 3] = 66  # the checksum no longer fits
    put(tmp_path, {"single.zip": zipped({"top/a.py": "a", "top/p/b.py": "b", "top/p/": "", "__MACOSX/x.py": "m", "top/c.txt": "t", "top/bad.py": b"\xff"}),
                   "flat.zip": zipped({"a.py": "1", "d/b.py": "2", "e.py": ""}), "lone.py": "alone", "broken.zip": b"PK no", "empty.zip": zipped({}), "odd.zip": odd.getvalue(),
                   "hurt.zip": bytes(broken), "big.zip": zipped({f"m{i}.py": big for i in range(8)})})
    got = {(x.repo_id, x.relative_path): x.source for x in zips.scan_archives(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k[0] != "big"} == {
        ("single", "a.py"): "a", ("single", "p/b.py"): "b", ("single", "bad.py"): None, ("flat", "a.py"): "1", ("flat", "d/b.py"): "2", ("flat", "e.py"): "",
        ("lone", "lone.py"): "alone", ("odd", "a.py"): None, ("odd", "b.py"): "stored", ("hurt", "a.py"): None, ("hurt", "b.py"): "fine"}
    assert {k[1] for k, v in got.items() if k[0] == "big" and v == big} == {f"m{i}.py" for i in range(8)}
    listed = zips.list_members(spark, str(tmp_path)).where("archive LIKE '%big.zip'")
    assert listed.count() == 8 and listed.agg(F.sum("size")).first()[0] == 8 * len(big)
    # the way for contents in rows gives the same for what it can read
    rows = {(x.repo_id, x.relative_path): x.source for x in S.expand_archives(S.read_archives(spark, str(tmp_path))).where("repo_id <> 'odd'").collect()}
    assert rows == {k: v for k, v in got.items() if k[0] != "odd"}
