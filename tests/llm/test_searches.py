"""Nearest vectors, vector codes and ranked search against brute force, with odd inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann, ranked, veccodes
from codeloom.llm.covertree import CoverTree, squared
from codeloom.llm.vptree import Search, Tree, products

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, vector string, vkey int, score string, ids int, rank int, v int, code int, error string"


def clustered(n, width, groups, spread, seed=1, longest=2.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    return centres[r.integers(groups, size=n)] * r.uniform(1 / longest, longest, size=(n, 1)) + spread * r.normal(size=(n, width))


@pytest.fixture(scope="module")
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], label, "s", 1, "s", 2, 3, 4, 5, "e") for i, e, label in rows], VECTORS)
    return make


@pytest.fixture(scope="module")
def odd_vectors(make_vectors):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=8).round(3).tolist(), k % 3 if k % 7 else None) for k in range(200)]
    same = r.normal(size=8).round(3).tolist()
    rows += [(200 + k, same, 1) for k in range(120)]  # a vector of a third of all rows
    rows += [(400, None, 1), (420, [], 1), (440, [0.0] * 8, None), (460, [1.0, None] + [0.0] * 6, 1), (480, [NAN] * 8, 1), (500, [INF] + [0.0] * 7, 1),
             (520, [1.0, 2.0, 3.0], 2), (540, [-0.0, 1.0], 2), (541, [0.0, 1.0], 2), (None, same, 0), (60, same, 0), (60, same, 0), (80, [1e-30] * 8, 0), (100, [5000.0] * 8, 0)]
    return make_vectors(rows)


def plain_search(rows, k):
    """Every pair, sums in the order of the components."""
    fine = [(i, [np.float64(x) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    width = max((len(e) for _, e in fine), default=0)
    fine = sorted({(i, (*[x + 0.0 for x in e], *[0.0] * (width - len(e)))) for i, e in fine})
    out = Counter()
    for q, a in fine:
        if q % 20 == 0:
            have = []
            for i, b in fine:
                if (i, b) != (q, a):
                    s = np.float64(0)
                    for x, y in zip(a, b, strict=True):
                        s += x * y
                    have.append((-float(s), i))
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(have)[:k]))
    return out


def test_tree_is_exact_and_cuts():
    x = clustered(3000, 12, 30, 0.05)
    q = np.concatenate([x[::40], clustered(20, 12, 5, 1.0, seed=9)])
    top2 = float(np.square(x).sum(axis=1).max())
    tree = Tree.build(x, top2)
    assert sorted(tree.order.tolist()) == list(range(3000)) and np.array_equal(tree.x, x[tree.order])
    again, _ = Tree.load(tree.dump())
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    exact = Search(again, q, tree.order, top2, 10, 1.0, np.full(len(q), -np.inf))
    assert np.allclose(exact.score, want, atol=1e-9)
    assert exact.compared < len(x) * len(q)
    # bounds that the caller knows never lose what reaches them
    bounded = Search(tree, q, tree.order, top2, 10, 1.0, want[:, 9] - 1e-9)
    assert np.array_equal(bounded.point, exact.point) and bounded.compared <= exact.compared
    assert products(np.array([[1.0, 2.0]]), np.array([[3.0, 4.0]])).tolist() == [11.0]


def test_relaxed_cuts():
    """Vectors of one length in clusters: the factor trades products for recall."""
    x = clustered(3000, 12, 30, 0.05)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = Tree.build(x, 1.0)
    q, open_ = x[::30], np.full(100, -np.inf)
    runs = [Search(tree, q, tree.order, 1.0, 10, factor, open_) for factor in (1.0, 1.5, 3.0, 8.0)]
    recall = [np.mean([len(set(a) & set(b)) / 10 for a, b in zip(runs[0].point.tolist(), run.point.tolist(), strict=True)]) for run in runs]
    compared = [run.compared for run in runs]
    assert compared == sorted(compared, reverse=True) and compared[0] < 0.5 * len(x) * len(q) and compared[2] < 0.8 * compared[0]
    assert recall[0] == 1 and recall[1] >= 0.95 and recall[2] >= 0.9, (recall, compared)


def test_search_equals_every_pair(spark, odd_vectors):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in odd_vectors.collect()]
    for sizes in ({}, {"sample": 40, "shard": 16, "block": 5}):
        got = ann.search(odd_vectors, F.col("vec_id") % 20 == 0, **sizes)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == plain_search(rows, ann.NEAREST)
    assert ann.search(odd_vectors.limit(0), F.lit(True)).count() == 0
    assert ann.search(odd_vectors, F.lit(False)).count() == 0
    few = odd_vectors.where("vec_id IN (20, 21, 22)")
    assert [tuple(r)[:2] for r in ann.search(few, F.col("vec_id") == 20).orderBy("rank").collect()] == [(20, 1), (20, 2)]


def test_relaxed_search_over_shards(spark, make_vectors):
    x = clustered(2000, 16, 40, 0.05, seed=4)
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = make_vectors([(k, e.tolist(), 0) for k, e in enumerate(x)])
    held = {f: {(r["query_id"], r["vec_id"]) for r in ann.search(vectors, F.col("vec_id") % 20 == 0, factor=f, shard=200).collect()} for f in (1.0, 2.0)}
    assert len(held[1.0]) == 2000 and len(held[1.0] & held[2.0]) / 2000 >= 0.9


@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0])
def test_cover_tree_sums(spread):
    x = np.floor(1024 * clustered(1500, 6, 20, spread, seed=7, longest=1)).astype(np.int64)
    tree = CoverTree.load(CoverTree.build(x).dump())
    assert np.array_equal(tree.points[tree.inverse], x) and tree.weight.sum() == 1500
    for n, t in zip(range(len(tree.start)), tree.radius, strict=True):  # balls hold their subtrees, children make up their parent
        own = tree.points[tree.start[n]:tree.end[n]]
        assert np.sqrt(np.square(own - own[0]).sum(axis=1)).max() <= t * (1 + 1e-9) + 1e-9
        if tree.first[n] >= 0:
            assert sum(tree.end[c] - tree.start[c] for c in range(tree.first[n], tree.last[n])) == tree.end[n] - tree.start[n]
    book = np.concatenate([x[:30], x[:3]])  # equal entries: the first one wins
    nearest = np.argmin(((x[:, None, :] - book[None]) ** 2).sum(axis=2), axis=1)
    label, inverse, _, ones = tree.assign(book)
    assert np.array_equal(label[inverse], nearest)
    sums, counts, alone = tree.sums(book)
    assert counts.tolist() == np.bincount(nearest, minlength=len(book)).tolist()
    assert all(np.array_equal(sums[e], x[nearest == e].sum(axis=0)) for e in range(len(book)))
    assert alone == len(ones) <= len(tree.points) and (spread or alone <= 20)
    far = [0]
    for _ in range(9):
        far.append(int(np.argmax(np.square(x[:, None] - x[far]).sum(axis=2).min(axis=1))))
    if spread < 1:
        assert tree.sums(x[far])[2] < 0.5 * len(x)  # clusters go whole
    big = x * 10**6
    assert np.array_equal(squared(big, book * 10**6), ((big[:, None, :] - book[None] * 10**6) ** 2).sum(axis=2))


def plain_codes(rows):
    """Lloyd's rounds with plain numbers."""
    width = max((len(e) for _, e, _ in rows if e is not None), default=0)
    part = max(1, -(-width // 4))
    fine = [(i, [math.floor(1024 * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    fine = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([e + [0] * (4 * part - len(e)) for _, e, _ in fine], dtype=object)
    parts = [x[:, p * part:(p + 1) * part] for p in range(4)]
    books = [[list(row) for row in own[:256]] for own in parts]

    def nearest(own, book):
        return [min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(row, book[e], strict=True)), e)) for row in own]

    for _ in range(4):
        for own, book in zip(parts, books, strict=True):
            at = nearest(own, book)
            for e in range(len(book)):
                mine = [row for row, k in zip(own, at, strict=True) if k == e]
                if mine:
                    book[e] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    last = [nearest(own, book) for own, book in zip(parts, books, strict=True)]
    error = [sum(sum((a - b) ** 2 for a, b in zip(own[r], book[at[r]], strict=True)) for own, book, at in zip(parts, books, last, strict=True)) for r in range(len(fine))]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(fine, error, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{at[r]:02x}" for at in last), error[r], by_label[label], sha) for r, (i, _, label) in enumerate(fine))


def test_codes_equal_plain_rounds(odd_vectors):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in odd_vectors.collect()]
    want = plain_codes(rows)
    for chunk in (4096, 50):
        got = veccodes.compress(odd_vectors, chunk=chunk)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert veccodes.compress(odd_vectors.limit(0)).count() == 0
    one = veccodes.compress(odd_vectors.where("vec_id = 1")).collect()
    assert [(r["code"], r["error"]) for r in one] == [("00000000", 0)]
    assert veccodes.compress(odd_vectors.where("vec_id = 420")).count() == 1  # an empty vector is all zeros


def test_components_beyond_the_limit(make_vectors):
    rows = veccodes.compress(make_vectors([(1, [3e38, -3e38, 0, 0], 1), (2, [0, 0, 0, 0], 1)])).collect()
    assert len(rows) == 2 and all(r["error"] == 0 for r in rows)


def plain_ranks(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    held = [d for d in held if d[2]]
    documents, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(cut(t))
    out = Counter()
    for item, own in wanted.items():
        rows = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * documents) // words
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out.update((item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k]))
    return out


def test_ranks_equal_plain_scores(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    texts = {i: t for i, t in docs}
    rows = [(1, "The GREEN river, walk-under light"), (2, None), (3, ""), (4, "!!! ..."), (5, "zebra"), (None, "stone été"), (6, "house"), (6, "SEVEN bright"),
            (7, texts[7]), (8, " ".join(f"w{k}" for k in range(5000)) + " house \U0001f600 ein"), (9, "İ K"), (1, "the green river, walk-under light")]
    items = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "item_id long, text string, doc_id string, score int")
    for k, size in ((50, ranked.BLOCK), (3, 2000)):
        got = ranked.search(odd_docs, items, k, size)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == plain_ranks(docs, rows, k)
    assert ranked.search(no_docs, items).count() == 0 and ranked.search(odd_docs, items.limit(0)).count() == 0


def test_ranks_on_the_tables(spark):
    from tests.llm.conftest import SMALL
    tables = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark")]
    docs, items = ([tuple(r) for r in t.select(i, "text").collect()] for t, i in zip(tables, ("doc_id", "item_id"), strict=True))
    assert Counter(tuple(r) for r in ranked.search(*tables).collect()) == plain_ranks(docs, items, ranked.BEST)


def test_masks_end_the_search_early():
    r = np.random.default_rng(2)
    n, vocabulary = 4000, 40
    held = [np.sort(r.choice(vocabulary, size=5, replace=False, p=(p := 1 / np.arange(1, vocabulary + 1)) / p.sum())) for _ in range(n)]
    lengths = np.full(n, 5)
    df = np.bincount(np.concatenate(held), minlength=vocabulary)
    weight = ranked.weights(df, n)
    chunk = ranked.Chunk(np.arange(n), r.integers(5, 60, size=n), np.concatenate(held), r.integers(1, 4, size=5 * n), lengths, weight, n, 30 * n)
    item = np.arange(0, vocabulary, 3)
    empty = np.zeros(0, np.int64)
    score, ids, scored = chunk.best(item, (empty, empty), 10)
    every = chunk.scores(item, np.arange(n))
    by = np.lexsort((np.arange(n), -every))[:10]
    assert score.tolist() == every[by].tolist() and ids.tolist() == by.tolist() and scored < n / 4
