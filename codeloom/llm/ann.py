"""Nearest vectors by vantage-point trees over shards; nearness is the largest inner product.

Equal vectors are one point that carries the smallest of its ids (one more than are asked for: the ids beyond can never
be among the nearest), so a vector that a third of all rows share is one point and its queries are one search.

A small tree over a bounded sample of the points (``SAMPLE``) deals all points to shards of vectors that lie together;
a shard of more than about ``SHARD`` points is split by hash.  Each shard gets a tree of its own, written as one row.  A
query goes to the shards that the triangle inequality leaves, given the products it already has with the sample, in
blocks of bounded size; what the shards found is ranked by a window.  ``factor`` relaxes every cut: 1 is exact search,
with more, points may be missed that lie further than the k-th nearest distance over ``factor`` from what was cut.

Defined results: vectors that are null, empty, zero or hold a null or a component that is not finite take no part, nor do
rows without an id.  A vector shorter than the longest counts as followed by zeros.  Equal rows are one row; rows of one
id with different vectors are different candidates and different queries; a query leaves out its own row only.  Equal
products are ordered by id.  An empty table has no result.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import column, cut
from codeloom.llm.vptree import SLACK, Search, Tree, products

NEAREST = 20
#: 1: exact.
FACTOR = 1.0
#: Points that the tree over the shards is built on, points in a shard, queries that meet a shard at once.
SAMPLE, SHARD, BLOCK = 2048, 4096, 1024
#: Levels of the tree over the shards at most.
LEVELS = 7


def usable(vector: Column) -> Column:
    """The vector as doubles without negative zeros; null if it takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    return F.when(fine, doubles)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, all of one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


class Router:
    """The tree over the shards: its leaves are the shards; ``low``/``high`` are widened to all points dealt to them."""

    def __init__(self, sample: np.ndarray, top2: float, leaves: int, k: int, factor: float):
        self.top2, self.k, self.factor = top2, k, factor
        depth = min(LEVELS, max(0, int(np.ceil(np.log2(max(leaves, 1))))))
        self.tree = Tree.build(sample, top2, leaf=1, deepest=depth)

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point: at each node, the side whose distances it fits."""
        t = self.tree
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(t.inside[at] >= 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                own = inner[at[inner] == node]
                d = self._distance(x[own], node)
                border = (t.high[t.inside[node]] + t.low[t.outside[node]]) / 2
                at[own] = np.where(d <= border, t.inside[node], t.outside[node])

    def _distance(self, x: np.ndarray, node: int, point: bool = True) -> np.ndarray:
        v = self.tree.x[self.tree.vantage[node]]
        size2 = np.einsum("ij,ij->i", x, x)
        # of two lifted points; a query is not lifted
        lift = np.sqrt(np.maximum(self.top2 - size2, 0) * max(self.top2 - v @ v, 0)) if point else 0.0
        return np.sqrt(np.maximum((self.top2 if point else size2) + self.top2 - 2 * (x @ v + lift), 0))

    def spans(self, x: np.ndarray, leaf: np.ndarray) -> list[tuple[int, float, float]]:
        """(node, least, largest distance to the parent's vantage point) for all nodes above the leaves given."""
        t = self.tree
        parent = {int(c): n for n in range(len(t.start)) for c in (t.inside[n], t.outside[n]) if c >= 0}
        out: dict[int, tuple[float, float]] = {}
        for at in np.unique(leaf):
            own, node = x[leaf == at], int(at)
            while node in parent:
                d = self._distance(own, parent[node])
                low, high = out.get(node, (np.inf, -np.inf))
                out[node] = min(low, d.min()), max(high, d.max())
                node = parent[node]
        return [(n, a, b) for n, (a, b) in out.items()]

    def widen(self, spans: list[tuple[int, float, float]]) -> None:
        self.tree.low[:], self.tree.high[:] = np.inf, -np.inf  # a node without points is never entered
        self.tree.low[0], self.tree.high[0] = 0, np.inf
        for node, low, high in spans:
            self.tree.low[node], self.tree.high[node] = low, high

    def wanted(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each query has to reach, given the sample, and the pairs (query, leaf) that are left to search."""
        t = self.tree
        bound = np.full(len(q), -np.inf)
        if len(t.x) >= self.k:
            rough = q @ t.x.T
            top = np.argpartition(-rough, self.k - 1, axis=1)[:, :self.k]
            exact = np.stack([products(q, t.x[top[:, j]]) for j in range(self.k)], axis=1)
            bound = exact.min(axis=1)
        size2 = np.einsum("ij,ij->i", q, q)
        reach = np.sqrt(np.maximum(size2 + self.top2 - 2 * bound, 0))
        slack = SLACK * np.sqrt(max(self.top2, 1e-300))
        query, leaf = [], []
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, rows = stack.pop()
            if t.inside[node] < 0:
                query.append(rows)
                leaf.append(np.full(len(rows), node))
                continue
            d = self._distance(q[rows], node, point=False)
            for child in (t.inside[node], t.outside[node]):
                gap = np.maximum(t.low[child] - d, d - t.high[child])
                go = rows[gap * self.factor <= reach[rows] + slack * self.factor]
                if len(go):
                    stack.append((child, go))
        return bound, np.concatenate(query), np.concatenate(leaf)


def _dealt(router: Router, width: int) -> Callable:
    def deal(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), width)
            yield pa.RecordBatch.from_arrays([batch.column("vkey"), batch.column("vector"), batch.column("ids"), pa.array(router.deal(x))], ["vkey", "vector", "ids", "leaf"])
    return deal


def _spanned(router: Router, width: int) -> Callable:
    def span(batches):
        for batch in batches:
            rows = router.spans(matrix(batch.column("vector"), width), np.asarray(column(batch, "leaf"), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))], ["node", "low", "high"])
    return span


def _built(top2: float, width: int) -> Callable:
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = Tree.build(matrix(table.column("vector"), width), top2)
        ids = [table.column("ids")[int(k)].as_py() for k in tree.order]
        lengths = np.array([len(i) for i in ids], np.int64)
        raw = tree.dump(ids=np.array([i for own in ids for i in own], np.int64), lengths=lengths)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "split": pa.array([key[1].as_py()], pa.int64()), "tree": pa.array([raw], pa.binary())})
    return build


def _routed(router: Router, width: int) -> Callable:
    def route(batches):
        for batch in batches:
            q = matrix(batch.column("vector"), width)
            if len(q):
                bound, query, leaf = router.wanted(q)
                at = pa.array(query)
                yield pa.RecordBatch.from_arrays([batch.column("vkey").take(at), batch.column("vector").take(at), pa.array(bound[query]), pa.array(leaf)], ["vkey", "vector", "bound", "leaf"])
    return route


def _searched(top2: float, width: int, k: int, factor: float) -> Callable:
    schema = pa.schema([("vkey", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64()), ("same", pa.bool_()), ("compared", pa.int64())])

    def search(key: tuple[pa.Scalar, ...], trees: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(trees) or not len(queries):
            return schema.empty_table()
        tree, more = Tree.load(trees.column("tree")[0].as_py())
        ends = np.cumsum(more["lengths"])
        first = ends - more["lengths"]
        found = Search(tree, matrix(queries.column("vector"), width), more["ids"][first], top2, k, factor, queries.column("bound").to_numpy())
        keys = queries.column("vkey").to_pylist()
        out: list[tuple] = []
        for row, own in enumerate(keys):
            have = found.point[row][found.score[row] > -np.inf]
            same = (tree.x[have] == found.q[row]).all(axis=1).tolist()
            entries = [(-s, i, own, e) for s, p, e in zip(found.score[row], have, same, strict=False) for i in more["ids"][first[p]:ends[p]].tolist()]
            out += sorted(entries)[:k]
        score, ids, own, same = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(own, pa.binary()), pa.array(ids, pa.int64()), pa.array([-s for s in score], pa.float64()),
                         pa.array(same, pa.bool_()), pa.array([found.compared // len(keys)] * len(ids), pa.int64())], schema=schema)
    return search


def search(embeddings: DataFrame, is_query: Column, k: int = NEAREST, factor: float = FACTOR, sample: int = SAMPLE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of every row that ``is_query`` (a condition on vec_id) holds for."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("vector")).where("vector IS NOT NULL AND vec_id IS NOT NULL")
    most = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("top2")).first()
    width, top2 = most["width"] or 0, (most["top2"] or 0.0) * (1 + 1e-12)
    short = F.size("vector") < width
    rows = rows.withColumn("vector", F.when(short, F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))).otherwise(F.col("vector")))
    rows = cut(rows.withColumn("vkey", F.unhex(F.md5(F.col("vector").cast("string").cast("binary")))))
    # one point for equal vectors: no more ids than can be among the nearest
    numbered = rows.select("vkey", "vec_id", "vector").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("vkey").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    points = cut(numbered.groupBy("vkey").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = points.count()
    if not n:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = points.select("vector").orderBy(F.xxhash64("vkey"), "vkey").limit(sample).toArrow().column("vector")
    router = Router(matrix(drawn, width), top2, -(-n // shard), k + 1, factor)

    dealt = cut(points.mapInArrow(_dealt(router, width), "vkey binary, vector array<double>, ids array<long>, leaf long"))
    sizes = cut(dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("splits")))
    spans = dealt.mapInArrow(_spanned(router, width), "node long, low double, high double").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    router.widen([tuple(r) for r in spans.collect()])  # a row for each node over the shards, bounded by LEVELS
    split = dealt.join(F.broadcast(sizes), "leaf").withColumn("split", F.pmod(F.xxhash64("vkey"), F.col("splits")).cast("long"))
    trees = cut(split.select("leaf", "split", "vector", "ids").groupBy("leaf", "split").applyInArrow(_built(top2, width), "leaf long, split long, tree binary"))

    asked = rows.where(is_query).select("vkey", "vec_id").distinct()
    wanted = cut(points.select("vkey", "vector").join(asked.select("vkey").distinct(), "vkey", "left_semi"))
    blocks = max(1, -(-wanted.count() // block))
    routed = wanted.mapInArrow(_routed(router, width), "vkey binary, vector array<double>, bound double, leaf long")
    at = F.pmod(F.xxhash64("vkey"), F.lit(blocks)).cast("int")
    routed = routed.withColumn("block", at).join(F.broadcast(sizes), "leaf").withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits").cast("long") - 1)))
    facing = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["leaf", "split", "block"]
    found = cut(facing.groupBy(*by).cogroup(routed.select(*by, "vkey", "vector", "bound").groupBy(*by)).applyInArrow(
        _searched(top2, width, k + 1, factor), "vkey binary, vec_id long, score double, same boolean, compared long"))
    nearest = Window.partitionBy("vkey").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).drop("nth", "compared")
    own = Window.partitionBy("query_id", "vkey").orderBy(F.desc("score"), "vec_id")
    out = asked.withColumnRenamed("vec_id", "query_id").join(best, "vkey").where(~F.col("same") | (F.col("query_id") != F.col("vec_id")))
    return out.withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND (q.vec_id <> c.vec_id OR q.e <> c.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}
"""
