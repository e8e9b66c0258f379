"""Vantage-point trees in numpy: built over the vectors of one shard, searched for a block of queries at once.

Largest inner products become smallest distances by one more component: with M the largest norm, x' = (x, sqrt(M^2 -
|x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  The triangle inequality then holds for x' and q'.
"""

from __future__ import annotations

import io

import numpy as np

LEAF = 64
#: Queries that visit a node's children in an order of their own at least.
APART = 256
#: Share of the largest norm by which rounded distances may be off; a bound must exceed it to cut.
SLACK = 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of x, one by one, summed in the order of the components."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def lifted(x: np.ndarray, top2: float) -> np.ndarray:
    """The points with the component that makes all of them as long as the longest."""
    rest = np.maximum(top2 - np.einsum("ij,ij->i", x, x), 0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points - vantage).sum(axis=1))


class Tree:
    """Nodes in arrays; the points lie in the order of the leaves, so that a node is a slice of them.

    ``vantage`` is a row of the lifted points, ``inside`` and ``outside`` are node numbers (-1: a leaf), and ``low`` and
    ``high`` the least and the largest distance of a node's points to its parent's vantage point.
    """

    FIELDS = ("x", "order", "start", "end", "vantage", "inside", "outside", "low", "high")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, x: np.ndarray, top2: float, leaf: int = LEAF, deepest: int = 64) -> Tree:
        up = lifted(x, top2)
        order = np.arange(len(x))
        nodes: list[list] = []

        def node(at: int, to: int, low: float, high: float, depth: int) -> int:
            me = len(nodes)
            nodes.append([at, to, -1, -1, -1, low, high])
            if to - at <= leaf or depth >= deepest:
                return me
            own = order[at:to]
            # the point farthest from the first one: vantage points at the rim tell the others apart best
            v = own[int(np.argmax(distances(up[own], up[own[0]])))]
            d = distances(up[own], up[v])
            half = (to - at) // 2
            by = np.argpartition(d, half)
            order[at:to], d = own[by], d[by]
            nodes[me][2] = v
            nodes[me][3] = node(at, at + half, d[:half].min(), d[:half].max(), depth + 1)
            nodes[me][4] = node(at + half, to, d[half:].min(), d[half:].max(), depth + 1)
            return me

        if len(x):
            node(0, len(x), 0.0, np.inf, 0)
        table = np.array(nodes, np.float64).reshape(-1, 7)
        start, end, vantage, inside, outside = table[:, :5].astype(np.int64).T
        # points in the order of the leaves; vantage points by their new place
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        vantage = np.where(vantage >= 0, place[vantage] if len(x) else vantage, -1)
        return cls(x=x[order], order=order, start=start, end=end, vantage=vantage, inside=inside, outside=outside, low=table[:, 5], high=table[:, 6])

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[Tree, dict[str, np.ndarray]]:
        arrays = np.load(io.BytesIO(raw))
        return cls(**{name: arrays[name] for name in cls.FIELDS}), {k: arrays[k] for k in arrays.files if k not in cls.FIELDS}


class Search:
    """The ``k`` largest products of each query with the points of a tree, ties by the points' ``rank`` (small first).

    ``bound``: products below it are not wanted.  A child is cut if the least distance that the triangle inequality
    leaves to its points, times ``factor``, exceeds the distance of the k-th best so far: 1 keeps the search exact, more
    cuts earlier.  ``compared`` counts the products taken.
    """

    def __init__(self, tree: Tree, q: np.ndarray, rank: np.ndarray, top2: float, k: int, factor: float, bound: np.ndarray):
        self.tree, self.q, self.rank, self.k, self.factor, self.bound = tree, q, rank, k, factor, bound
        self.up = lifted(tree.x, top2)
        self.far2 = np.einsum("ij,ij->i", q, q) + top2
        self.slack = SLACK * np.sqrt(max(top2, 1e-300))
        self.norms = np.sqrt(np.einsum("ij,ij->i", tree.x, tree.x))
        self.score = np.full((len(q), k), -np.inf)
        self.point = np.full((len(q), k), -1)
        self.compared = 0
        if len(tree.start):
            self._visit(0, np.arange(len(q)))

    def _least(self, rows: np.ndarray) -> np.ndarray:
        """The product that a point must reach to matter."""
        return np.maximum(self.score[rows, -1], self.bound[rows])

    def _open(self, node: int, rows: np.ndarray, d: np.ndarray) -> np.ndarray:
        gap = np.maximum(self.tree.low[node] - d, d - self.tree.high[node])
        with np.errstate(invalid="ignore"):
            reach = np.sqrt(np.maximum(self.far2[rows] - 2 * self._least(rows), 0))
        return gap * self.factor <= reach + self.slack * self.factor

    def _visit(self, node: int, rows: np.ndarray) -> None:
        t = self.tree
        if t.inside[node] < 0:
            return self._leaf(node, rows)
        v = self.up[t.vantage[node]]
        d = np.sqrt(np.maximum(self.far2[rows] - 2 * (self.q[rows] @ v[:-1]), 0))
        near = d <= (t.high[t.inside[node]] + t.low[t.outside[node]]) / 2
        # the nearer side first: it tightens the bound for the other; few queries go with the many
        inward = int(near.sum())
        if min(inward, len(rows) - inward) >= APART:
            turns = ((near, t.inside[node], t.outside[node]), (~near, t.outside[node], t.inside[node]))
        elif 2 * inward >= len(rows):
            turns = ((slice(None), t.inside[node], t.outside[node]),)
        else:
            turns = ((slice(None), t.outside[node], t.inside[node]),)
        for mine, first, second in turns:
            for child in (first, second):
                go = rows[mine][self._open(child, rows[mine], d[mine])]
                if len(go):
                    self._visit(child, go)
        return None

    def _leaf(self, node: int, rows: np.ndarray) -> None:
        t = self.tree
        own = np.arange(t.start[node], t.end[node])
        x = t.x[own]
        self.compared += len(rows) * len(own)
        # products by matrix first, those that can matter once more in a fixed order of summation
        rough = self.q[rows] @ x.T
        margin = 1e-13 * len(x.T) * np.sqrt(np.einsum("ij,ij->i", self.q[rows], self.q[rows]))[:, None] * self.norms[own][None, :]
        i, j = np.nonzero(rough >= self._least(rows)[:, None] - margin)
        if not len(i):
            return
        exact = np.full((len(rows), len(own)), -np.inf)
        exact[i, j] = products(self.q[rows[i]], x[j])
        touched = np.unique(i)
        rows, exact = rows[touched], exact[touched]
        exact[exact < self.bound[rows][:, None]] = -np.inf
        score = np.concatenate([self.score[rows], exact], axis=1)
        point = np.concatenate([self.point[rows], np.broadcast_to(own, exact.shape)], axis=1)
        best = np.lexsort((self.rank[point], -score), axis=-1)[:, :self.k]
        self.score[rows] = np.take_along_axis(score, best, axis=1)
        self.point[rows] = np.take_along_axis(point, best, axis=1)
