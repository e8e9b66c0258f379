"""Cover trees in numpy over the whole-number vectors of one chunk, with cumulative sums for Lloyd's rounds.

Equal vectors are one point with a weight.  The points lie in the order of the tree, so a subtree is a slice, and the
difference of two cumulative sums is the sum of its vectors.  A node's ball is covered by balls around some of its own
points, farthest first, each ``SHRINK`` times as wide; where that takes more than one centre for every ``LEAF`` points,
the node stays a leaf and its points are compared one by one.
"""

from __future__ import annotations

import io

import numpy as np

LEAF = 16
SHRINK = 0.6
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 52)
#: Relative and absolute slack of distances taken by square roots.
LOOSE, SLACK = 1e-9, 1e-6


def squared(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of ``books``, both of whole numbers."""
    reach = float(max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)))
    if 4 * reach * reach * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), books.astype(np.float64)
        return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    out = np.zeros((len(x), len(books)), np.int64)
    for k in range(x.shape[1]):
        out += np.square(x[:, k, None] - books[None, :, k])
    return out


class CoverTree:
    FIELDS = ("points", "weight", "total", "inverse", "start", "end", "radius", "first", "last")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF) -> CoverTree:
        points, inverse, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        inverse = inverse.reshape(-1)
        exact = points.astype(np.float64)
        order = np.arange(len(points))
        start, end, radius, first, last = [0], [len(points)], [0.0], [-1], [-1]
        open_ = [0] if len(points) else []
        while open_:
            me = open_.pop()
            own = order[start[me]:end[me]]
            centre = exact[own[0]]  # the first point of a slice is its centre
            d = np.sqrt(np.square(exact[own] - centre).sum(axis=1))
            radius[me] = float(d.max()) * (1 + LOOSE)
            if len(own) <= leaf:
                continue
            most, reach = len(own) // leaf, radius[me] * SHRINK
            belongs, near, centres = np.zeros(len(own), np.int64), d, [0]
            while (far := int(np.argmax(near))) >= 0 and near[far] > reach and len(centres) <= most:
                d = np.sqrt(np.square(exact[own] - exact[own[far]]).sum(axis=1))
                closer = d < near
                belongs[closer] = len(centres)
                near = np.minimum(near, d)
                centres.append(far)
            if near.max() > reach:
                continue
            # each child is a slice that begins with its centre
            leads = np.ones(len(own), np.int64)
            leads[centres] = 0
            by = np.lexsort((leads, belongs))
            order[start[me]:end[me]] = own[by]
            counts = np.bincount(belongs, minlength=len(centres))
            first[me] = len(start)
            at = start[me]
            for n in counts[counts > 0].tolist():
                open_.append(len(start))
                start.append(at)
                end.append(at + n)
                radius.append(0.0)
                first.append(-1)
                last.append(-1)
                at += n
            last[me] = len(start)
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        points, weight = points[order], weight[order]
        total = np.zeros((len(points) + 1, rows.shape[1]), np.int64)
        np.cumsum(points * weight[:, None], axis=0, out=total[1:])
        return cls(points=points, weight=weight, total=total, inverse=place[inverse], start=np.array(start), end=np.array(end),
                   radius=np.array(radius), first=np.array(first), last=np.array(last))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        arrays = np.load(io.BytesIO(raw))
        return cls(**{name: arrays[name] for name in cls.FIELDS})

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """(entry of each point; whole subtrees as start, end, entry; the points that were compared one by one).

        A subtree goes whole to the entry nearest to its centre if every other entry is further from the centre by more
        than twice the radius: no point of the ball can then be nearer to it, nor as near.
        """
        label = np.zeros(len(self.points), np.int64)
        whole: list[tuple[int, int, int]] = []
        single: list[np.ndarray] = []
        level = np.array([0]) if len(self.points) else np.zeros(0, np.int64)
        while len(level):
            d = squared(self.points[self.start[level]], book)
            entry = np.argmin(d, axis=1)
            least = np.sqrt(d[np.arange(len(level)), entry].astype(np.float64))
            if len(book) > 1:
                rest = d.astype(np.float64)
                rest[np.arange(len(level)), entry] = np.inf
                second = np.sqrt(rest.min(axis=1))
            else:
                second = np.full(len(level), np.inf)
            alone = self.end[level] - self.start[level] == 1
            settled = alone | (second - least > 2 * self.radius[level] * (1 + LOOSE) + SLACK)
            for node, e in zip(level[settled].tolist(), entry[settled].tolist(), strict=True):
                whole.append((int(self.start[node]), int(self.end[node]), e))
                label[self.start[node]:self.end[node]] = e
            going = level[~settled]
            leaves = going[self.first[going] < 0]
            single += [np.arange(self.start[n], self.end[n]) for n in leaves]
            going = going[self.first[going] >= 0]
            level = np.concatenate([np.arange(self.first[n], self.last[n]) for n in going]) if len(going) else np.zeros(0, np.int64)
        ones = np.concatenate(single) if single else np.zeros(0, np.int64)
        for at in range(0, len(ones), 4096):
            own = ones[at:at + 4096]
            label[own] = np.argmin(squared(self.points[own], book), axis=1)
        return label, self.inverse, whole, ones

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each entry: the sum and the number of the vectors nearest to it; and how many points were compared alone."""
        label, _, whole, ones = self.assign(book)
        sums = np.zeros((len(book), self.points.shape[1]), np.int64)
        counts = np.zeros(len(book), np.int64)
        np.add.at(sums, label[ones], self.points[ones] * self.weight[ones, None])
        np.add.at(counts, label[ones], self.weight[ones])
        if whole:
            at, to, entry = np.array(whole).T
            np.add.at(sums, entry, self.total[to] - self.total[at])
            heads = np.concatenate([[0], np.cumsum(self.weight)])
            np.add.at(counts, entry, heads[to] - heads[at])
        return sums, counts, len(ones)
