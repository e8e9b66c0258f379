"""Log-bilinear language model in numpy, trained by noise-contrastive estimation.

The model is over word classes: the commonest words are classes of their own, the end of a text is one, all others
fall into classes by their last letters.  The two words before a word predict a vector, the sum of their embeddings
times one matrix for each place; a class's score is that vector times the class's own embedding, plus its bias.
Scores of all classes for all pairs of contexts factor into two matrices of classes x classes, so the normaliser of
every context is one matrix product, and probabilities are exact.  Within a class, words share its probability by
their training counts less an absolute discount; the discounts of all classes make up the unknown word.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Words that are classes of their own, classes of the other words, length of the vectors.
OWN, OTHER, DIM = 640, 382, 32
#: The end of a text, and the place before its first word (a context, never predicted).
END, START = OWN + OTHER, OWN + OTHER + 1
CLASSES = OWN + OTHER + 1
#: Letters at the end of a word, in bytes, that choose the class of a word that is none of its own.
SUFFIX = 3
BATCH, NOISE, RATE = 2048, 64, 0.1
#: Where Adagrad's sums start: later rounds go on in small steps from the averaged parameters.
DAMPING = 1.0
TINY = 1e-9


class Classes(dict):
    """Word -> class, remembered up to a bound."""

    BOUND = 150_000

    def __init__(self, own: list[bytes]):
        super().__init__()
        self.own = {w: i for i, w in enumerate(own)}
        self.update(self.own)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.BOUND:
            self.clear()
            self.update(self.own)
        c = self[word] = self.by_suffix(word)
        return c

    @staticmethod
    def by_suffix(word: bytes) -> int:
        return OWN + zlib.crc32(word[-SUFFIX:]) % OTHER

    def sequence(self, words: list[bytes]) -> np.ndarray:
        """Classes of a text's words and its end."""
        out = np.empty(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out[-1] = END
        return out


def contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before, of texts one after the other."""
    one, two = np.empty_like(classes), np.empty_like(classes)
    one[1:], one[:1] = classes[:-1], START
    one[starts] = START
    two[2:], two[:2] = classes[:-2], START
    two[starts] = START
    second = starts + 1
    two[second[second < len(two)]] = START
    return one, two


@dataclass
class Model:
    """Context embeddings, one matrix for each of the two places, embeddings and biases of what is predicted."""
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.c1, self.c2, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])


SHAPES = ((CLASSES + 1, DIM), (DIM, DIM), (DIM, DIM), (CLASSES, DIM), (CLASSES,))


def unflat(x: np.ndarray) -> Model:
    out, at = [], 0
    for shape in SHAPES:
        n = int(np.prod(shape))
        out.append(x[at:at + n].reshape(shape).astype(np.float32))
        at += n
    return Model(*out)


def initial(counts: np.ndarray, seed: int = 7) -> Model:
    """Small random embeddings, and biases that make the model the class frequencies."""
    g = np.random.default_rng(seed)
    p = (counts + 0.5) / (counts + 0.5).sum()
    r, q = (g.normal(0, 0.1, s).astype(np.float32) for s in (SHAPES[0], SHAPES[3]))
    return Model(r, np.eye(DIM, dtype=np.float32), np.eye(DIM, dtype=np.float32), q, np.log(p).astype(np.float32))


def _sum_rows(index: np.ndarray, rows: np.ndarray, n: int, space: np.ndarray) -> np.ndarray:
    """Sums of rows by index, which are small numbers; ``space`` is as large as ``rows``."""
    order = np.argsort(index.astype(np.int16), kind="stable")
    i = index[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[i[first]] = np.add.reduceat(np.take(rows, order, axis=0, out=space, mode="clip"), first, axis=0)
    return out


class Trainer:
    """Steps of noise-contrastive estimation with Adagrad; the normaliser is taken as one while training."""

    def __init__(self, model: Model, counts: np.ndarray, seed: int):
        self.m = Model(*[a.copy() for a in model.arrays()])
        self.noise = (counts + 0.5) / (counts + 0.5).sum()
        self.cumulated = np.cumsum(self.noise)
        self.log_kn = np.log(NOISE * self.noise).astype(np.float32)
        self.g = np.random.default_rng(seed)
        self.seen = [np.full(a.shape, DAMPING, np.float32) for a in self.m.arrays()]
        self.tokens = 0
        # the large arrays of a step, taken once: fresh ones would be handed back to the system and fetched again each time
        self.space = [np.empty((BATCH, k), np.float32) for k in (DIM, DIM, DIM, DIM, NOISE)]

    def step(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        h, qw, dh, space, down = (x[:n] for x in self.space)
        p1, p2 = m.r @ m.c1, m.r @ m.c2
        np.take(p1, one, axis=0, out=h, mode="clip")
        h += np.take(p2, two, axis=0, out=space, mode="clip")
        s = np.minimum(np.searchsorted(self.cumulated, self.g.random(NOISE)), CLASSES - 1)
        qs = m.q[s]
        np.take(m.q, w, axis=0, out=qw, mode="clip")
        true = np.einsum("ij,ij->i", h, qw) + m.b[w] - self.log_kn[w]
        # beyond 30 nothing is left to learn, and squares of gradients would become denormal, which is slow
        up = 1 / ((1 + np.exp(np.minimum(true, 30))) * n)
        np.matmul(h, qs.T, out=down)
        down += m.b[s] - self.log_kn[s]
        np.minimum(np.negative(down, out=down), 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(np.float32(-1 / n), down, out=down)
        np.matmul(down, qs, out=dh)
        qw *= up[:, None]
        dh += qw
        dqs, dbs = down.T @ h, down.sum(axis=0)
        h *= up[:, None]
        dq = _sum_rows(w, h, CLASSES, space)
        np.add.at(dq, s, dqs)
        db = np.bincount(w, weights=up, minlength=CLASSES).astype(np.float32)
        np.add.at(db, s, dbs)
        d1, d2 = _sum_rows(one, dh, CLASSES + 1, space), _sum_rows(two, dh, CLASSES + 1, space)
        gradients = (d1 @ m.c1.T + d2 @ m.c2.T, m.r.T @ d1, m.r.T @ d2, dq, db)
        for a, d, seen in zip(m.arrays(), gradients, self.seen, strict=True):
            d *= 100  # a batch's mean gradient is small beside what Adagrad starts from
            seen += np.square(d)
            d /= np.sqrt(seen)
            d *= RATE
            a += d
        self.tokens += n


@dataclass
class Table:
    """Log-probabilities: of class w after (one, two), one[one, w] + two[two, w] - norm[one, two]; unknown[one, two] of the unknown word."""
    one: np.ndarray
    two: np.ndarray
    norm: np.ndarray
    unknown: np.ndarray

    def log(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the classes, and of the unknown word in their places."""
        norm = self.norm[one, two]
        return (self.one[one, w] + self.two[two, w] - norm) / np.log(10), (self.unknown[one, two] - norm) / np.log(10)


def table(model: Model, unknown_share: np.ndarray) -> Table:
    """All log-probabilities by matrix products; ``unknown_share`` is the part of a class that unknown words have."""
    one = model.r @ model.c1 @ model.q.T + model.b
    two = model.r @ model.c2 @ model.q.T
    # largest values taken out, so that exp neither overflows nor vanishes
    top1, top2 = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
    e1, e2 = np.exp(one - top1), np.exp(two - top2)
    norm = np.log(e1 @ e2.T) + top1 + top2.T
    unknown = np.log(np.maximum((e1 * unknown_share.astype(np.float32)) @ e2.T, 1e-30)) + top1 + top2.T
    return Table(one, two, norm, unknown)
