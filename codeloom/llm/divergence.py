"""Quality rules: how far a text's histograms lie from those of the languages.

Two histograms are taken of every text: its characters by class, and its words over the commonest words of the
languages (everything else is one more bin).  References are the sums over all documents of a language.  A text is
compared with each language by the Jensen-Shannon distance (base 2, 0 to 1); the nearest language by words counts.
Texts shorter than ``LEAST_WORDS`` are too short for a verdict by distance.

``measures`` gives the plain counts of a text (words, symbols, repeated lines and word windows).

Defined results: a null text counts as empty: no words, all counts 0, not kept.  Rows with a null language make no
reference; without any reference only the plain counts decide.  Repeated rows are judged alike; one row per input row,
none for an empty table.  Long texts are taken whole.  Of languages at the same distance, and of words equally common,
the one that sorts first counts.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import SPACE, column, slim, texts_of

LEAST_WORDS = 50
#: Common words of a language, by their counts in all its documents.
COMMON = 64
#: Distances beyond which a text is no longer like its language.
CHARACTERS_APART = 0.30
WORDS_APART = 0.5
SYMBOLS = "#*$%&|<>"
#: Longest word that can be a common one, in bytes.
LONGEST = 40

# ASCII characters of each class; all others are "letter" or "other" by their code point.
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789",
    "space": " ", "line": "\n\r\t\x0b\x0c", "stop": ".,;:!?", "quote": "'\"()-", "symbol": "#*$%&|<>@^~_=+/\\[]{}`",
}
N_CLASSES = len(CLASSES) + 2
_CLASS = np.full(256, N_CLASSES - 1, np.uint8)
_CLASS[0x80:0xC0] = N_CLASSES  # a character's further bytes, dropped
_CLASS[0xC3:0xC5] = N_CLASSES - 2  # first bytes of Latin letters with marks
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k


def measures(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of a text."""
    words = text.split()  # of bytes: exactly at the characters of SPACE
    symbols = sum(text.count(c) for c in SYMBOLS.encode())
    # code points: bytes that begin one
    a = np.frombuffer(text, np.uint8)
    chars = len(a) - int(np.count_nonzero((a & 0xC0) == 0x80)) - sum(text.count(c) for c in SPACE.encode())
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    again = len(lines) - len(set(lines))
    n, repeated = len(words), 0
    if n >= 4:
        windows = Counter(zip(words, islice(words, 1, None), islice(words, 2, None), strict=False))
        if len(windows) < n - 2:
            twice = np.fromiter((windows[w] > 1 for w in zip(words, islice(words, 1, None), islice(words, 2, None), strict=False)), bool, n - 2)
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k:n - 2 + k] |= twice
            repeated = int(inside.sum())
    return n, chars, symbols, again, repeated, words


def character_histogram(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def _bare(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?'\"()")


def _word_counts(batches):
    held: Counter = Counter()
    for batch in batches:
        lang = column(batch, "lang")
        for at, texts in texts_of(batch):
            for i, t in enumerate(texts):
                for word, n in Counter(t.split()).items():
                    if 0 < len(w := _bare(word)) <= LONGEST:
                        held[lang[at + i], w] += n
                if len(held) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])
                    held = Counter()
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])


def _histograms(number: dict[bytes, int]):
    """Sums by language of the histograms of a task's texts: (lang, kind, bin, n)."""
    def run(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lang = column(batch, "lang")
            for at, texts in texts_of(batch):
                for i, t in enumerate(texts):
                    c, w = sums.setdefault(lang[at + i], (np.zeros(N_CLASSES, np.int64), np.zeros(len(number) + 1, np.int64)))
                    c += character_histogram(t)
                    w += word_histogram(t.split(), number)
        rows = [(l, k, b, int(n)) for l, pair in sums.items() for k, h in enumerate(pair) for b, n in enumerate(h) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["lang", "kind", "bin", "n"])
    return run


def word_histogram(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    h = np.zeros(len(number) + 1, np.int64)
    for w, n in Counter(words).items():
        h[number.get(_bare(w), -1)] += n
    return h


def references(docs: DataFrame) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers of the common words, and the two reference histograms of each language (languages x bins, sums 1)."""
    known = slim(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull())
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # one row a language
    if not langs:
        return {}, np.zeros((0, N_CLASSES)), np.zeros((0, 1))
    counts = known.select("lang", "text").mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= COMMON).collect()  # COMMON words a language
    number = {w: i for i, w in enumerate(sorted({bytes(r["word"]) for r in top}))}
    sums = (known.select("lang", "text").mapInArrow(_histograms(number), "lang string, kind int, bin int, n long")
            .groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).collect())  # languages x bins
    chars, words = np.zeros((len(langs), N_CLASSES)), np.zeros((len(langs), len(number) + 1))
    for r in sums:
        (words if r["kind"] else chars)[langs.index(r["lang"]), r["bin"]] = r["n"]
    norm = lambda h: h / np.maximum(h.sum(axis=1, keepdims=True), 1)
    return number, norm(chars), norm(words)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a histogram from each row of ``q``."""
    p = np.broadcast_to(p / max(p.sum(), 1), q.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1)
        return np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))


def judge(docs: DataFrame, refs: tuple[dict[bytes, int], np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document: the plain counts, both distances from the nearest language, and the verdicts."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)  # languages x (classes + common words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        number, chars, words = shared.value
        for batch in batches:
            rows = []
            for _, texts in texts_of(batch):
                for t in texts:
                    n, wc, sy, dl, rw, ws = measures(t)
                    failed = n < LEAST_WORDS or 100 * rw > 50 * n
                    dc = dw = None
                    if len(chars) and n:
                        by_word = distance(word_histogram(ws, number), words)
                        near = int(by_word.argmin())
                        dw, dc = float(by_word[near]), float(distance(character_histogram(t), chars)[near])
                    rows.append((n, wc, sy, dl, rw, failed, dc, dw, not failed and (dc is None or dc <= CHARACTERS_APART and dw <= WORDS_APART)))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)]], names)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    return slim(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, references(docs))
