"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with one space for everything else.  All 1-, 2- and 3-grams are hashed to
``2**BITS`` columns.  Counting and scoring run in tasks as numpy batches in CSR form (indices and row starts); the
driver only ever holds the matrix of log-probabilities, languages x columns, which is broadcast.

Defined results: a text that is null or has no letter gets ``und`` and score 0; rows with a null language, or
outside ``train``, are not learned from; without any learned language all rows get ``und``.  Ties go to the
language that sorts first.  Repeated rows are scored alike; the result has one row per input row, none for an empty
table.  Long texts are counted and scored whole.  ``keep_identified`` keeps further columns, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import column, remainder, slim, texts_of

BITS = 14
ORDERS = 3
#: Documents per language that are learned from, on average (a bounded sample by the hash of the id).
TRAIN_DOCS = 4000
#: n-grams after which more text does not raise the confidence.
EVIDENCE = 60
#: Code points handled at once in a task.
CHUNK = 400_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            table[c] = ord(s.lower()[0])
    return table


def rows_of_grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, starts of the rows, hashed n-grams) of a part of the texts, again and again.

    Long texts come in several parts; the n-grams across the parts' borders are in exactly one of them.
    """
    table, mask = _letters(), np.uint32((1 << BITS) - 1)
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush():
        lengths = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        a = np.concatenate([*parts, np.full(2, 32, np.uint32)])
        first, second, third = a[:-2] * np.uint32(0x9E3779B1), a[1:-1] * np.uint32(0x85EBCA6B), a[2:] * np.uint32(0xC2B2AE35)
        grams = np.empty((len(first), ORDERS), np.uint32)
        x = first
        for k, more in enumerate((None, second, third)):
            if more is not None:
                x = (x ^ (more + np.uint32(k))) * np.uint32(0x27D4EB2F)
            grams[:, k] = (x ^ (x >> np.uint32(15))) >> np.uint32(5) & mask
        # the last two places of a part only end n-grams that start before them
        ends = starts + lengths
        grams[np.concatenate([ends - 1, ends - 2])] = 1 << BITS
        return np.array(rows), starts * ORDERS, grams.ravel()

    for row, text in enumerate(texts):
        a = table[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        if not len(a) or not (a != 32).any():
            continue
        a = np.concatenate([[32], a, [32, 32]]).astype(np.uint32)
        a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
        a = np.concatenate([a, [32]]).astype(np.uint32)
        for at in range(0, max(1, len(a) - 2), CHUNK):
            part = a[at:at + CHUNK + 2]
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= CHUNK:
                yield flush()
                rows, parts, held = [], [], 0
    if parts:
        yield flush()


def _counts(langs: list[str]):
    number = {l: i for i, l in enumerate(langs)}

    def run(batches):
        total = np.zeros((len(langs), (1 << BITS) + 1), np.int64)
        for batch in batches:
            lang = column(batch, "lang")
            for at, texts in texts_of(batch):
                for rows, starts, grams in rows_of_grams(texts):
                    for row, a, b in zip(rows, starts, [*starts[1:], len(grams)], strict=True):
                        total[number[lang[at + row]]] += np.bincount(grams[a:b], minlength=(1 << BITS) + 1)
        l, k = np.nonzero(total[:, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), pa.array(k, pa.int32()), pa.array(total[l, k], pa.int64())], ["l", "k", "n"])
    return run


def train(docs: DataFrame, where: Column, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities (languages x columns, float32).

    Learns from about ``train_docs`` documents a language, taken by the hash of their ids.
    """
    known = slim(docs, "doc_id", "text", "lang").where(where & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, (1 << BITS) + 1), np.float32)
    million = 1_000_000
    share = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(million, -(-train_docs * million // sizes[l]))))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share[F.col("lang")]).select("lang", "text")
    found = sample.mapInArrow(_counts(langs), "l int, k int, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    rows = found.toArrow()  # at most languages x columns
    counts = np.zeros((len(langs), 1 << BITS))
    counts[rows["l"].to_numpy(), rows["k"].to_numpy()] = rows["n"].to_numpy()
    p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))
    return langs, np.concatenate([np.log(p), np.zeros((len(langs), 1))], axis=1).astype(np.float32)


def classify(texts: list[bytes], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each text."""
    sums = np.zeros((len(langs), len(texts)))
    grams_of = np.zeros(len(texts))
    for rows, starts, grams in rows_of_grams(texts):
        for l in range(len(langs)):
            np.add.at(sums[l], rows, np.add.reduceat(logp[l][grams], starts))
        np.add.at(grams_of, rows, np.diff([*starts, len(grams)]) - 2 * ORDERS)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = sums.argmax(axis=0)
    # the average of a text's n-grams counts as often as there are n-grams, up to EVIDENCE of them
    mean = (sums - sums.max(axis=0)) * (np.minimum(1, EVIDENCE / np.maximum(grams_of, 1)))
    score = np.where(grams_of > 0, 1 / np.exp(mean).sum(axis=0), 0.0)
    return [langs[b] if g > 0 else UNKNOWN for b, g in zip(best, grams_of, strict=True)], score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at, texts in texts_of(batch):
                langs, score = classify(texts, *shared.value)
                ids = batch.column(batch.schema.get_field_index("doc_id")).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` with all their columns, without those that have no language or one below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            kept = []
            for _, texts in texts_of(batch):
                langs, score = classify(texts, *shared.value)
                kept += [l != UNKNOWN and s >= least for l, s in zip(langs, score, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def learned_rows() -> Column:
    """Rows that the registered query and the pipeline learn from."""
    return remainder("doc_id", 4) != 2


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs, learned_rows()))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, train(docs, learned_rows()))
