"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding look-alike letters and digits.

``fold`` lower-cases, maps homoglyphs and digit substitutions inside words to plain letters and everything that is
no letter to one space.  The lexicon is learned from labelled texts: whole words, and beginnings of words of
``STEM`` letters, get the logarithm of how much more often toxic texts hold them than others.  An entry needs a
share of the toxic texts (``SUPPORT``) and a minimum weight.  Exception phrases are the words that begin
like a stem but that harmless texts hold more often than toxic ones, and those of the caller.  A match that lies
inside an exception phrase does not count.  The score is 1 - exp(-S / N), S the sum of weights of all matches, N growing with the logarithm of
the number of words, so that long texts need more.

Defined results: null and empty texts score 0; rows without a label (or outside ``train``) are not learned from;
without any toxic label every score is 0.  A row is judged by its own text alone, repeated rows alike; one row per input
row, none for an empty table.  Long texts are matched whole.  ``keep_harmless`` keeps further columns, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import column, cut, remainder, slim, texts_of, text_key

#: Labelled texts of either class that are learned from, on average (a bounded sample by the hash of the id).
TRAIN_DOCS = 10_000
STEM = (4, 5, 6, 7, 8)
SUPPORT = 0.015
LEAST_DOCS = 3
LEAST_WEIGHT = math.log(30)
LIMIT = 0.7
#: Words after which the length begins to count.
FREE_WORDS = 200
#: Longest word that can be an entry, in letters.
LONGEST = 40
#: Distinct entries that a task counts before it passes its counts on.
HELD = 300_000

# Letters and digits that stand for plain letters.
LOOK_ALIKE = {
    "а": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ԁ": "d", "е": "e", "ε": "e", "ѕ": "s", "і": "i", "ι": "i",
    "ј": "j", "к": "k", "κ": "k", "м": "m", "н": "h", "о": "o", "ο": "o", "р": "p", "ρ": "p", "т": "t", "τ": "t",
    "υ": "u", "у": "y", "х": "x", "χ": "x", "ν": "v", "ԛ": "q", "ԝ": "w", "ı": "i", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
}


class _Folding(dict):
    """str.translate table, filled as characters occur."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        low = x.lower()
        if low in LOOK_ALIKE:
            y = LOOK_ALIKE[low]
        elif 0xFF01 <= c <= 0xFF5E:  # full-width forms
            y = self[c - 0xFEE0]
        elif x.isalpha():
            y = low[0]
        else:
            y = " "
        if len(self) < 20_000:
            self[c] = y
        return y


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Words of folded letters, one space before, between and behind them.

    Digits and signs fold only between letters of a word or at its beginning; a word without letters goes.
    """
    words = []
    for word in text.split():
        if word.isascii() and word.isalpha():
            words.append(word.lower())
            continue
        core = word.strip("!.,;:?\"'()[]{}")
        if any(map(str.isalpha, core)):
            words.append(core.translate(_FOLDING))
    return f" {' '.join(' '.join(words).split())} "


def _entries(words: set[str]) -> set[str]:
    """Whole words as ' word ', beginnings as ' begin'."""
    out = {f" {w} " for w in words if len(w) <= LONGEST}
    for n in STEM:
        out |= {" " + w[:n] for w in words if len(w) >= n}
    return out


def _counts(batches):
    held: Counter = Counter()

    def batch_of(held):
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()),
            pa.array(list(held.values()), pa.int64())], ["entry", "toxic", "n"])
    for batch in batches:
        toxic = column(batch, "toxic")
        for at, texts in texts_of(batch):
            for i, text in enumerate(texts):
                t = toxic[at + i]
                held.update((e, t) for e in _entries(set(fold(text.decode("utf-8", "replace")).split())))
                if len(held) > HELD:
                    yield batch_of(held)
                    held = Counter()
    yield batch_of(held)


def learn(docs: DataFrame, labels: DataFrame, where: Column, train_docs: int = TRAIN_DOCS) -> tuple[dict[str, float], list[str]]:
    """Weights of entries and exception words, from rows for which ``where`` holds.

    Equal texts, and near copies with the same smallest hash of three words, are counted once for each label.  The driver gets the entries that pass the thresholds: each needs a
    share of ``SUPPORT`` of the toxic texts, so their number is bounded by the words of 1 / SUPPORT texts.
    """
    marked = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(where & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    found = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not found.get(1):
        return {}, []
    million = 1_000_000
    share = {t: min(million, -(-train_docs * million // n)) for t, n in found.items()}
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(million)) < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share.get(0, 0)))
    # about 2 * train_docs ids: a bounded broadcast, so that no text is shuffled to meet its label
    texts = slim(docs, "doc_id", "text").join(F.broadcast(marked.where(taken)), "doc_id").select("text", "toxic")
    # near copies often share their smallest hash of three words: one text stands for them, so that no word counts as often as it is copied
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    triples = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"), F.slice(words, 3, F.size(words)).alias("c"))
    texts = cut(texts.withColumn("key", F.array_min(F.transform(triples, lambda t: F.xxhash64(t)))).withColumn("first", text_key()))
    chosen = cut(texts.groupBy("key", "toxic").agg(F.min("first").alias("first")))
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = texts.join(chosen.select("first", "toxic"), ["first", "toxic"]).dropDuplicates(["first", "toxic"]).select("text", "toxic")
    n1, n0 = sizes.get(1, 0), max(1, sizes.get(0, 0))
    weight = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    table = (
        sample.mapInArrow(_counts, "entry string, toxic int, n long")
        .groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"),
                              F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
        .withColumn("weight", weight)
    )
    table = cut(table)
    found = table.where((F.col("pos") >= max(LEAST_DOCS, SUPPORT * n1)) & (F.col("weight") >= LEAST_WEIGHT)).collect()
    weights = {r["entry"]: r["weight"] for r in found}
    docs_of = {r["entry"]: r["pos"] for r in found}
    lexicon = _pruned(weights, docs_of)
    stems = [e for e in lexicon if not e.endswith(" ")]
    spared: list = []
    if stems:
        # words of the sample that begin like an entry; an entry has few texts without the label, so these are few
        begins = F.lit(False)
        for e in stems:
            begins = begins | F.col("entry").startswith(e)
        spared = table.where(F.col("entry").endswith(" ") & begins & (F.col("neg") / n0 > F.col("pos") / n1) & (F.col("neg") > 1)).select("entry").collect()
    return lexicon, sorted(r["entry"].strip() for r in spared)


def _pruned(weights: dict[str, float], docs_of: dict[str, int]) -> dict[str, float]:
    """A beginning goes where a longer, purer entry has nearly all its texts; then what is longer than another entry goes."""
    ordered = sorted(weights)
    worse = set()
    for i, e in enumerate(ordered):
        for f in ordered[i + 1:]:
            if not f.startswith(e):
                break
            if docs_of[f] >= 0.9 * docs_of[e] and weights[f] > weights[e]:
                worse.add(e)
                break
    kept: dict[str, float] = {}
    last = None
    for e in ordered:
        if e in worse:
            continue
        if last is None or not e.startswith(last):
            kept[e] = weights[e]
            last = e
    return kept


def _automaton(weights: dict[str, float], exceptions: list[str]):
    a = ahocorasick.Automaton()
    for e, w in weights.items():
        a.add_word(e, (e, w))
    for e in exceptions:
        if (folded := fold(e)).strip():
            a.add_word(folded, (folded, None))
    if len(a):
        a.make_automaton()
    return a


def rate(text: str, automaton) -> float:
    folded = fold(text)
    if not len(automaton) or folded == "  ":
        return 0.0
    hits, spared = [], []
    for end, (e, w) in automaton.iter(folded):
        (spared if w is None else hits).append((end - len(e) + 1, end, w))
    total = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y, _ in spared))
    words = folded.count(" ") - 1
    return 1 - math.exp(-total / (2.5 * (1 + math.log1p(words / FREE_WORDS) / 4)))


def _scorer(spark, lexicon):
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by the thresholds of learn

    def scores(batch):
        automaton = _automaton(*shared.value)
        return [rate(t.decode("utf-8", "replace"), automaton) for _, texts in texts_of(batch) for t in texts]
    return scores


def score(docs: DataFrame, lexicon: tuple[dict[str, float], list[str]]) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    scores = _scorer(docs.sparkSession, lexicon)

    def run(batches):
        for batch in batches:
            s = scores(batch)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(s, pa.float64()), pa.array([int(x >= LIMIT) for x in s], pa.int32())], ["doc_id", "score", "predicted"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_harmless(docs: DataFrame, lexicon: tuple[dict[str, float], list[str]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``LIMIT``."""
    scores = _scorer(docs.sparkSession, lexicon)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([x < LIMIT for x in scores(batch)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def learned_rows() -> Column:
    return remainder("doc_id", 3) != 1


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, learn(docs, labels, learned_rows()))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_harmless(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learned_rows()))
