"""LM scoring: a log-bilinear model over word classes, trained on all training documents, scores all texts.

1. Words of the training documents are counted (a distributed count; its table stays in the shared folder).
2. Counts of counts give the number of occurrences from which at most ``HEAD`` words are common; these words, of
   bounded length, go to the driver and to all tasks.
3. The model (see ``bilinear``) is trained in rounds.  Each training document belongs to one round by its hash.  In a
   round every task starts from the same parameters, runs over its documents once, and the parameters are averaged by
   the tokens they have seen; sums by parameter are taken by Spark.
4. Scoring: a task knows the probabilities of common words.  Other words leave it as rows, one for each word and
   text, and meet their counts in a join; the sums of a text come together by the row's number.

Defined results: a null text is empty and consists of its end alone.  Without training documents the model is uniform
over its classes.  Words longer than ``LONGEST`` bytes are counted under a digest.  Repeated rows count and are scored
each by itself.  Long texts are scored whole.  An empty table has no result; words that are equally common are ordered by
their bytes.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import bilinear as lbl
from codeloom.llm.common import cut, remainder, slim, texts_of

#: Most words that every task holds, and the longest word that is kept as it is, in bytes.
HEAD, LONGEST = 200_000, 40
#: Shares of the training documents in the rounds.
ROUNDS = (0.1, 0.3, 0.6)
#: Distinct words that a task counts before it passes its counts on.
HELD = 150_000
#: Tokens that are scored at once.
CHUNK = 200_000
ALPHA = 0.1


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words; of bytes, split() parts at the six ASCII spaces only."""
    words = text.lower().split()
    if max(map(len, words), default=0) > LONGEST:
        # no word holds a space, so digests are never taken for words
        return [w if len(w) <= LONGEST else b" " + hashlib.sha256(w).digest() for w in words]
    return words


def _counted(batches):
    held: Counter = Counter()

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for _, texts in texts_of(batch):
            for t in texts:
                held.update(words_of(t))
                if len(held) > HELD:
                    yield batch_of(held)
                    held = Counter()
            held[b""] += len(texts)  # the ends
    yield batch_of(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens; the end is the empty word."""
    counted = docs.select("text").mapInArrow(_counted, "word binary, n long")
    return cut(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))


def common_words(counts: DataFrame, head: int = HEAD) -> dict[bytes, int]:
    """At most ``head`` of the most frequent words, all those above one number of occurrences."""
    step = 8
    level = F.floor(F.log2(F.col("n")) * step)
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()  # some hundred rows
    least, words = None, 0
    for r in levels:
        words += r["words"]
        if words > head:
            break
        least = r["level"]
    if least is None:
        return {}
    rows = counts.where((level >= least) & (F.length("word") <= LONGEST)).toArrow()
    return dict(sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0])))


def _class_of(own: list[bytes]) -> Column:
    """The class of ``word``, as ``bilinear.Classes`` has it, of words that are none of their own."""
    tail = F.expr(f"CASE WHEN length(word) > {lbl.SUFFIX} THEN substring(word, length(word) - {lbl.SUFFIX - 1}, {lbl.SUFFIX}) ELSE word END")
    return F.when(F.length("word") == 0, F.lit(lbl.END)).otherwise((F.crc32(tail) % lbl.OTHER + lbl.OWN).cast("int"))


def class_counts(counts: DataFrame, own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, discount and unknown words' share of each class."""
    spark = counts.sparkSession
    # own words: at most bilinear.OWN
    mine = spark.createDataFrame([(bytearray(w), i) for i, w in enumerate(own)], "word binary, own int")
    classed = counts.join(F.broadcast(mine), "word", "left").select("n", F.coalesce("own", _class_of(own)).alias("class"))
    rows = classed.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.sum((F.col("n") == 1).cast("long")).alias("once"),
                                        F.sum((F.col("n") == 2).cast("long")).alias("twice")).collect()  # a row a class
    tokens, discount, share = np.zeros(lbl.CLASSES), np.zeros(lbl.CLASSES), np.ones(lbl.CLASSES)
    for r in rows:
        c = r["class"]
        tokens[c] = r["n"]
        if lbl.OWN <= c < lbl.END:
            discount[c] = min(0.9, max(0.1, r["once"] / max(1, r["once"] + 2 * r["twice"])))
            share[c] = discount[c] * r["words"] / r["n"]
        else:
            share[c] = 0.0
    return tokens, discount, share


def _trained(model: lbl.Model, tokens: np.ndarray, own: list[bytes], round_no: int):
    start = model.flat()

    def run(batches):
        classes = lbl.Classes(own)
        trainer = lbl.Trainer(lbl.unflat(start), tokens, 1000 * round_no + TaskContext.get().partitionId())
        held: list[np.ndarray] = []
        n = 0

        def learn():
            w = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            one, two = lbl.contexts(w, starts)
            order = trainer.g.permutation(len(w))
            for at in range(0, len(w), lbl.BATCH):
                some = order[at:at + lbl.BATCH]
                trainer.step(one[some], two[some], w[some])
        for batch in batches:
            for _, texts in texts_of(batch, size=200):
                for t in texts:
                    held.append(classes.sequence(words_of(t)))
                    n += len(held[-1])
                    if n >= 16 * lbl.BATCH:
                        learn()
                        held, n = [], 0
        if held:
            learn()
        if trainer.tokens:
            x = trainer.m.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(x)), pa.int32()), pa.array(x * trainer.tokens), pa.array(np.full(len(x), float(trainer.tokens)))], ["i", "x", "n"])
    return run


def train(docs: DataFrame, counts: DataFrame, head: dict[bytes, int]) -> tuple[lbl.Model, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The model, the words that are classes of their own, and the classes' counts."""
    own = [w for w in head if w][:lbl.OWN]
    stats = class_counts(counts, own)
    model = lbl.initial(stats[0])
    at = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(1_000_000))
    low = 0.0
    for k, share in enumerate(ROUNDS):
        part = docs.where((at >= round(low * 1e6)) & (at < round((low + share) * 1e6))).select("text")
        low += share
        sums = part.mapInArrow(_trained(model, stats[0], own, k), "i int, x double, n double").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
        if len(sums):  # a row a parameter
            mean = np.empty(len(sums))
            mean[sums["i"].to_numpy()] = sums["x"].to_numpy() / sums["n"].to_numpy()
            model = lbl.unflat(mean)
    return model, own, stats


class _Places(dict):
    """Common word -> its place in the arrays of the head; any other word -> -1 - class, remembered up to a bound.

    The words that are classes of their own are all common.
    """

    def __init__(self, head: dict[bytes, int]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.bound = len(head) + lbl.Classes.BOUND

    def __missing__(self, word: bytes) -> int:
        x = -1 - lbl.Classes.by_suffix(word)
        if len(self) < self.bound:
            self[word] = x
        return x


def _scored(shared):
    def run(batches):
        head, own, model, (tokens, discount, share), total, types = shared.value
        classes, table = lbl.Classes(own), lbl.table(model, share)
        log_class = np.log10(np.maximum(tokens, lbl.TINY))
        class_at = np.fromiter((classes[w] if w else lbl.END for w in head), np.int64, len(head))
        counts = np.fromiter(head.values(), float, len(head))
        base = np.log10((counts + ALPHA) / (total + ALPHA * (types + 1)))
        alone = (class_at < lbl.OWN) | (class_at == lbl.END)
        inner = np.where(alone, 0.0, np.log10(np.maximum(counts - discount[class_at], lbl.TINY)) - log_class[class_at])
        places = _Places(head)
        end_known = b"" in head
        end = places[b""] if end_known else -1 - lbl.END
        number = (TaskContext.get().partitionId() << 40) - 1

        def rated(words: list[bytes], before: list[bytes], last: bool):
            """Places, and log10 probabilities of the classes and of the unknown word, of a part of a text."""
            at = np.fromiter(map(places.__getitem__, before + words), np.int64, len(before) + len(words))
            if last:
                at = np.append(at, end)
            w = np.where(at >= 0, class_at[np.maximum(at, 0)] if len(class_at) else 0, -1 - at)
            one, two = lbl.contexts(w, np.array([0]))
            skip = len(before)
            return at[skip:], w[skip:], *table.log(one[skip:], two[skip:], w[skip:])

        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("held_out")
            for at, texts in texts_of(batch, size=500):
                row, word, n_of, known_sum, unknown_sum, class_of, first, sums = [], [], [], [], [], [], [], []
                for t in texts:
                    number += 1
                    words = words_of(t)
                    sure = base_sum = 0.0
                    known = 0
                    rest: dict[bytes, list] = {}
                    for chunk in range(0, max(1, len(words)), CHUNK):
                        some = words[chunk:chunk + CHUNK]
                        last = chunk + CHUNK >= len(words)
                        place, w, p, unknown = rated(some, words[max(0, chunk - 2):chunk], last)
                        common = place >= 0
                        sure += float(p[common].sum() + inner[place[common]].sum())
                        base_sum += float(base[place[common]].sum())
                        known += int(common.sum())
                        for j in np.flatnonzero(~common).tolist():
                            v = some[j] if j < len(some) else b""
                            if (r := rest.get(v)) is None:
                                rest[v] = [1, p[j], unknown[j], w[j]]
                            else:
                                r[0] += 1
                                r[1] += p[j]
                                r[2] += unknown[j]
                    # the text's own sums go with its first rare word, or with a word that there is not
                    rest = rest or {b" " + number.to_bytes(8, "big"): [0, 0.0, 0.0, 0]}
                    first.append(len(row))
                    sums.append((len(words) + 1, known, base_sum, sure))
                    row += [number] * len(rest)
                    word += rest
                    for many, column in zip(zip(*rest.values(), strict=True), (n_of, known_sum, unknown_sum, class_of), strict=True):
                        column += many
                n, c = np.array(n_of), np.array(class_of)
                own_sums = np.zeros((len(row), 4))
                own_sums[first] = sums
                where = np.full(len(row), -1)
                where[first] = np.arange(at, at + len(texts))
                index = pa.array(where, pa.int64(), mask=where < 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int32()),
                    pa.array(np.array(known_sum) - n * log_class[c], pa.float32()), pa.array(np.array(unknown_sum), pa.float32()), pa.array(discount[c], pa.float32()),
                    ids.take(index), held.take(index), pa.array(own_sums[:, 0].astype(np.int64)), pa.array(own_sums[:, 1].astype(np.int64)),
                    pa.array(own_sums[:, 2]), pa.array(own_sums[:, 3])], NAMES)
    return run


NAMES = ["row", "word", "n", "as_known", "as_unknown", "discount", "doc_id", "held_out", "n_tokens", "known", "base", "sure"]


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where ``held_out`` is false."""
    spark = docs.sparkSession
    rows = slim(docs, "doc_id", "text").withColumn("held_out", held_out)
    training = rows.where(~F.col("held_out"))
    counts = word_counts(training)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words")).first()
    total, types = sums["n"], sums["words"]
    head = common_words(counts)
    model, own, stats = train(training, counts, head)
    shared = spark.sparkContext.broadcast((head, own, model, stats, total, types))  # HEAD words and the parameters
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, word binary, n int, as_known float, as_unknown float, discount float, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, sure double"
    pieces = rows.select("doc_id", "held_out", "text").mapInArrow(_scored(shared), schema)
    met = pieces.join(counts.withColumnRenamed("n", "c"), "word", "left")
    whole = float(total + ALPHA * (types + 1))
    is_known = F.col("c").isNotNull()
    base = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(ALPHA)) / F.lit(whole))
    model_score = F.when(is_known, F.col("as_known") + F.when(F.col("n") > 0, F.col("n") * F.log10(F.col("c") - F.col("discount"))).otherwise(0.0)).otherwise(F.col("as_unknown"))
    met = met.select("row", "doc_id", "held_out", "n_tokens", (F.col("known") + F.when(is_known, F.col("n")).otherwise(0)).alias("n_known"),
                     (F.col("base") + base).alias("base_score"), (F.col("sure") + model_score).alias("score"))
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("doc_id", 10) == 0)
