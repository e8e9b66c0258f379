"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact weighted shingles.

A window has the size of a benchmark item, in words.  One that reaches ``SIMILAR`` holds at least that share of the
item's shingles, so windows are laid at every start, and only there, where so many places of a document carry a shingle
of the item (``starts``); that leaves out no match.  Windows and items get 64-bit SimHash fingerprints of their words.  Fingerprints are cut into
``BLOCKS`` blocks; two that differ in at most ``BLOCKS - 1`` bits agree in at least one block (and are looked up by it,
together with the size), so every pair within that radius is found.  The pairs within the radius are then compared by
the exact similarity of their shingles, weighted by how often they occur.

Defined results: words are runs of non-space characters of the lower-cased text; a null text counts as empty.  Items of
fewer than five words have no shingle and match nothing.  At the ends of a document a window may be shorter than its
item.  Repeated rows are judged alike and reported once for equal ids and texts; null ids are kept.  Equal items are
all reported.  Long texts are taken whole; of windows that are equally similar the first is reported.  Without documents
or items there is no match.  Further columns are ignored, and kept by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, named, slim, spare, text_key

K = 5
SIMILAR = 0.8
BLOCKS = 16
WIDTH = 64 // BLOCKS
#: Places of shingles in items (some 20 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
_SPACE = r"[\x20\x09-\x0D]+"


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: what lambdas read again and again must not be an expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _hashed(df: DataFrame) -> DataFrame:
    """Replace ``text`` by ``words``, the hashes of its words, and ``shingles``, those of its windows of K words."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    # the pieces before the first and behind the last space are empty
    pieces = F.split(text, _SPACE)
    df = _held(df, "words", F.transform(F.slice(pieces, 2, F.size(pieces) - 2), lambda w: F.xxhash64(w))).drop("text")
    n = F.size("words")
    windows = F.when(n >= K, F.transform(F.slice("words", 1, F.greatest(n - (K - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("words", i + k) for k in range(1, K)])))
    return _held(df, "shingles", F.coalesce(windows, F.array().cast("array<bigint>")))


def _adds_bit(b: int):
    return lambda total, h: total + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1))


def fingerprint(words: Column) -> Column:
    """64-bit SimHash: each bit as in most of the words' hashes."""
    bits = []
    for b in range(64):
        ones = F.aggregate(words, F.lit(0).cast("long"), _adds_bit(b))
        bits.append(F.when(ones * 2 > F.size(words), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _blocks(df: DataFrame) -> DataFrame:
    cells = F.array(*[F.shiftrightunsigned("print", WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)) for k in range(BLOCKS)])
    return df.select("*", F.posexplode(cells).alias("block", "value"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of all shingles of two arrays."""
    every = F.array_distinct(F.concat(a, b))
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    both = F.aggregate(every, F.lit(0), lambda t, s: t + F.least(count(a, s), count(b, s)))
    return both / (F.size(a) + F.size(b) - both)


def indexed(benchmark: DataFrame) -> DataFrame:
    """Items: item_id, size, words, shingles and fingerprint."""
    items = _hashed(slim(benchmark, "item_id", "text")).where(F.size("shingles") > 0)
    return cut(items.select("item_id", F.size("words").alias("size"), "shingles", fingerprint(F.col("words")).alias("print")))


def starts(places: Column, shingles: Column, held: Column) -> Column:
    """Where windows can reach ``SIMILAR``, given the ``places`` (ascending) of a document that carry one of an item's
    ``shingles`` (their number), in a document of ``held`` places.

    A window's common part is at most its number of such places.  With c in common of m and at most m places it needs
    c >= SIMILAR * m, so ``need`` of them lie within m places; a window cut short by the end of the document has fewer
    places of its own, which the second test takes into account.
    """
    need = F.ceil(shingles * SIMILAR - 1e-9).cast("int")
    firsts = F.slice(places, 1, F.greatest(F.size(places) - need + 1, F.lit(0)))
    spans = F.transform(firsts, lambda p, i: F.when(
        F.get(places, i + need - 1) - p < shingles, F.sequence(F.greatest(F.get(places, i + need - 1) - shingles + 1, F.lit(0)), p)))
    every = F.array_distinct(F.flatten(F.filter(spans, lambda x: x.isNotNull())))
    inside = lambda s: F.size(F.filter(places, lambda p: (p >= s) & (p < s + shingles)))
    share = SIMILAR / (1 + SIMILAR)
    return F.filter(every, lambda s: inside(s) >= (shingles + F.least(shingles, held - s)) * share - 1e-9)


def windows(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Windows of a document that can be similar to an item: (doc_id, key, start, size, words)."""
    marks = items.select(F.xxhash64("size", "shingles").alias("item"), "size", F.size("shingles").alias("m"), F.explode("shingles").alias("shingle")).distinct()
    marks = cut(marks)
    marks = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    rows = _hashed(slim(docs, "doc_id", "text").withColumn("key", text_key()))
    # shingles travel without their texts; all places of a document are in one task, which brings them together first
    hit = rows.select("doc_id", "key", F.size("shingles").alias("held"), F.posexplode("shingles").alias("place", "shingle")).join(marks, "shingle")
    near = hit.groupBy("doc_id", "key", "item").agg(F.first("size").alias("size"), F.first("m").alias("m"), F.first("held").alias("held"), F.sort_array(F.collect_set("place")).alias("places"))
    near = near.where(F.size("places") >= F.col("m") * SIMILAR - 1e-9)
    found = cut(near.select("doc_id", "key", "size", F.explode(starts(F.col("places"), F.col("m"), F.col("held"))).alias("start")).distinct())
    own = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    own = F.broadcast(own) if own.count() <= broadcast_rows else own
    texts = slim(docs, "doc_id", "text").withColumn("key", text_key()).join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    texts = _hashed(texts.dropDuplicates(["doc_id", "key"])).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "words")
    laid = found.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return cut(laid.select("doc_id", "key", "start", "size", F.slice("words", F.col("start") + 1, F.col("size")).alias("words")))


def matches(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, item_id, similarity, start, size): a document and an item with their best window; the first of equal ones."""
    items = indexed(benchmark)
    laid = windows(docs, items, broadcast_rows)
    # equal windows (of copies) are compared once
    content = laid.select("size", "words").distinct()
    n = F.size("words")
    shingles = F.when(n >= K, F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(K)])))
    prints = cut(content.select("size", "words", fingerprint(F.col("words")).alias("print"), shingles.alias("own")).where("own is not null").withColumn("window", F.xxhash64("words")))
    left = _blocks(prints.select("window", "size", "print"))
    right = _blocks(items.select("item_id", F.col("size").alias("item_size"), "print")).withColumnRenamed("print", "item_print")
    near = left.join(right, (left["size"] == right["item_size"]) & (left["block"] == right["block"]) & (left["value"] == right["value"]))
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) < BLOCKS).select("window", "size", "item_id").distinct()
    pairs = near.join(prints.select("window", "size", "own", "words"), ["window", "size"]).join(items.select("item_id", "size", "shingles"), ["item_id", "size"])
    pairs = cut(pairs.select("item_id", "size", "words", weighted_similarity(F.col("own"), F.col("shingles")).alias("similarity")).where(F.col("similarity") >= SIMILAR).distinct())
    found = laid.join(pairs, ["size", "words"])
    best = F.max_by(F.struct("similarity", "start", "size"), F.struct("similarity", -F.col("start"), "size")).alias("best")
    return found.groupBy("doc_id", "key", "item_id").agg(best).select("doc_id", "key", "item_id", "best.similarity", "best.start", "best.size")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark item was found."""
    own, bad_id, bad_key = (spare(docs, c) for c in ("text_key", "bad_id", "bad_key"))
    bad = cut(matches(docs, benchmark).select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct())
    kept = docs.withColumn(own, text_key()).join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_key)), "left_anti")
    return kept.select(*named(docs))


def op2(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, benchmark).select("doc_id", "item_id", "similarity", F.col("start").alias("first_word"), F.col("size").alias("n_words"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
