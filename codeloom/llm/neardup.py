"""Near-duplicates by Order MinHash with verification by banded alignment.

Equal texts are one text from the start.  Every text gets sketches (``omh.sketches``: the smallest few 5-word k-mers
under a random order, labelled with the number of their occurrence and kept in the order of the text, so that both
content and order count); a text with repeated k-mers gets them once more from its different k-mers.  Texts with an
equal sketch share a bucket.

Every bucket, whatever its size, goes the same way.  First all its texts are compared with its leader, the text whose
sketches are the most frequent (of copies with changes, that is the one they stem from): as many pairs as texts.  Texts
of buckets that are then still in several classes meet in an exact join: two texts of different classes are compared if
they share one of the rarest k-mers that a pair of ``SIMILAR`` must share (prefix filter, for sequences with repeats and
for sets, in one order).  Of two classes that meet, one pair is compared first; while that joins classes, it is done again, and only
classes that are still apart then have all their pairs compared that pass the filter.  So no class is cut, and a large
class never meets itself.

A pair is a link where the banded alignment of the k-mer sequences, or the exact overlap of the k-mer sets, reaches
``SIMILAR``.  Classes are the connected components of the links, found by label propagation on tables.

Defined results: words are lower-case (A-Z) runs of non-space bytes; null texts count as empty, and texts without
words only equal texts that are the same; texts under five words are one k-mer; long texts are taken whole.  Null ids
are kept: a class of rows without any id has a null class_id.  Repeated rows are equal texts; each counts in
``class_size``.  Without documents there is no row.  Further columns are ignored by the search and kept by ``keep_one``,
whatever their names; of a class it keeps the smallest id (of equal ids the smallest text key).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import omh
from codeloom.llm.common import cut, named, slim, spare, text_key, texts_of
from codeloom.session import release

SIMILAR = 0.8
#: Keys of texts (16 bytes each) up to which they are broadcast to the texts; beyond, the texts are shuffled to them.
BROADCAST_KEYS = 500_000
#: Turns of one pair for every two classes that meet; what they leave apart is compared in full.
TURNS = 2


def _sketched(batches):
    """(key, doc_id, n, kinds, sketches) of each row: the number of k-mers, and of different ones."""
    for batch in batches:
        n, kinds, all_sketches = [], [], []
        for _, texts in texts_of(batch):
            for t in texts:
                grams = omh.kmers(t.lower().split())
                _, first = np.unique(grams, return_index=True)
                n.append(len(grams))
                kinds.append(len(first))
                own = omh.sketches(grams)
                if len(first) < len(grams):  # once more without repeats, for links of the sets
                    own += [y if x != y else None for x, y in zip(own, omh.sketches(grams[np.sort(first)]), strict=True)]
                all_sketches.append(own)
        yield pa.RecordBatch.from_arrays([
            batch.column("key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kinds, pa.int64()), pa.array(all_sketches, pa.list_(pa.int64()))],
            ["key", "doc_id", "n", "kinds", "sketches"])


def sketch_rows(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = slim(docs, "doc_id", "text").withColumn("key", text_key())
    return cut(rows.mapInArrow(_sketched, f"key binary, doc_id {kind}, n long, kinds long, sketches array<long>"))


def bucketed(texts: DataFrame) -> DataFrame:
    """Members of the buckets of several texts: key, n, kinds, bucket, size."""
    rows = texts.select("key", "n", "kinds", F.posexplode("sketches").alias("i", "value")).where("value IS NOT NULL").select(
        "key", "n", "kinds", F.xxhash64(F.col("i") % omh.SKETCHES, "value").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return cut(rows.join(sizes, "bucket"))


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a member and the leader of its bucket that are near enough in length."""
    popular = members.groupBy("key").agg(F.sum("size").alias("popularity"))
    top = F.max(F.struct("popularity", "key", "n", "kinds")).alias("top")
    leaders = members.join(popular, "key").groupBy("bucket").agg(top).select(
        "bucket", F.col("top.key").alias("leader"), F.col("top.n").alias("leader_n"), F.col("top.kinds").alias("leader_kinds"))

    def near(x: str, y: str) -> Column:
        return F.least(x, y) >= SIMILAR * F.greatest(x, y)

    # a link is one of the sequences or one of the sets
    pairs = members.join(leaders, "bucket").where((F.col("leader") != F.col("key")) & (near("n", "leader_n") | near("kinds", "leader_kinds")))
    return pairs.select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct()


def _gram_rows(batches):
    """A row of each text: its labelled k-mers, the different ones first; ``kinds`` of these."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        for at, texts in texts_of(batch, size=100):
            key, n, kinds, all_grams = [], [], [], []
            for k, t in enumerate(texts):
                grams = omh.kmers(t.lower().split())
                if len(grams):
                    different = np.unique(grams)
                    more = omh.labelled(grams)
                    more = more[~np.isin(more, different)] if len(different) < len(grams) else more[:0]
                    key.append(keys[at + k])
                    n.append(len(grams))
                    kinds.append(len(different))
                    all_grams.append(np.concatenate([different, more]).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(kinds, pa.int64()), pa.array(all_grams, pa.list_(pa.int64()))],
                ["key", "n", "kinds", "grams"])


def _needed(n: Column, share: float) -> Column:
    """The least whole number from ``share`` of n on; an exact product stays what it is."""
    return F.ceil(n * share - 1e-9)


PAIR_SHARE = 2 * SIMILAR / (1 + SIMILAR)


def rare_rows(texts: DataFrame) -> DataFrame:
    """(gram, key, n, place, kinds, rank): the k-mers by which texts (key, text) can meet, in one order of all, rarest first.

    ``n`` and ``place`` are of the sequence with its repeats, ``kinds`` and ``rank`` of the set (null for a repeat).  Two
    texts of n <= m k-mers with enough in common (c of them) have their first common one among the first n - c + 1 and
    m - c + 1, of sequences and of sets alike.
    """
    grams = texts.mapInArrow(_gram_rows, "key binary, n long, kinds long, grams array<long>").select(
        "key", "n", "kinds", F.posexplode("grams").alias("i", "gram"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = Window.partitionBy("key").orderBy("df", "gram")
    # k-mers of one text only come first in every order and never meet another text: their number is all that counts
    held = grams.join(df, "gram").select("key", "n", "kinds", "gram", "df", (F.col("i") < F.col("kinds")).alias("first"))
    sizes = Window.partitionBy("key")
    held = held.withColumn("place", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(sizes))
    held = held.withColumn("rank", F.when(F.col("first"), F.count_if(F.col("first")).over(order) + F.col("kinds") - F.count_if(F.col("first")).over(sizes)))
    return cut(held.where(_within("n", "place", SIMILAR) | _within("kinds", "rank", SIMILAR)).select("gram", "key", "n", "place", "kinds", "rank"))


def _within(n: str, place: str, share: float) -> Column:
    return F.coalesce(F.col(place) <= F.col(n) - _needed(F.col(n), share) + 1, F.lit(False))


def _near(least_a: str, most_a: str, place_a: str, least_b: str, most_b: str, place_b: str) -> Column:
    """Whether texts of so many k-mers can be similar whose first common one stands at these places."""
    la, ma, lb, mb = (F.col(c) for c in (least_a, most_a, least_b, most_b))
    half = PAIR_SHARE / 2
    return F.coalesce((la <= mb) & (ma >= _needed(lb, SIMILAR)) & (F.col(place_a) <= ma * (1 - half) - lb * half + 1 + 1e-9)
                      & (F.col(place_b) <= mb * (1 - half) - la * half + 1 + 1e-9), F.lit(False))


#: The sequence's and the set's columns of size and place.
VIEWS = (("n", "place"), ("kinds", "rank"))


def _meetings(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes that meet at a k-mer, with a member of each; and the rows of shorter and of longer texts with their class."""
    held = rows.join(roots, "key")
    # of a pair, the shorter text (of equal ones the smaller key) has fewer places
    short = held.where(_within("n", "place", PAIR_SHARE) | _within("kinds", "rank", PAIR_SHARE))

    def groups(side: DataFrame, name: str) -> DataFrame:
        spans = [f(c).alias(f"{kind}_{c}_{name}") for n, place in VIEWS for f, kind, c in ((F.min, "least", n), (F.max, "most", n), (F.min, "first", place))]
        return side.groupBy("gram", F.col("root").alias(f"root_{name}")).agg(*spans, F.min(F.struct("place", "key")).alias(f"pick_{name}"))

    near = [_near(f"least_{n}_a", f"most_{n}_a", f"first_{p}_a", f"least_{n}_b", f"most_{n}_b", f"first_{p}_b") for n, p in VIEWS]
    met = groups(short, "a").join(groups(held, "b"), "gram").where((F.col("root_a") != F.col("root_b")) & (near[0] | near[1]))
    return met, short, held


def witnesses(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """One pair (a, b), a < b, for every two classes that meet: where the shared k-mer stands first."""
    met, _, _ = _meetings(rows, roots)
    a, b = F.col("pick_a.key"), F.col("pick_b.key")
    first = F.min(F.struct((F.col("first_place_a") + F.col("first_place_b")).alias("at"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))).alias("w")
    return met.groupBy(F.least("root_a", "root_b").alias("r"), F.greatest("root_a", "root_b").alias("s")).agg(first).select("w.a", "w.b").distinct()


def rare_pairs(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts of different classes (key, root); none of ``SIMILAR`` is left out.

    Tokens first pair classes and then their members, so that a large class does not meet itself.
    """
    met, short, held = _meetings(rows, roots)
    met = met.select("gram", "root_a", "root_b")
    columns = ("root", "key", *[c for view in VIEWS for c in view])
    sides = [side.select("gram", *[F.col(c).alias(f"{c}_{name}") for c in columns]) for side, name in ((short, "a"), (held, "b"))]
    both = met.join(sides[0], ["gram", "root_a"]).join(sides[1], ["gram", "root_b"])
    near = [_near(f"{n}_a", f"{n}_a", f"{p}_a", f"{n}_b", f"{n}_b", f"{p}_b") & ((F.col(f"{n}_a") < F.col(f"{n}_b")) | (F.col("key_a") < F.col("key_b"))) for n, p in VIEWS]
    return both.where(near[0] | near[1]).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Keys of the texts of buckets whose members are in several classes (a bucket of two texts was compared in full)."""
    own = members.where("size > 2").select("bucket", "key").join(roots, "key")
    open_ = own.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where(F.col("least") != F.col("most"))
    return cut(own.join(open_, "bucket", "left_semi").select("key").distinct())


def _verified(batches):
    for batch in batches:
        a, b = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
        share = []
        for x, y in zip(a, b, strict=True):
            p, q = x.as_py().lower().split(), y.as_py().lower().split()
            s = omh.similarity(p, q, SIMILAR)
            if not s and (j := omh.jaccard(p, q)) >= SIMILAR:
                s = j
            share.append(s)
        kept = pa.array([s > 0 for s in share], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share, pa.float64())], ["a", "b", "similarity"]).filter(kept)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys (distinct, a written table)."""
    keys = wanted.select("key")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = slim(docs, "text").withColumn("key", text_key()).join(keys, "key", "left_semi").dropDuplicates(["key"])
    return cut(texts.select("key", F.coalesce("text", F.lit("")).alias("text")))


def links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of texts (key, text) that are similar enough: (a, b, similarity)."""
    both = (pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b"))
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a binary, b binary, similarity double"))


def components(linked: DataFrame) -> DataFrame:
    """(key, root): the smallest key that links lead to.

    Each round takes the smallest label among the neighbours' and then the label's own label, so that the rounds grow
    with the logarithm of a chain's length; the labels are written as a table each time.
    """
    edges = cut(linked.select(F.col("a").alias("key"), F.col("b").alias("other")).union(linked.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(edges.groupBy("key").agg(F.min("other").alias("least")).select("key", F.least("key", "least").alias("root")))
    last: DataFrame | None = None
    while True:
        heard = edges.join(labels.select(F.col("key").alias("other"), "root"), "other").groupBy("key").agg(F.min("root").alias("heard"))
        near = labels.join(heard, "key").select("key", F.least("root", "heard").alias("next"), F.col("root").alias("before"))
        jump = labels.select(F.col("key").alias("next"), F.col("root").alias("beyond"))
        now = cut(near.join(jump, "next", "left").select("key", F.least("next", F.coalesce("beyond", "next")).alias("root"), "before"))
        before, labels, last = last, now.select("key", "root"), now
        if before is not None:
            release(before)
        if not now.where(F.col("root") != F.col("before")).limit(1).count():
            release(edges)
            labels._written_to = now._written_to
            return labels


def merged(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, root) with the classes joined that the links lead between; only classes take part, not their members."""
    ends = linked.select("a", "b").join(roots.select(F.col("key").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("key").alias("b"), F.col("root").alias("y")), "b")
    between = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    labels = components(between)
    further = labels.select(F.col("key").alias("root"), F.col("root").alias("to"))
    out = cut(roots.join(further, "root", "left").select("key", F.coalesce("to", "root").alias("root")))
    release(labels)
    return out


def compared(bodies: DataFrame, roots: DataFrame, pairs: DataFrame) -> tuple[DataFrame, bool]:
    """``merged`` by the links among the pairs, and whether there are any; what was written on the way is deleted."""
    pairs = cut(pairs)
    found = links(bodies, pairs)
    some = found.limit(1).count() > 0
    out = merged(roots, found) if some else roots
    for table in (pairs, found, *([roots] if some else [])):
        release(table)
    return out, some


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id) of the documents, and texts (key, root, class_id, kept_key, class_size)."""
    rows = sketch_rows(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    texts = cut(rows.groupBy("key").agg(first, F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("kinds").alias("kinds"), F.max("sketches").alias("sketches")))
    members = bucketed(texts)
    roots = cut(members.select("key").distinct().withColumn("root", F.col("key")))
    bodies = _texts(docs, roots)
    roots, _ = compared(bodies, roots, candidates(members))
    rest = unsettled(members, roots)
    release(members)
    if rest.limit(1).count():
        rare = rare_rows(bodies.join(rest, "key", "left_semi"))
        some, turns = True, 0
        while some and turns < TURNS:
            roots, some = compared(bodies, roots, witnesses(rare, roots))
            turns += 1
        roots, _ = compared(bodies, roots, rare_pairs(rare, roots))
        release(rare)
    release(bodies)
    own = cut(texts.select("key", "first", "copies").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first", "copies"))
    release(texts)
    best = own.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id", "key")).alias("best"), F.sum("copies").alias("class_size"))
    return rows.select("key", "doc_id"), own.join(best, "root").select(
        "key", "root", F.col("best.doc_id").alias("class_id"), F.col("best.key").alias("kept_key"), "class_size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of the class) and class_size (documents of the class)."""
    rows, texts = classes(docs)
    return rows.join(texts.select("key", "class_id", "class_size"), "key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each class: the one with the smallest doc_id (null last, then by text)."""
    _, texts = classes(docs)
    own, kept_id, kept_key = (spare(docs, c) for c in ("text_key", "kept_id", "kept_key"))
    kept = texts.where(F.col("key") == F.col("kept_key")).select(F.col("key").alias(kept_key), F.col("class_id").alias(kept_id))
    held = docs.withColumn(own, text_key()).join(kept, (F.col(own) == F.col(kept_key)) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return held.dropDuplicates(["doc_id", own]).select(*named(docs))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
