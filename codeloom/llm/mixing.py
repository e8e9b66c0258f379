"""Mixing sources to target weights by pivotal dependent rounding.

A source's target says how often, on average, each of its documents is taken; the whole part is certain, the rest is
a fractional copy.  Pivotal rounding takes two documents with fractional copies and moves words from one to the
other, in a random direction that keeps both expectations, until one of the two is whole.  The words taken from a
source so stay the same throughout; only the last document with a fraction, one for each source, is rounded alone.

Documents are numbered within their source by a distributed sort and cut into blocks of ``BLOCK``.  Each block is
folded by itself and leaves one document with a fraction; these form the blocks of the next level, and so on: a tree
whose levels are rows of a table, with no more than ``BLOCK`` rows in any group.

Defined results: a null text has size 0; a null source is a source of its own, the last one; documents of size 0 take
0 words; without any words all targets are 0.  Repeated rows are documents of their own.  Random numbers are hashes of
the source and the documents' places in the order (doc_id, size), so reruns agree; documents that tie there are alike for
the mix.  Long texts are taken whole; no text moves, only sizes do.  An empty table gives an empty mix.  ``mix`` keeps
further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, named, slim, spare, text_key
from codeloom.operators.skew import numbered

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 64
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, at most ``most`` times the source's own size.

    What a capped source leaves goes to the others by weight: target = min(level * weight, most * size), where the
    level is raised until all is given out.  Only the level and three sums travel to the driver.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sizes, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    sources = cut(sources.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * most))
    level, before = 0.0, -1.0
    while level != before:
        before = level
        full = F.col("weight") * F.lit(level) > F.col("most")
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("given"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        level = (float(r["all"]) - r["given"]) / r["open"]
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most")).alias("target"))


def _chance(*cols: Column) -> Column:
    """A number from 0 up to 1 out of a hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _fold(members: Column, source: Column) -> Column:
    """Fold a block: ``members`` are (place, size, part, id...); gives (left, done) with done the whole ones, ``part`` 0 or 1."""

    def step(state: Column, b: Column) -> Column:
        a = state["left"]
        into_a = F.least(a["size"] * (1 - a["part"]), b["size"] * b["part"])  # words that could move from b to a
        into_b = F.least(a["size"] * a["part"], b["size"] * (1 - b["part"]))
        up = _chance(source, a["place"], b["place"]) * (into_a + into_b) < into_b
        a_up, b_up = a["size"] * (1 - a["part"]) <= b["size"] * b["part"], a["size"] * a["part"] <= b["size"] * (1 - b["part"])
        # where ``up`` moves words to a: a becomes 1 or b becomes 0; else a becomes 0 or b becomes 1
        part_a = F.when(up, F.when(a_up, 1.0).otherwise(a["part"] + into_a / a["size"])).otherwise(
            F.when(b_up, 0.0).otherwise(a["part"] - into_b / a["size"]))
        part_b = F.when(up, F.when(a_up, b["part"] - into_a / b["size"]).otherwise(0.0)).otherwise(
            F.when(b_up, b["part"] + into_b / b["size"]).otherwise(1.0))
        a_done = F.when(up, a_up).otherwise(b_up)
        new_a, new_b = a.withField("part", part_a), b.withField("part", part_b)
        return F.struct(F.when(a_done, new_b).otherwise(new_a).alias("left"),
                        F.array_append(state["done"], F.when(a_done, new_a).otherwise(new_b)).alias("done"))
    first = F.element_at(members, 1)
    rest = F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0)))
    return F.aggregate(rest, F.struct(first.alias("left"), F.slice(members, 1, 0).alias("done")), step)


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and the columns of ``carry``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(slim(docs, "doc_id", "source", "text", *carry).withColumn("size", size).drop("text"))
    targets = source_targets(sized, weights, most)
    order = [F.col(c).asc_nulls_last() for c in ("doc_id", "size", *carry)]
    placed = numbered(sized, ["source"], order, "place")
    # ``targets`` is a written table, so Spark knows its size and broadcasts it only where it is small
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    shared = placed.join(t, placed["source"].eqNullSafe(t["_s"]), "left").drop("_s")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shared = shared.withColumn("sure", F.floor(times).cast("int")).withColumn("part", times - F.floor(times))
    open_ = (F.col("size") > 0) & (F.col("part") > 0)
    ids = ["doc_id", *carry]
    shared = cut(shared.withColumn("part", F.when(open_, F.col("part")).otherwise(0.0)))
    member = F.struct("place", F.col("size").cast("double").alias("size"), "part", "sure", "source_size", "target", *ids)
    rows = shared.where("part > 0").select("source", F.floor((F.col("place") - 1) / BLOCK).alias("block"), member.alias("m"))
    most_rows = shared.agg(F.max("place")).first()[0] or 0
    done = [shared.where("part = 0").select("source", member.alias("m"))]
    blocks = max(1, -(-most_rows // BLOCK))
    while True:
        folded = cut(
            rows.groupBy("source", "block").agg(F.array_sort(F.collect_list("m")).alias("members"))  # BLOCK rows at most
            .select("source", "block", _fold(F.col("members"), F.col("source")).alias("f")).select("source", "block", "f.*"))
        done.append(folded.select("source", F.explode("done").alias("m")))
        if blocks == 1:
            break
        rows = folded.select("source", F.floor(F.col("block") / BLOCK).alias("block"), F.col("left").alias("m"))
        blocks = -(-blocks // BLOCK)
    last = F.when(_chance(F.col("source"), F.col("left.place")) < F.col("left.part"), 1.0).otherwise(0.0)
    done.append(folded.select("source", F.col("left").withField("part", last).alias("m")))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    copies = (F.col("m.sure") + F.col("m.part")).cast("int")
    return every.select(F.col("m.doc_id").alias("doc_id"), "source", F.col("m.size").cast("long").alias("size"), F.col("m.source_size").alias("source_size"),
                        F.col("m.target").alias("target"), copies.alias("copies"), (copies * F.col("m.size")).cast("long").alias("taken"), *[F.col(f"m.{c}").alias(c) for c in carry])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies`` (``copies_`` where they have such a column).  Rows equal in doc_id, source and text come once, with their copies summed up."""
    own, times, *right = (spare(docs, c) for c in ("text_key", "copies", "taken_id", "taken_source", "taken_key"))
    keyed = docs.withColumn(own, text_key())
    on = ["doc_id", "source", own]
    taken = plan(keyed, weights, most, carry=(own,)).where("copies > 0")
    taken = taken.groupBy(*on).agg(F.sum("copies").cast("int").alias(times)).select(*[F.col(a).alias(b) for a, b in zip(on, right, strict=True)], times)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(on, right, strict=True)]
    return keyed.join(taken, same).dropDuplicates(on).select(*named(docs), times)


def op5(spark, sf_dir: str) -> DataFrame:
    out = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)
