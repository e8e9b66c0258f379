"""Building blocks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import cut, kept

HOT_ROWS = 1_000_000
#: The part of a table's rows in which groups of more rows than that are looked for.
SAMPLED = 0.01
#: Longest pieces that substring lookups cut texts into.
PIECE = 8
#: A scope with so many needles or texts, or fewer, is searched pair by pair.
FEW = 16
#: Lookup tables of more rows are not broadcast.
LOOKUP_ROWS = 200_000


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that is usually small (one row per repository, per agent, ...).

    ``lookup`` is computed once and its rows are counted: few are broadcast; else
    the join is an ordinary shuffled one, where adaptive execution splits
    oversized partitions.  (The bytes of the table's files say little: packed
    texts, and rows made from them, take many times as much in memory.)
    """
    small = cut(lookup)
    return df.join(small.hint("broadcast" if small.count() <= LOOKUP_ROWS else "merge"), list(on), how)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
             laid: DataFrame | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without hot tasks.

    Groups are dealt out whole and ordered where they meet.  A group of more than ``HOT_ROWS``
    rows, and the whole table when there are no ``keys``, goes by slices
    instead.  Which groups are that large shows in a sample of the rows; it
    decides on the way only.  ``laid`` is a table at hand with the keys of all
    rows; without it ``df`` is computed into one.
    """
    keys = list(keys)
    if not keys:
        return _numbered_slices(df, keys, order, name)
    if laid is None:
        df = laid = kept(df)
    within = Window.partitionBy(*keys).orderBy(*order)
    hot = None
    if laid.count() > HOT_ROWS:
        hot = cut(hot_keys(laid.sample(SAMPLED, 0), keys, int(HOT_ROWS * SAMPLED)))
    if hot is None or not hot.take(1):
        return df.withColumn(name, F.row_number().over(within).cast("long"))
    df = cut(df) if laid is not df else df
    many, few = (lookup_join(df, hot.select(*keys), keys, how) for how in ("left_semi", "left_anti"))
    columns = [*df.columns, name]
    return _numbered_slices(many, keys, order, name).select(*columns).unionByName(
        few.withColumn(name, F.row_number().over(within).cast("long")).select(*columns))


def _numbered_slices(df: DataFrame, keys: list[str], order: Sequence[Column], name: str) -> DataFrame:
    """The same where a group is spread over many tasks.

    Rows are range partitioned by (keys, order).  Each slice
    numbers its own rows; a group that spans slices adds the sizes of the
    slices before it.  At most one group crosses each slice border, hence the
    offsets joined back are never more than the number of slices.
    """
    sort_cols = [F.col(k) for k in keys] + list(order)
    laid = cut(
        df.repartitionByRange(*sort_cols)
        .withColumn("_slice", F.spark_partition_id())
    )
    within = Window.partitionBy("_slice", *keys).orderBy(*order)
    ranked = laid.withColumn("_at", F.row_number().over(within).cast("long"))
    sizes = laid.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"))
    span = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = (
        # the number of (slice, group) rows of one group is bounded by the number of slices
        sizes.withColumn("_before", F.sum("_n").over(span.orderBy("_slice")) - F.col("_n"))
        .where("_before > 0")
        .drop("_n")
    )
    on = ranked["_slice"] == offsets["_slice"]
    for k in keys:
        on = on & ranked[k].eqNullSafe(offsets[k])
    joined = ranked.join(F.broadcast(offsets), on, "left")
    return joined.select(
        *[ranked[c] for c in df.columns],
        (ranked["_at"] + F.coalesce(offsets["_before"], F.lit(0))).cast("long").alias(name),
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows per key.  The rank filter is applied before the shuffle
    as well as after it, so a hot key ships at most ``k`` rows per input task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_part: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``rows_per_part`` rows and the number of parts to split them into."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_part)
        .select(*keys, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))
    )


def spread(df: DataFrame, keys: Sequence[str], by: Sequence[str], parts: DataFrame) -> DataFrame:
    """Add ``_salt`` to the large side: hot keys get one of their parts, others 0."""
    return lookup_join(df, parts, keys, "left").withColumn(
        "_salt", F.when(F.col("_parts").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"))
    ).drop("_parts")


def replicate(df: DataFrame, keys: Sequence[str], parts: DataFrame) -> DataFrame:
    """Repeat the one-row-per-key side once per part of a hot key."""
    return lookup_join(df, parts, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    ).drop("_parts")


def first_containing(needles: DataFrame, texts: DataFrame, scope: Sequence[str],
                     needle: str, text: str, found: str = "found") -> DataFrame:
    """Distinct (scope, needle) that occur inside a text of the scope, with the smallest such text.

    Where a scope has few needles or few texts, each needle is tested with each text.  In
    the others a needle of up to ``PIECE`` characters is equal to one of the pieces of its
    length that a text is cut into; texts travel as numbers in the order of their names, so
    the smallest is a numeric minimum.  A longer needle is looked up by the one of its own
    pieces that the fewest texts hold, and only the texts found so are tested.
    """
    scope = list(scope)
    wanted = cut(needles.select(*scope, F.col(needle).alias("_needle")).where(F.col(needle).isNotNull()).distinct())
    asked = wanted.groupBy(*scope).agg(F.count(F.lit(1)).alias("_w"))
    given = texts.select(*scope, F.col(text).alias("_text")).where(F.col(text).isNotNull())
    bodies = cut(lookup_join(given, asked.select(*scope), scope, "left_semi").distinct())
    sizes = cut(bodies.groupBy(*scope).agg(F.count(F.lit(1)).alias("_t")).join(asked.hint("merge"), scope)
                .select(*scope, (F.least("_w", "_t") <= FEW).alias("_few")))
    few, many = (sizes.where(c).select(*scope) for c in ("_few", "NOT _few"))
    tested = lookup_join(lookup_join(bodies, few, scope, "left_semi"), lookup_join(wanted, few, scope, "left_semi"), scope)
    hits = tested.where(F.contains("_text", "_needle")).groupBy(*scope, "_needle").agg(F.min("_text").alias(found))
    if many.take(1):
        hits = hits.unionByName(_by_pieces(
            cut(lookup_join(wanted, many, scope, "left_semi")), lookup_join(bodies, many, scope, "left_semi"), scope, found))
    return hits.withColumnRenamed("_needle", needle)


def _pieces(of: str, lengths: Sequence[int]) -> Column:
    """All pieces of these lengths, one for each place."""
    return F.flatten(F.array(*[F.regexp_extract_all(of, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in lengths]))


def _by_pieces(wanted: DataFrame, bodies: DataFrame, scope: list[str], found: str) -> DataFrame:
    texts = cut(numbered(bodies, scope, [F.col("_text")], "_key"))
    size = F.length("_needle")
    lengths = sorted(r[0] for r in wanted.select(size).distinct().collect() if r[0] <= PIECE) if wanted.take(1) else []
    key = [*scope, "_needle"]
    # an empty needle is in every text, so in the first
    first = lookup_join(texts.where("_key = 1").select(*scope, "_key"), wanted.where(size == 0), scope).select(*key, "_key")
    whole = [n for n in lengths if n]
    if whole:
        have = texts.select(*scope, "_key", F.explode(_pieces("_text", whole)).alias("_needle"))
        first = first.unionByName(lookup_join(have, wanted.where((size > 0) & (size <= PIECE)), key).groupBy(*key).agg(F.min("_key").alias("_key")))
    longer = wanted.where(size > PIECE)
    least = longer.agg(F.min(size)).first()[0]
    if least is not None:
        have = texts.where(F.length("_text") >= least).select(*scope, "_key", F.explode(F.array_distinct(_pieces("_text", [PIECE]))).alias("_piece"))
        own = cut(longer.select(*key, F.explode(F.array_distinct(_pieces("_needle", [PIECE]))).alias("_piece")))
        held = lookup_join(have, own.select(*scope, "_piece").distinct(), [*scope, "_piece"], "left_semi")
        known = held.groupBy(*scope, "_piece").agg(F.count(F.lit(1)).alias("_n"))
        rarest = own.join(known.hint("merge"), [*scope, "_piece"], "left").groupBy(*key).agg(
            F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("piece"))).alias("_r"))
        met = lookup_join(have, rarest.where("_r.n > 0").select(*key, F.col("_r.piece").alias("_piece")), [*scope, "_piece"])
        kept = met.select(*key, "_key").join(texts.hint("merge"), [*scope, "_key"]).where(F.contains("_text", "_needle"))
        first = first.unionByName(kept.groupBy(*key).agg(F.min("_key").alias("_key")))
    return lookup_join(texts, first, [*scope, "_key"]).select(*key, F.col("_text").alias(found))
