"""Codes for vectors: Lloyd's rounds on the parts of whole-number vectors, over partition-local cover trees.

Each task packs its rows into chunks of ``CHUNK`` vectors; a chunk is one row of a written table with a cover tree for
each part (``covertree``), built once.  A round maps over the chunks with the codebooks (``PARTS`` x ``ENTRIES`` entries:
a few thousand numbers), takes whole subtrees by the triangle inequality and cumulative sums, and adds up one partial sum
for each entry and task.  All arithmetic that decides a result is exact, so the result depends neither on how rows are
dealt to tasks nor on the trees.

Defined results: rows whose vector is null or holds a null or a component that is not finite are left out.  Components
are limited to what keeps squares exact in 64 bits (``limit``: above 10,000 for 4,096 components, far more for fewer).
Vectors shorter than the longest, or of a length that the parts do not divide, count as followed by zeros; an empty
vector is all zeros.  Repeated rows count each; rows of one id are ordered by their components, a null id comes last.  With
fewer than ``ENTRIES`` rows there are as many entries as rows.  An empty table has no result.  Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import column, cut
from codeloom.llm.covertree import CoverTree, squared
from codeloom.operators.skew import lookup_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a chunk; rows in a batch of chunks are bounded by Arrow's limit of bytes.
CHUNK = 4096


def limit(width: int) -> int:
    """The largest component: twice it, squared, times the components stays below 2**61."""
    return int(np.sqrt(float(1 << 59) / max(width, 1)))


def whole(vector: Column, most: int) -> Column:
    """Components as whole numbers, rounded down; null if the vector is left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(most))), F.lit(-float(most))))))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    flat = np.asarray(vectors.flatten(), np.int64)
    ends = np.cumsum(lengths)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat if len(ends) else 0
    return out


def _packed(width: int, chunk: int) -> Callable:
    part = width // PARTS

    def row(ids: list, labels: list, x: np.ndarray, kinds: pa.Schema) -> pa.RecordBatch:
        trees = [CoverTree.build(x[:, p * part:(p + 1) * part]).dump() for p in range(PARTS)]
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(kinds.field("vec_id").type)), pa.array([labels], pa.list_(kinds.field("label").type)),
            pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    def pack(batches):
        ids, labels, held, kinds = [], [], [], None
        for batch in batches:
            kinds = batch.schema
            x = _matrix(batch.column("v"), width)
            ids += column(batch, "vec_id")
            labels += column(batch, "label")
            held.append(x)
            if len(ids) >= chunk:
                x = np.concatenate(held)
                for at in range(0, len(ids) - chunk + 1, chunk):
                    yield row(ids[at:at + chunk], labels[at:at + chunk], x[at:at + chunk], kinds)
                done = len(ids) // chunk * chunk
                ids, labels, held = ids[done:], labels[done:], [x[done:]]
        if ids:
            yield row(ids, labels, np.concatenate(held), kinds)
    return pack


def _summed(books: list[np.ndarray]) -> Callable:
    """One row for each number of the codebooks: slot = (part * ENTRIES + entry) * (width of a part + 1) + place."""
    def add(batches):
        step = books[0].shape[1] + 1
        total = np.zeros((PARTS, ENTRIES, step), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                for p, raw in enumerate(batch.column("trees")[k].as_py()):
                    sums, counts, _ = CoverTree.load(raw).sums(books[p])
                    total[p, :len(counts), :-1] += sums
                    total[p, :len(counts), -1] += counts
        flat = total.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(flat[used], pa.int64())], ["slot", "value"])
    return add


def _coded(books: list[np.ndarray], id_type: str, label_type: str) -> Callable:
    def code(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column("ids").slice(k, 1).flatten(), batch.column("labels").slice(k, 1).flatten()
                entries, error = [], np.zeros(len(ids), np.int64)
                for p, raw in enumerate(batch.column("trees")[k].as_py()):
                    tree = CoverTree.load(raw)
                    label, inverse, _, _ = tree.assign(books[p])
                    off = np.square(tree.points - books[p][label]).sum(axis=1)
                    entries.append(label[inverse])
                    error += off[inverse]
                codes = ["".join(f"{e:02x}" for e in row) for row in np.stack(entries, axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
    return code


def chunks(rows: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """The trees of (vec_id, label, v), one row for each chunk."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return cut(rows.mapInArrow(_packed(width, chunk), f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees array<binary>"))


def digest(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(x) for book in books for x in book.reshape(-1).tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def learn(rows: DataFrame, packed: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` rounds, from the rows of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(ENTRIES).toArrow()
    start = _matrix(first.column("v").combine_chunks(), width)
    part = width // PARTS
    books = [start[:, p * part:(p + 1) * part] for p in range(PARTS)]
    for _ in range(rounds):
        sums = packed.select("trees").mapInArrow(_summed(books), "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(PARTS * ENTRIES * (part + 1), np.int64)  # as many numbers as the codebooks hold
        total[np.asarray(sums.column("slot"))] = np.asarray(sums.column("value"))
        total = total.reshape(PARTS, ENTRIES, part + 1)
        for p, book in enumerate(books):
            n = total[p, :len(book), -1:]
            books[p] = np.where(n > 0, np.floor_divide(total[p, :len(book), :-1], np.maximum(n, 1)), book)
    return books


def compress(embeddings: DataFrame, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that is kept."""
    source = embeddings.select("vec_id", "label", F.col("embedding").alias("vector"))
    longest = source.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    rows = cut(source.withColumn("v", whole(F.col("vector"), limit(width))).where("v IS NOT NULL").drop("vector"))
    packed = chunks(rows, width, chunk)
    books = learn(rows, packed, width, rounds)
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    out = cut(packed.mapInArrow(_coded(books, id_type, label_type), f"vec_id {id_type}, label {label_type}, code string, error long")
              .withColumn("none", F.col("label").isNull()).withColumn("known", F.coalesce(F.col("label").cast("string"), F.lit(""))))
    totals = out.groupBy("none", "known").agg(F.sum("error").alias("label_error"))
    return lookup_join(out, totals, ["none", "known"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    part = f"(SELECT CAST(ceil(max(len(embedding)) / {PARTS}.0) AS BIGINT) FROM embeddings)"
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r, vec_id, label, list_concat(e, list_transform(range({part} * {PARTS} - len(e)), lambda x: 0::DOUBLE)) AS e
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), cells AS MATERIALIZED (
  SELECT r, p, e[p * {part} + 1 : (p + 1) * {part}] AS x FROM kept, range({PARTS}) AS _(p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS entry, x AS c FROM cells WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), entry := entry)) AS best
  FROM cells JOIN book{k} USING (p) GROUP BY r, p
)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS MATERIALIZED (
  SELECT p, entry, list(c ORDER BY i) AS c FROM (
    SELECT p, entry, i, floor(sum(y) / count(*)) AS c
    FROM (SELECT n.p, n.best.entry AS entry, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM near{k} n JOIN cells USING (r, p)) GROUP BY p, entry, i
  ) GROUP BY p, entry
), book{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, entry))""")
    return "WITH" + ", ".join(steps) + f""", coded AS (
  SELECT r, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256
  FROM (SELECT p, entry, generate_subscripts(c, 1) AS i, unnest(c) AS c FROM book{ROUNDS})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


ORACLE = _oracle()
