"""Ranked lexical search: the best documents for each item, by masks of the terms that a document matches.

Three passes over tables.  The first cuts each document into terms and writes its length and its counts of the items'
terms (nothing else of the text is kept).  The second adds up the corpus counts.  In the third a task takes its documents
in chunks: for each item the postings of its terms set bits in one mask for each document, documents with equal masks
form a group, and the groups are scored exactly in the order of the most that their mask can reach (the sum of the
largest contributions of its terms among the chunk's documents), until that is below the last of the ``BEST`` found so
far by the task.  What the tasks found is ranked by a window whose limit applies before the shuffle.

Items are taken in blocks of about ``BLOCK`` bytes of text, whose terms travel to the tasks; each block is one turn over
the documents.

Defined results: null and empty texts have no terms, count in no total and are never found; an item without terms has no
row.  Texts of one item_id are one item (also a null one); repeated documents rank one by one, a null doc_id comes last
among equal scores.  Very long texts and items are taken whole.  Without documents or items there is no result.  Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import column, cut, texts_of

BEST = 50
#: Bytes of items' texts in a block, words of masks of a chunk, documents scored together.
BLOCK, MASKS, TOGETHER = 4 << 20, 1 << 22, 64
_NULL = np.iinfo(np.int64).max
#: Letters and digits of ASCII and all of other characters make terms; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """The items of a block: ids, their distinct terms as numbers, and the number of each term."""

    def __init__(self, ids: list[int | None], texts: list[list[bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.terms = [], []
        for item, own in zip(ids, texts, strict=True):
            held = sorted({self.numbers.setdefault(t, len(self.numbers)) for text in own for t in terms(text)})
            if held:
                self.ids.append(item)
                self.terms.append(np.array(held))


def _counted(numbers: dict[bytes, int]) -> Callable:
    def count(batches):
        for batch in batches:
            n, held, times = [], [], []
            for _, texts in texts_of(batch):
                for t in texts:
                    words = terms(t)
                    own = Counter(map(numbers.get, words))
                    own.pop(None, None)
                    n.append(len(words))
                    held.append(list(own))
                    times.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "times"])
    return count


def _held(size: int) -> Callable:
    """How many documents hold each term, one sum for each task."""
    def held(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["term", "df"])
    return held


class Chunk:
    """Postings of some documents: contributions to scores, by term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, held: np.ndarray, times: np.ndarray, lengths: np.ndarray, weight: np.ndarray, documents: int, words: int):
        self.ids = ids
        if 50 * int(n.max(initial=0)) * documents >= 1 << 63:
            n = n.astype(object)  # whole numbers of any size
        m = (50 + 50 * n * documents // max(words, 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), lengths)
        gain = weight[held] * (1_000_000_000 * times // (1000 * times + 20 * m[doc]))
        by = np.argsort(held, kind="stable")  # within a term, documents stay in order
        self.doc, self.gain = doc[by], gain[by]
        self.ends = np.cumsum(np.bincount(held, minlength=len(weight)))
        self.begins = self.ends - np.diff(self.ends, prepend=0)
        self.most = np.zeros(len(weight), np.int64)
        np.maximum.at(self.most, held, gain)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.begins[term], self.ends[term])
        return self.doc[own], self.gain[own]

    def groups(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with a term of the item, ordered by group, groups by falling bound; where groups end; their bounds."""
        present = [k for k in item.tolist() if self.ends[k] > self.begins[k]]
        mask = np.zeros((len(self.ids), -(-max(len(present), 1) // 64)), np.uint64)
        bound = np.zeros(len(self.ids), np.int64)
        for bit, term in enumerate(present):
            docs, _ = self.postings(term)
            mask[docs, bit // 64] |= np.uint64(1 << bit % 64)
            bound[docs] += self.most[term]
        some = np.flatnonzero(bound > 0)
        own = np.ascontiguousarray(mask[some])
        keys = own[:, 0] if own.shape[1] == 1 else own.view(np.dtype((np.void, own.shape[1] * 8)))[:, 0]
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        reach = bound[some][first]
        place = np.empty(len(first), np.int64)
        place[np.argsort(-reach, kind="stable")] = np.arange(len(first))
        group = place[group.reshape(-1)]
        by = np.argsort(group, kind="stable")
        return some[by], np.cumsum(np.bincount(group, minlength=len(first))), np.sort(reach)[::-1]

    def scores(self, item: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of the documents (ascending)."""
        out = np.zeros(len(docs), np.int64)
        for term in item.tolist():
            have, gain = self.postings(term)
            if len(have):
                at = np.minimum(np.searchsorted(have, docs), len(have) - 1)
                out += np.where(have[at] == docs, gain[at], 0)
        return out

    def best(self, item: np.ndarray, found: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """``found`` (scores, ids) made up to the ``k`` best with this chunk; and how many documents were scored."""
        score, ids = found
        docs, ends, reach = self.groups(item)
        at = group = 0
        while group < len(ends) and (len(score) < k or reach[group] >= score[-1]):
            last = max(group, int(np.searchsorted(ends, at + TOGETHER, side="right")) - 1)
            own = np.sort(docs[at:ends[last]])
            score, ids = np.concatenate([score, self.scores(item, own)]), np.concatenate([ids, self.ids[own]])
            by = np.lexsort((ids, -score))[:k]
            score, ids = score[by], ids[by]
            at, group = int(ends[last]), last + 1
        return score, ids, at


def _ranked(items: Items, weight: np.ndarray, documents: int, words: int, k: int) -> Callable:
    widest = max(len(t) for t in items.terms)
    rows = max(64, MASKS // -(-widest // 64))

    def rank(batches):
        empty = np.zeros(0, np.int64)
        found = [(empty, empty)] * len(items.ids)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = np.array([_NULL if x is None else x for x in column(batch, "doc_id")], np.int64)
                lists = batch.column("terms")
                chunk = Chunk(ids, np.asarray(batch.column("n")), np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten()),
                              np.asarray(lists.value_lengths()), weight, documents, words)
                for i, item in enumerate(items.terms):
                    found[i] = chunk.best(item, found[i], k)[:2]
        for item, (score, ids) in zip(items.ids, found, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=ids == _NULL), pa.array(score)], ["item_id", "doc_id", "score"])
    return rank


def blocks(benchmark: DataFrame, size: int = BLOCK):
    """The items, some at a time; texts of one id are one item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    items = cut(rows.groupBy("item_id").agg(F.collect_set("text").alias("texts")).withColumn("size", F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x))))
    total = items.agg(F.sum("size")).first()[0] or 0
    n = -(-total // size)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").toArrow()
        yield Items(own.column("item_id").to_pylist(), own.column("texts").to_pylist())


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the items' terms in the document with their counts."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(numbers), "doc_id long, n long, terms array<int>, times array<long>").where("n > 0"))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def search(docs: DataFrame, benchmark: DataFrame, k: int = BEST, size: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents with a score above 0 for each item."""
    out = None
    for items in blocks(benchmark, size):
        if not items.ids:
            continue
        held = counted(docs, items.numbers)
        documents, words = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        sums = held.select("terms").mapInArrow(_held(len(items.numbers)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(items.numbers), np.int64)  # a count for each of the block's terms
        df[np.asarray(sums.column("term"))] = np.asarray(sums.column("df"))
        part = cut(held.mapInArrow(_ranked(items, weights(df, documents), documents, words, k), "item_id long, doc_id long, score long"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.where("score > 0").withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents
), sized AS MATERIALIZED (
  SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0
), total AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
), weight AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), scored AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words)))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN sized USING (r), total GROUP BY item_id, r
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
