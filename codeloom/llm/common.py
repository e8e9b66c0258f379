"""What the operators of this subpackage share: row ids, remainders, text batches, written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut, shared_folder

__all__ = ["cut", "shared_folder", "remainder", "texts_of", "column", "SPACE", "text_key", "slim", "spare", "named"]

#: Characters between words, as in the class [^\x20\x09-\x0D] of a word.
SPACE = " \t\n\x0b\x0c\r"


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id's text modulo ``of``; an id that is null counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % of


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a text: equal texts, equal keys (null counts as empty)."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str = "text", size: int = 1000) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts as UTF-8 bytes, null as empty, ``size`` rows at a time with the first row's place."""
    texts = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    for at in range(0, len(texts), size):
        yield at, [x or b"" for x in texts.slice(at, size).to_pylist()]


def slim(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator works on, so that further columns never clash with its own."""
    return df.select(*cols)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def named(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
