"""Token counting and truncation with a replaceable tokenizer.

A tokenizer is a pair of column functions.  The default splits words and
punctuation with one regular expression and runs inside the JVM.  A BPE
tokenizer can be plugged in as a pandas UDF pair; its vocabulary is then the
caller's business.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: a run of word characters, or one character that is neither word nor space
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
#: The same tokens as Java's regular expressions find them fastest: what follows a run of word characters is not tried again.
_TOKEN = r"\w++|\S"
_SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Tokenizer:
    name: str
    count: Callable[[Column], Column]
    truncate: Callable[[Column, int], Column]
    # True when count(a + newline + b) == count(a) + count(b)
    additive: bool = False
    # makes the codec (``encode``, ``decode``, perhaps ``longest``: bytes of its longest token) in a task
    load: Callable[[], object] | None = None


# marks the end of every token while truncating; a Unicode noncharacter, never part of a text
_MARK = "\uffff"


def _regex_count(text: Column) -> Column:
    """One character for each token with the space before it; lists of tokens are never made."""
    return F.length(F.regexp_replace(F.rtrim(text, F.lit(_SPACES)), rf"\s*+(?:{_TOKEN})", "x"))


def _regex_truncate(text: Column, n: int) -> Column:
    marked = F.regexp_replace(text, f"({_TOKEN})", f"$1{_MARK}")
    # n marks or fewer: substring_index returns the text as it is
    return F.when(F.lit(n) <= 0, F.lit("")).otherwise(
        F.when(_regex_count(text) <= n, text)
        .otherwise(F.translate(F.substring_index(marked, _MARK, n), _MARK, "")))


REGEX = Tokenizer(
    "regex",
    lambda text: F.coalesce(_regex_count(text), F.lit(0)).cast("long"),
    _regex_truncate,
    additive=True,
)


def from_codec(name: str, load: Callable[[], object]) -> Tokenizer:
    """A tokenizer from an object with ``encode(text) -> list`` and ``decode(list) -> text``.

    ``load`` runs once per Python worker, the texts arrive in Arrow batches.
    """
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load()
        for batch in texts:
            yield batch.fillna("").map(lambda t: len(codec.encode(t)))

    def truncate(text: Column, n: int) -> Column:
        @F.pandas_udf("string")
        def head(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = load()
            for batch in texts:
                yield batch.map(lambda t: None if t is None else codec.decode(codec.encode(t)[:n]))
        return head(text)

    return Tokenizer(name, lambda text: count(text), truncate, load=load)


_current: Tokenizer = REGEX


def set_tokenizer(tokenizer: Tokenizer) -> Tokenizer:
    """Make ``tokenizer`` the default of every operator; returns the former one."""
    global _current
    former, _current = _current, tokenizer
    return former


def get_tokenizer() -> Tokenizer:
    return _current


def token_count(text: Column | str, tokenizer: Tokenizer | None = None) -> Column:
    return (tokenizer or _current).count(F.col(text) if isinstance(text, str) else text)


def truncate_tokens(text: Column | str, n: int, tokenizer: Tokenizer | None = None) -> Column:
    return (tokenizer or _current).truncate(F.col(text) if isinstance(text, str) else text, n)
