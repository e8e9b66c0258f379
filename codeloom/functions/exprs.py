"""Scalar expressions over paths, component ids, types and texts.

Everything here returns a Column built from Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EXCLUDED_FOLDERS = [
    "venv", ".venv", "pycg-venv", "__pycache__", "tests", "test",
    "__macosx", "scripts", "docs", "experiments",
]
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
AGENTS = ["reader", "searcher", "writer", "verifier"]
# ----------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def module_path(path: Column | str) -> Column:
    """``pkg/a.py`` -> ``pkg.a``; a trailing ``__init__`` is kept."""
    return F.translate(F.regexp_replace(_c(path), r"\.py$", ""), "/\\", "..")


def origin_path(relative_file: Column | str, symbol: Column | str, strict: bool = True) -> Column:
    """Dotted path of a symbol found in a file.

    With ``strict`` a trailing ``__init__`` is dropped, so symbols defined in a
    package file carry the package's name; without it the id equals the one
    component extraction gives (``module_path``).
    """
    base = module_path(relative_file)
    if strict:
        base = F.regexp_replace(base, r"(^|\.)__init__$", "")
    return F.when(base == "", _c(symbol)).otherwise(F.concat_ws(".", base, _c(symbol)))


def last_seg(id_: Column | str) -> Column:
    return F.substring_index(_c(id_), ".", -1)


def owner_id(id_: Column | str) -> Column:
    """Everything before the last dot; null for an undotted id."""
    i = _c(id_)
    return F.when(F.instr(i, ".") > 0, F.regexp_replace(i, r"\.[^.]*$", ""))


def short_name(id_: Column | str, component_type: Column | str) -> Column:
    """Last two segments for a method, the last one otherwise."""
    i = _c(id_)
    return F.when(_c(component_type) == "method", F.substring_index(i, ".", -2)).otherwise(last_seg(i))


def label(id_: Column | str, component_type: Column | str) -> Column:
    """Display label; a method shows its class on a line of its own."""
    i = _c(id_)
    is_method = (_c(component_type) == "method") & (F.instr(i, ".") > 0)
    return F.when(is_method, F.concat(last_seg(F.regexp_replace(i, r"\.[^.]*$", "")), F.lit(".\n"), last_seg(i))
                  ).otherwise(last_seg(i))


def normalize_callee(name: Column | str) -> Column:
    return F.translate(_c(name), "/\\", "..")


def line_slice(source: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines ``start``..``end`` (1-based, inclusive) of a text."""
    s, e = _c(start), _c(end)
    lines = F.split(_c(source), LINE_BREAK)
    return F.array_join(F.slice(lines, F.greatest(s, F.lit(1)), F.greatest(e - F.greatest(s, F.lit(1)) + 1, F.lit(0))), "\n")


def is_present_text(col: Column | str) -> Column:
    """A text counts as present when something other than white space is in it."""
    return F.coalesce(F.length(F.regexp_replace(_c(col), r"^\s+|\s+$", "")) > 0, F.lit(False))


def is_present_list(col: Column | str) -> Column:
    return F.coalesce(F.size(_c(col)) > 0, F.lit(False))


def is_present_value(col: Column | str) -> Column:
    """Numbers and flags count as present whenever they are not null, zero and false included."""
    return _c(col).isNotNull()


def norm_type(col: Column | str) -> Column:
    """Type text without white space and round brackets, with one kind of quote."""
    return F.regexp_replace(F.translate(F.coalesce(_c(col), F.lit("")), '"', "'"), r"[\s()]", "")


def is_safe_name(col: Column | str) -> Column:
    """A plain file name: not empty, no folder part, not a parent reference."""
    c = _c(col)
    return F.coalesce((c != "") & ~c.isin(".", "..") & ~c.contains("/") & ~c.contains("\\"), F.lit(False))


def sanitize_name(col: Column | str) -> Column:
    name = F.regexp_replace(F.translate(F.trim(_c(col)), " ", "_"), r"[^a-zA-Z0-9_\-.]", "")
    return F.when(name.rlike(r"\.ya?ml$"), name).otherwise(F.concat(name, F.lit(".yaml")))


def round_half_up(col: Column | str) -> Column:
    return F.round(_c(col), 0).cast("int")


def context_doc(doc: Column | str) -> Column:
    """The documentation as JSON without its examples (what other components get to see)."""
    return F.to_json(_c(doc).dropFields("examples"), {"ignoreNullFields": "false"})


def fmt_elapsed(seconds: Column | str) -> Column:
    """Seconds as ``H:MM:SS``, days in front when there are any."""
    s = F.floor(_c(seconds)).cast("long")
    days = F.floor(s / 86400).cast("long")
    rest = s - days * 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("long"),
                            F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("long"), F.pmod(rest, F.lit(60)))
    prefix = F.when(days == 0, "").when(F.abs(days) == 1, F.format_string("%d day, ", days)
                                        ).otherwise(F.format_string("%d days, ", days))
    return F.concat(prefix, clock)


def path_mismatch(path: Column | str, other: Column | str, component_type: Column | str) -> Column:
    """How many leading parts of ``path`` do not occur, in order, in ``other``.

    Both paths lose their trailing name first (class and method name for a
    method).  Each part is searched behind the place of the previous match.
    """
    cut = F.when(_c(component_type) == "method", 2).otherwise(1)

    def head(col: Column) -> Column:
        parts = F.split(col, r"\.")
        return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - cut, F.lit(0)))

    haystack = head(_c(other))

    def step(acc: Column, part: Column) -> Column:
        tail = F.slice(haystack, acc["seen"] + 1, F.greatest(F.size(haystack) - acc["seen"], F.lit(0)))
        at = F.array_position(tail, part).cast("int")
        return F.when(at > 0, F.struct((acc["seen"] + at).alias("seen"), acc["missed"].alias("missed"))
                      ).otherwise(F.struct(acc["seen"].alias("seen"), (acc["missed"] + 1).alias("missed")))

    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("missed"))
    return F.aggregate(head(_c(path)), start, step, lambda acc: acc["missed"])
