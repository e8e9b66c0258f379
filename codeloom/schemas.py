"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


PARAMETER = _struct("name", "type", "description", "default")
RETURN = _struct("type", "description")
RAISE = _struct("error", "description")
WARNING = _struct("warning", "description")
SEE_ALSO = _struct("name", "description")

DOCUMENTATION = T.StructType([
    T.StructField("short_summary", _S),
    T.StructField("extended_summary", _S),
    T.StructField("parameters", T.ArrayType(PARAMETER)),
    T.StructField("attributes", T.ArrayType(PARAMETER)),
    T.StructField("returns", T.ArrayType(RETURN)),
    T.StructField("yields", T.ArrayType(RETURN)),
    T.StructField("receives", T.ArrayType(PARAMETER)),
    T.StructField("raises", T.ArrayType(RAISE)),
    T.StructField("warns", T.ArrayType(WARNING)),
    T.StructField("warnings_section", _S),
    T.StructField("see_also", T.ArrayType(SEE_ALSO)),
    T.StructField("notes", _S),
    T.StructField("examples", _S),
])

NEED = T.StructType([
    T.StructField("info_need", _B),
    T.StructField("internal_expand", T.ArrayType(_S)),
    T.StructField("external_retrieval", T.ArrayType(_S)),
])

REPORT = T.StructType([
    T.StructField("critiques", T.ArrayType(T.StructType([
        T.StructField("section", _S),
        T.StructField("is_accurate", _B),
        T.StructField("critique", _S),
    ]))),
    T.StructField("suggested_next_step", _S),
    T.StructField("suggestion_feedback", _S),
])

USAGE_CELL = T.StructType([
    T.StructField("call_count", _L), T.StructField("input_tokens", _L),
    T.StructField("output_tokens", _L), T.StructField("total_tokens", _L),
])

GENERATION_STATE = T.StructType([
    T.StructField("final_state", T.StructType([
        T.StructField("docstring", _S),
        T.StructField("reader_search_attempts", _L),
        T.StructField("verifier_rejection_count", _L),
        T.StructField("documentation_json", DOCUMENTATION),
    ])),
    T.StructField("usage_stats", T.StructType([
        T.StructField("components", T.MapType(_S, USAGE_CELL)),
        T.StructField("total", USAGE_CELL),
    ])),
    T.StructField("time_used", T.MapType(_S, _S)),
])

# The stored form of a component.  Required: id, component_type, file_path, relative_path.
COMPONENT_RECORD = T.StructType([
    T.StructField("repo_id", _S),
    T.StructField("id", _S),
    T.StructField("component_type", _S),
    T.StructField("file_path", _S),
    T.StructField("relative_path", _S),
    T.StructField("component_parents", T.ArrayType(_S)),
    T.StructField("depends_on", T.ArrayType(_S)),
    T.StructField("used_by", T.ArrayType(_S)),
    T.StructField("docgen_final_state", GENERATION_STATE),
    T.StructField("component_signature", _S),
    T.StructField("start_line", _L),
    T.StructField("end_line", _L),
    T.StructField("has_docstring", _B),
    T.StructField("docstring", _S),
    T.StructField("dependency_graph_url", _S),
])

FILES = T.StructType([T.StructField(n, _S) for n in
                      ("repo_id", "path", "relative_path", "module_path", "source")])
