"""Registered queries against their SQL."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import ROOT, compare, duck

FOLDER = f"{ROOT}/sf0.001"
FAST = ["module_paths", "id_algebra", "relevant_files", "token_budget", "component_upsert", "resolve_callees", "class_method_edges", "degrees",
        "extract_components", "extract_code_facts", "module_files", "completeness", "completeness_report", "mentions", "truthfulness_summary",
        "ratings_summary", "suggestions", "rescore", "usage_report", "doc_sections", "prune_context", "feedback_text", "assign_pool", "running_usage"]
NAMES = sorted(queries()) if os.environ.get("FULL") else FAST


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, FOLDER).count() > 0
    else:
        problems, n, *_ = compare(spark, con, name, queries()[name], sql, FOLDER)
        assert not problems, problems


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["id", "dep_id", "pos", "n_depends_on", "n_used_by"]
