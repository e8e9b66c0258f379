"""Which tables of facts the queries over sources leave in the shared folder."""

import glob

import pytest

from __spark_entry__ import queries
from codeloom.operators import trace as T
from codeloom.session import shared_folder
from tests.oracle import ROOT


def kept(spark, name):
    """Kinds of facts in each table of facts that the query wrote."""
    root = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/table-*"))
    queries()[name](spark, f"{ROOT}/sf0.001").collect()
    tables = [spark.read.parquet(t) for t in set(glob.glob(f"{root}/table-*")) - before if glob.glob(f"{t}/*.parquet")]
    return [{r[0] for r in t.select("fact").distinct().collect()} for t in tables if "fact" in t.columns and "owner" in t.columns]


@pytest.mark.parametrize("name", ["extract_refs", "extract_attributes", "extract_components", "component_export"])
def test_facts_that_are_read_once_are_not_kept(spark, name):
    assert kept(spark, name) == []


@pytest.mark.parametrize("name", ["import_crawl"])
def test_crawls_keep_the_facts_of_the_symbol_table(spark, name):
    assert kept(spark, name) == [set(T.TABLE_FACTS)]
