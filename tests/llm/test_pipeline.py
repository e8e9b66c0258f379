"""The pipeline's stages on a small corpus, each against what its operator says of its input."""

import re

import duckdb

import corpus_pipeline
from codeloom.llm import chat
from codeloom.llm.common import cut
from codeloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF
from tests.oracle import compare, duck


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= before
        kept.append((name, docs))
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in " ".join(t.lower().split()) for t in texts for i in items)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    rows = out.collect()
    assert out.columns == [*columns, "copies"] and all(1 <= r["copies"] <= 3 for r in rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(map(words, texts))
    assert abs(sum(words(r["text"]) * r["copies"] for r in rows) - total) < 0.1 * total
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_chat_query_against_sql(spark):
    problems, *_ = compare(spark, duck(SF), "op4", chat.op4, ORACLES["op4_chat_formatting"], SF)
    assert not problems


def test_names():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert duckdb and set(ORACLES) <= set(QUERIES)
